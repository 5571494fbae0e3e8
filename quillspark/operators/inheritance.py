"""Rows of an entity that belongs to a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.errors import QuillError
from quillspark.sources.entity import Entity


def _below(catalog, entity: Entity) -> list[Entity]:
    out = []
    for c in catalog.children(entity):
        out += [c, *_below(catalog, c)]
    return out


def scan_rows(catalog, entity: Entity) -> DataFrame:
    """The entity's rows by its strategy; plain entities are their table."""
    inherited = entity.inheritance
    if inherited is None:
        return entity.read(catalog.stored(entity))
    if inherited.strategy == "single":
        return single_table(catalog, entity)
    if inherited.strategy == "joined":
        return joined_child(catalog, entity) if inherited.parent else joined_root(catalog, entity)
    if inherited.strategy == "concrete":
        return entity.read(catalog.stored(entity)) if inherited.parent else concrete_union(catalog, entity)
    raise QuillError(f"unknown strategy {inherited.strategy!r}")


def single_table(catalog, entity: Entity) -> DataFrame:
    """One table: a subtype is a filter on the discriminator, which includes the types below it."""
    inherited = entity.inheritance
    rows = catalog.stored(entity)
    if inherited.parent:
        values = [e.inheritance.value for e in (entity, *_below(catalog, entity)) if e.inheritance.value is not None]
        rows = rows.filter(F.col(inherited.discriminator).isin(values))
    return entity.read(rows)


def joined_child(catalog, entity: Entity) -> DataFrame:
    """A table each: the child's rows with those of its parents, by the shared key."""
    parent = catalog.entity(entity.inheritance.parent)
    key = parent.key
    own = entity.read(catalog.stored(entity))
    above = joined_child(catalog, parent) if parent.inheritance and parent.inheritance.parent else parent.read(catalog.stored(parent))
    return above.join(own, key, "inner")


def joined_root(catalog, entity: Entity) -> DataFrame:
    """The root with the columns of all subtypes, null where the row is of another one."""
    out = entity.read(catalog.stored(entity))
    for child in _below(catalog, entity):
        own = child.read(catalog.stored(child))
        out = out.join(own.select(*entity.key, *[c for c in own.columns if c not in out.columns]), entity.key, "left")
    return out


def concrete_union(catalog, entity: Entity) -> DataFrame:
    """A full table each: UNION ALL of the concrete ones, missing columns null, with the discriminator."""
    out = None
    for child in _below(catalog, entity):
        if child.inheritance.value is None:
            continue
        own = child.read(catalog.stored(child)).withColumn(entity.inheritance.discriminator, F.lit(child.inheritance.value))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise QuillError(f"{entity.name} has no concrete type")
    return out
