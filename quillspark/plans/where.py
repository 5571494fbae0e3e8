"""Filters given as dictionaries, and relation filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.errors import InvalidQuery
from quillspark.functions.expr import Expr, and_, as_expr, column, not_, or_
from quillspark.operators import relations
from quillspark.sources.entity import Entity

OPERATORS = {
    "eq": Expr.eq, "ne": Expr.neq, "neq": Expr.neq, "gt": Expr.gt, "gte": Expr.gte, "lt": Expr.lt, "lte": Expr.lte, "in": Expr.in_, "notIn": Expr.not_in, "not_in": Expr.not_in,
    "like": Expr.like, "notLike": Expr.not_like, "not_like": Expr.not_like, "ilike": Expr.ilike, "contains": Expr.contains, "startsWith": Expr.starts_with, "starts_with": Expr.starts_with,
    "endsWith": Expr.ends_with, "ends_with": Expr.ends_with, "search": Expr.match_against, "between": lambda e, v: e.between(*v), "isNull": lambda e, v: e.is_null() if v else e.is_not_null(),
    "is_null": lambda e, v: e.is_null() if v else e.is_not_null(),
}

#: Operators of the three-argument form of where().
SIGNS = {
    "=": Expr.eq, "!=": Expr.neq, "<>": Expr.neq, ">": Expr.gt, ">=": Expr.gte, "<": Expr.lt, "<=": Expr.lte, "LIKE": Expr.like, "NOT LIKE": Expr.not_like, "ILIKE": Expr.ilike,
    "IN": Expr.in_, "NOT IN": Expr.not_in, "IS NULL": lambda e, v: e.is_null(), "IS NOT NULL": lambda e, v: e.is_not_null(), "BETWEEN": lambda e, v: e.between(*v),
}


def compare(left, sign: str, right=None) -> Expr:
    if sign.upper() not in SIGNS:
        raise InvalidQuery(f"unknown operator {sign!r}")
    return SIGNS[sign.upper()](as_expr(left), right)


def field_filter(left: Expr, value) -> Expr:
    """A plain value means equality, a list IN, a dictionary its operators, all of which hold."""
    if not isinstance(value, dict):
        return left.eq(value)
    parts = []
    for name, operand in value.items():
        if name == "not":
            parts.append(not_(field_filter(left, operand)))
        elif name in OPERATORS:
            parts.append(OPERATORS[name](left, operand))
        else:
            raise InvalidQuery(f"unknown operator {name!r}")
    return and_(*parts)


def compile_where(where, prefix: str = "", entity: Entity | None = None, catalog=None, with_deleted: bool = False) -> Column:
    """A Column from a dictionary, a list of them (any holds), or a condition. The keys AND, OR and NOT nest.

    With a catalog, the entity's relations are keys too, at any depth; see relation_filter.
    """
    inner = lambda w: compile_where(w, prefix, entity, catalog, with_deleted)
    if where is None:
        return F.lit(True)
    if isinstance(where, (Expr, Column)):
        return column(where)
    if isinstance(where, list):
        if not where:
            raise InvalidQuery("an empty list of alternatives holds nothing to choose from")
        return or_(*[inner(w) for w in where]).column
    parts = []
    for name, value in where.items():
        if name == "AND":
            parts += [inner(w) for w in (value if isinstance(value, list) else [value])]
        elif name == "OR":
            parts.append(inner(value if isinstance(value, list) else [value]))
        elif name == "NOT":
            parts.append(~inner(value))
        elif catalog is not None and entity is not None and name in entity.relations:
            parts.append(relation_filter(catalog, entity, name, value, with_deleted))
        else:
            if entity is not None:
                entity.check([name])
            parts.append(field_filter(as_expr(prefix + name), value).column)
    return and_(*parts).column


COLLECTION_MODES, SINGLE_MODES = ("some", "none", "every"), ("is", "isNot", "is_not")


def relation_filter(catalog, entity: Entity, name: str, given, with_deleted: bool = False) -> Column:
    """Whether the related rows fit: some, none, every (a row that the filter can't decide fails) for collections, is, isNot for single ones.

    A correlated EXISTS for each mode: alone or under AND it plans as a semi or
    anti join, under OR and NOT as an existence join. For single relations null
    asks whether there is no related row; collections take no null. A filter
    without a mode means ``some`` or ``is``.
    """
    target = catalog.entity(entity.relations[name].target)
    many = entity.relations[name].kind in ("one_to_many", "many_to_many")
    modes = COLLECTION_MODES if many else SINGLE_MODES
    if not isinstance(given, dict) or not set(given) & {*COLLECTION_MODES, *SINGLE_MODES}:
        given = {modes[0]: given}
    parts = []
    for mode, inner in given.items():
        if mode not in modes:
            raise InvalidQuery(f"{mode!r} cannot filter {entity.name}.{name}; it takes {', '.join(modes)}")
        if inner is None and many:
            raise InvalidQuery(f"{entity.name}.{name}: {mode!r} takes a filter, not null")
        rows, keys = relations.related(catalog, entity, name, with_deleted)
        if mode == "every":
            fits = compile_where(inner, "", target, catalog, with_deleted)
            parts.append(~_exists(rows.filter(~F.coalesce(fits, F.lit(False))), keys) if inner else F.lit(True))
            continue
        met = _exists(rows.filter(compile_where(inner, "", target, catalog, with_deleted)) if inner else rows, keys)
        wanted = (mode in ("some", "is")) == (inner is not None)
        parts.append(met if wanted else ~met)
    return and_(*parts).column


def _exists(rows: DataFrame, keys: list[tuple[str, str]]) -> Column:
    """EXISTS over rows that agree in (own property, column of the rows).

    The rows' columns get names of their own, and the alias keeps Spark from
    looking for the outer row's names among columns that were left out.
    """
    inner = rows.select(*[F.col(other).alias(f"__related_{i}") for i, (_, other) in enumerate(keys)]).alias("__related")
    for i, (own, _) in enumerate(keys):
        inner = inner.filter(F.col(f"__related_{i}") == F.col(own).outer())
    return inner.exists()


def exists(sub, on: dict[str, str] | None = None) -> Expr:
    """EXISTS (subquery) as an expression, for use under OR and NOT, in CASE and in select lists.

    on: {column of the outer row: column of the subquery}; both must be equal.
    Without it the subquery stands alone.
    """
    rows = sub if isinstance(sub, DataFrame) else sub.to_df()
    return Expr(_exists(rows, list(on.items())) if on else rows.exists())


def not_exists(sub, on: dict[str, str] | None = None) -> Expr:
    return not_(exists(sub, on))
