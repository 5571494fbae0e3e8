"""Reads by options, keyed writes, units of work, caches and events."""

import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.errors import EntityNotFound, InvalidQuery, OptimisticLockError, QuillError, ValidationError
from quillspark.manager import EntityManager, at_least, max_length, topological_sort
from quillspark.sources import schema_tools
from quillspark.sources.entity import Column, Relation, define_entity, snake_case


@pytest.fixture
def em(spark, tmp_path):
    m = EntityManager(spark, str(tmp_path))
    m.register(define_entity("team", {"id": Column("int", primary=True, generated="increment"), "name": Column("text", nullable=False)}, relations={"members": Relation("one_to_many", "member", "team", cascade=True)}, unique=(("name",),)))
    m.register(define_entity("member", {"id": Column("int", primary=True, generated="increment"), "team": Column("int", "team_id"), "nick": Column("text", checks=(max_length(5),)), "age": Column("int", checks=(at_least(0),)), "v": Column("int", role="version"), "gone": Column("timestamp", role="deleted_at"), "touched": Column("timestamp", role="updated_at")}, relations={"group": Relation("many_to_one", "team", "team", cascade=True)}))
    m.register(define_entity("link", {"a": Column("int", primary=True), "b": Column("int", primary=True)}))
    return m


def nicks(em, **options):
    return sorted(r["nick"] for r in em.find("member", **options))


def test_insert_find_update(em):
    team = em.save("team", {"name": "red", "members": [{"nick": "ann", "age": 30}, {"nick": "bob", "age": 20}]})
    assert team["id"] == 1 and nicks(em) == ["ann", "bob"] and em.find("member", where={"nick": "ann"})[0]["team"] == 1
    assert em.find_by_pk("member", 2)["nick"] == "bob" and em.find_by_pks("member", []) == [] and set(em.find_by_pks_map("member", [1, 2])) == {1, 2}
    em.save("member", {"id": 2, "age": 21})
    row = em.find_by_pk("member", 2)
    assert (row["nick"], row["age"], row["v"]) == ("bob", 21, 2) and isinstance(row["touched"], datetime.datetime)
    with pytest.raises(OptimisticLockError):
        em.save("member", {"id": 2, "age": 22, "v": 1})
    assert em.update_many("member", {"age": {"gt": 25}}, {"nick": F.upper("nick")}) == 1 and em.increment("member", {"id": 1}, "age", 5) == 1
    assert em.find_by_pk("member", 1)["age"] == 35 and nicks(em) == ["ANN", "bob"] and em.update_many("member", {"id": 1}, {}) == 0
    assert (em.sum("member", "age"), em.count("member"), em.exists("member", {"id": 9}), em.max("member", "age", {"id": 9})) == (56, 2, False, 0)
    assert em.update_builder("member").set(nick="x").where({"age": {"gt": 0}}).order_by(("age", "desc")).limit(1).execute() == 1 and nicks(em) == ["bob", "x"]


def test_checks(em):
    for bad in ({"nick": "toolong"}, {"age": -1}):
        with pytest.raises(ValidationError):
            em.insert_many("member", [bad])
    with pytest.raises(ValidationError):
        em.insert_many("team", [{"name": None}])
    em.insert_many("team", [{"name": "a"}])
    with pytest.raises(ValidationError):
        em.insert_many("team", [{"name": "a"}])
    for f in (em.delete, em.soft_delete):
        with pytest.raises(InvalidQuery):
            f("member", {})
    with pytest.raises(EntityNotFound):
        em.find_one_by_or_fail("team", {"name": "zz"})
    with pytest.raises(InvalidQuery):
        em.find("team", wher={})
    with pytest.raises(QuillError):
        em.find("nothing")


def test_deletes_cascade(em):
    em.save_many("team", [{"name": "a", "members": [{"nick": "x"}, {"nick": "y"}]}, {"name": "b", "members": [{"nick": "z"}]}])
    assert em.soft_delete("member", {"nick": "z"}) == 1 and nicks(em) == ["x", "y"] and nicks(em, with_deleted=True) == ["x", "y", "z"]
    assert em.restore("member", {"nick": "z"}) == 1 and nicks(em) == ["x", "y", "z"]
    assert em.delete("team", {"name": "a"}) == 1 and nicks(em) == ["z"] and em.delete_many("member", []) == 0
    em.clear("member")
    assert em.count("member") == 0


def test_upserts(em):
    em.insert_many("member", [{"nick": "a", "age": 1}, {"nick": "b", "age": 2}])
    em.soft_delete("member", {"nick": "b"})
    em.batch_upsert("member", [{"id": 2, "nick": "b2", "age": 5}, {"id": 7, "nick": "new", "age": 1}])
    assert nicks(em) == ["a", "b2", "new"] and em.find_by_pk("member", 2)["v"] == 2
    em.insert_ignore("member", [{"id": 7, "nick": "no"}, {"id": 8, "nick": "yes"}])
    assert nicks(em) == ["a", "b2", "new", "yes"]
    out = em.insert_builder("member").values([{"id": 1, "nick": "q", "age": 9}]).on_conflict("id").do_update({"age": F.col("__old.age") + F.col("__new.age")}, where=F.col("__old.age") < 5).execute_and_return()
    assert {r.id: (r.nick, r.age) for r in out.collect()}[1] == ("a", 10)
    em.insert_builder("member").values({"id": 1, "nick": "q"}).on_conflict("id").do_nothing().execute()
    assert em.find_by_pk("member", 1)["nick"] == "a"


def test_bridges_and_pages(em):
    em.catalog.entities["team"][0].relations["friends"] = Relation("many_to_many", "team", through="link", through_own="a", through_other="b")
    em.insert_many("team", [{"name": n} for n in "abcde"])
    em.attach_relation("team", "friends", 1, [2, 3])
    em.attach_relation("team", "friends", 1, [3, 4])
    em.detach_relation("team", "friends", 1, [2])
    assert [t["id"] for t in em.find("team", where={"id": 1}, relations=["friends"])[0]["friends"]] == [3, 4]
    rows, total = em.find_and_count("team", order=["name"], take=2, skip=1)
    assert [r["name"] for r in rows] == ["b", "c"] and total == 5 and em.find_with_page("team", 3, 2).data[0]["name"] == "e"
    page = em.find_with_cursor("team", 3)
    assert [r["name"] for r in em.find_with_cursor("team", 3, page.next_cursor).data] == ["d", "e"]
    assert em.pluck("team", "name", order=[("name", "desc")], take=1) == ["e"] and [len(b) for b in em.stream_batch("team", 2)] == [2, 2, 1] and em.repository("team").count() == 5


def test_unit_of_work(em):
    em.save("team", {"name": "a", "members": [{"nick": "x", "age": 1}]})
    with em.transaction() as w:
        row = w.find_one("member", 1)
        assert w.find_one("member", 1) is row
        row["age"] = 50
        w.persist("member", {"nick": "new", "age": 2, "team": 1})
        assert w.compute_changes() == {("member", (1,)): {"age": 50}} and "member" in w.preview()["insert"]
    assert em.find_by_pk("member", 1)["age"] == 50 and nicks(em) == ["new", "x"]
    with pytest.raises(RuntimeError), em.transaction() as w:
        w.remove("member", {"id": 1})
        raise RuntimeError
    assert em.count("member") == 2
    w = em.buffer()
    w.remove("member", {"id": 1})
    w.merge("member", {"id": 2, "nick": "m"})
    w.flush()
    assert nicks(em) == ["m"]
    assert topological_sort(["c", "b", "a"], {"c": {"b"}, "b": {"a"}}) == ["a", "b", "c"] and topological_sort(["x", "y"], {"x": {"y"}, "y": {"x"}}) == ["x", "y"]


def test_cache_events_plugins(em):
    em.insert_many("team", [{"name": "a"}])
    seen = []

    class Plugin:
        name = "p"

        def after_load(self, name, row):
            seen.append(row["name"])

    em.extend(Plugin())
    assert em.has_plugin("p") and em.find("team", cache=60) == em.find("team", cache=60) and seen == ["a", "a"]
    em.insert_many("team", [{"name": "b"}])
    assert len(em.find("team", cache=60)) == 2 and em.tracker.repeated(3) == {"find team": 3}
    assert em.query("SELECT :x AS x", x=4).head().x == 4


def test_stale_snapshot_is_refused(em):
    team = em.catalog.entity("team")
    table, version = em._table(team)
    em.insert_many("team", [{"name": "z"}])
    with pytest.raises(OptimisticLockError):
        em._commit(team, table, version)


def test_schema_tools(spark, tmp_path):
    old = define_entity("t", {"id": Column("int", primary=True), "full": Column("text"), "n": Column("int")})
    new = define_entity("t", {"id": Column("int", primary=True), "fullName": Column("text", "full_name"), "n": Column("bigint"), "x": Column("date")})
    d = schema_tools.diff(old.schema(), new.schema())
    assert d.renamed == {"full": "full_name"} and d.changed == {"n": ("int", "bigint")} and d.added == {"x": "date"} and d.removed == []
    assert "CREATE TABLE" in schema_tools.create_table(new) and snake_case("fullName") == "full_name"
    done = []
    runner = schema_tools.Runner(spark, str(tmp_path / "history"), [("001", lambda: done.append(1), lambda: done.append(-1)), ("002", lambda: done.append(2), None)])
    assert runner.run() == ["001", "002"] and runner.run() == [] and runner.revert_last() == "002" and runner.pending() == ["002"] and done == [1, 2]


def test_relation_filters(em):
    """Null, OR, NOT, every with null and nested relations, and rows that are softly deleted."""
    em.save_many("team", [{"name": "a", "members": [{"nick": "x", "age": 5}, {"nick": "y", "age": None}]}, {"name": "b", "members": [{"nick": "z", "age": 9}]}, {"name": "c"}])
    em.insert_many("member", [{"nick": "free", "age": 1}])
    teams = lambda w, **o: sorted(r["name"] for r in em.find("team", where=w, **o))
    assert nicks(em, where={"group": {"is": None}}) == ["free"] and nicks(em, where={"group": {"isNot": None}}) == ["x", "y", "z"]
    assert nicks(em, where={"group": {"isNot": {"name": "a"}}}) == ["free", "z"]
    assert teams({"OR": [{"name": "c"}, {"members": {"some": {"age": {"gt": 8}}}}]}) == ["b", "c"] and teams({"NOT": {"members": {"some": {}}}}) == ["c"]
    assert teams([{"members": {"none": {}}}, {"members": {"some": {"nick": "x"}}}]) == ["a", "c"]
    assert teams({"members": {"every": {"age": {"gt": 0}}}}) == ["b", "c"] and teams({"members": {"every": {}}}) == ["a", "b", "c"]
    assert nicks(em, where={"group": {"is": {"members": {"every": {"group": {"is": {"name": "b"}}, "age": 9}}}}}) == ["z"]
    em.soft_delete("member", {"nick": "z"})
    assert teams({"members": {"some": {"nick": "z"}}}) == [] and teams({"members": {"some": {"nick": "z"}}}, with_deleted=True) == ["b"]
    assert em.update_many("team", {"members": {"some": {"nick": "x"}}}, {"name": "A"}) == 1 and em.delete("team", {"members": {"none": {}}}) == 2
    for bad in ({"members": {"some": None}}, {"members": {"is": {}}}, {"members": {"sum": 1, "some": {}}}):
        with pytest.raises(InvalidQuery):
            teams(bad)


def test_returning(em):
    em.insert_many("member", [{"nick": "old", "age": 1}])
    out = em.insert_builder("member").values([{"nick": "n1", "age": 2}, {"nick": "n2"}]).execute_and_return()
    assert sorted((r.id, r.nick, r.v) for r in out.collect()) == [(2, "n1", 1), (3, "n2", 1)]
    rows = [{"id": 1, "nick": "q", "age": 5}, {"id": 2, "nick": "r", "age": 5}, {"id": 9, "nick": "s", "age": 5}]
    build = lambda: em.insert_builder("member").values(rows).on_conflict("id")
    assert [r.id for r in build().do_nothing().execute_and_return().collect()] == [9]
    out = build().do_update(["age"], where=F.col("__old.age") < 2).execute_and_return().collect()
    assert [(r.id, r.nick, r.age) for r in out] == [(1, "old", 5)]


def test_commits_are_exclusive_and_old_versions_go(em, tmp_path):
    team = em.catalog.entity("team")
    store = em._store(team)
    em.insert_many("team", [{"name": "a"}])
    table, version = em._table(team)
    head = store._head()
    assert store._claim(head + 1, "v-other") is True and store._claim(head + 1, "v-mine") is False
    store.set_back(version)
    assert store.current() == version and em.count("team") == 1
    em.insert_many("team", [{"name": "b"}])
    assert store.vacuum() > 0 and em.count("team") == 2 and len(list((tmp_path / "team").glob("v-*"))) == 1


def test_a_failed_flush_sets_tables_back(em):
    em.insert_many("team", [{"name": "a"}])
    with pytest.raises(ValidationError), em.transaction() as w:
        w.persist("team", {"name": "b"})
        w.persist("member", {"nick": "toolong"})
    assert [r["name"] for r in em.find("team")] == ["a"] and em.count("member") == 0


def test_tables_in_memory(spark):
    m = EntityManager(spark, in_memory=True)
    m.register(define_entity("note", {"id": Column("int", primary=True, generated="increment"), "text": Column("text", checks=(max_length(5),))}))
    m.insert_many("note", [{"text": "a"}, {"text": "b"}])
    m.update_many("note", {"id": 2}, {"text": "c"})
    m.delete("note", {"id": 1})
    assert m.find("note") == [{"id": 2, "text": "c"}]
    with pytest.raises(ValidationError), m.transaction() as w:
        w.persist("note", {"text": "toolong"})
    assert m.count("note") == 1


def test_locks_replicas_and_indexes(spark, tmp_path):
    m, other = EntityManager(spark, str(tmp_path)), EntityManager(spark, str(tmp_path))
    with m.advisory_lock("job"):
        with pytest.raises(QuillError), other.advisory_lock("job", wait=0.1):
            pass
    with other.advisory_lock("job", wait=0.1):
        pass
    entity = define_entity("n", {"id": Column("bigint", primary=True)})
    m.catalog.register(entity, spark.range(1), replicas=(spark.range(2), spark.range(3)))
    assert [m.count("n") for _ in range(4)] == [2, 3, 2, 3] and len(m.find("n", use_master=True)) == 1
    m.register(define_entity("k", {"id": Column("int", primary=True), "at": Column("int", "at_col")}, indexes=(("at",),)))
    m.insert_many("k", spark.range(100).select(F.col("id").cast("int").alias("id"), (F.col("id") * 37 % 100).cast("int").alias("at")).coalesce(1))
    path = m._store(m.catalog.entity("k"))
    rows = [r.at_col for r in path.read().coalesce(1).collect()]
    assert sorted(rows) == list(range(100)) and sum(a > b for a, b in zip(rows, rows[1:], strict=False)) <= spark.sparkContext.defaultParallelism
