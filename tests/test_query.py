"""Builders, filters, relations, pages, batches and raw SQL."""

import pytest
from pyspark.sql import functions as F

from quillspark.errors import EntityNotFound, InvalidQuery, TenantError, UnknownColumn
from quillspark.functions.expr import col, count
from quillspark.operators import paging
from quillspark.operators.range_join import range_join
from quillspark.plans.query import SelectQuery, WhereGroup, query
from quillspark.plans.raw import RawQuery
from quillspark.plans.where import compile_where
from quillspark.sources import catalog as cat
from quillspark.sources.entity import Codec, Column, Relation, define_entity
from quillspark.streaming.batches import Pipeline, windowed_counts


@pytest.fixture(scope="module")
def blog(spark):
    c = cat.Catalog(spark)
    make = spark.createDataFrame
    c.register(define_entity("user", {"id": Column("int", primary=True), "name": Column("text")}, relations={"posts": Relation("one_to_many", "post", "author")}), make([(1, "ann"), (2, "bob"), (3, "cy")], "id int, name string"))
    c.register(define_entity("post", {"id": Column("int", primary=True), "title": Column("text"), "author": Column("int", "author_id"), "gone": Column("datetime", role="deleted_at")}, relations={"writer": Relation("many_to_one", "user", "author"), "comments": Relation("one_to_many", "comment", "post"), "tags": Relation("many_to_many", "tag", through="post_tag", through_own="post_id", through_other="tag_id")}), make([(10, "a", 1, None), (11, "b", 1, None), (12, "c", 2, None), (13, "d", 2, "2020-01-01")], "id int, title string, author_id int, gone string").withColumn("gone", F.col("gone").cast("timestamp_ntz")))
    c.register(define_entity("comment", {"id": Column("int", primary=True), "post": Column("int"), "ok": Column("boolean")}), make([(100, 10, True), (101, 10, None), (102, 11, True)], "id int, post int, ok boolean"))
    c.register(define_entity("tag", {"id": Column("int", primary=True), "label": Column("text")}), make([(1, "x"), (2, "y")], "id int, label string"))
    c.register(define_entity("post_tag", {"post_id": Column("int", primary=True), "tag_id": Column("int", primary=True)}), make([(10, 1), (10, 2), (10, 2), (12, 1)], "post_id int, tag_id int"))
    return c


def start(c, name):
    return SelectQuery(c, c.entity(name), c.scan(name).alias(name), name)


def test_soft_delete_scope(blog):
    assert start(blog, "post").get_count() == 3 and start(blog, "post").with_deleted().get_count() == 4


def test_nested_relations(blog):
    rows = start(blog, "user").load_relation("posts", relations={"comments": None, "tags": None}, order=[("title", "desc")]).order_by("id").get_many()
    assert [[p["title"] for p in r["posts"]] for r in rows] == [["b", "a"], ["c"], []]
    assert [c["id"] for c in rows[0]["posts"][1]["comments"]] == [100, 101] and [t["label"] for t in rows[0]["posts"][1]["tags"]] == ["x", "y"]
    assert start(blog, "post").load_relation("writer").order_by("id").get_many()[2]["writer"] == {"id": 2, "name": "bob"}


def test_relation_filters(blog):
    ids = lambda q: sorted(q.pluck("id"))
    users = start(blog, "user")
    assert ids(users.where({"posts": {"some": {"comments": {"some": {"ok": True}}}}})) == [1]
    assert ids(users.where({"posts": {"none": {}}})) == [3] and ids(users.where_not_has("posts")) == [3]
    assert ids(start(blog, "post").where({"comments": {"every": {"ok": True}}})) == [11, 12]  # a null fails
    assert ids(start(blog, "post").where({"writer": {"is_not": {"name": "ann"}}})) == [12] and ids(users.where_has("posts", {"title": "c"})) == [2]


def test_counts_over_relations_count_roots(blog):
    q = start(blog, "user").left_join_relation("posts")
    assert q.to_df().count() == 4 and q.get_count() == 3 and q.get_sum("user.id") == 6
    assert start(blog, "user").where("id", ">", 5).get_sum("id") == 0 and start(blog, "user").group_by("name").agg(count().as_("n")).get_count() == 3


def test_unknown_names(blog):
    with pytest.raises(UnknownColumn, match="name"):
        start(blog, "user").where({"nam": 1})
    with pytest.raises(UnknownColumn):
        start(blog, "user").load_relation("post")


def test_terminals(blog):
    q = start(blog, "user").order_by("id")
    assert q.get_one()["name"] == "ann" and q.get_map("id")[2]["name"] == "bob" and q.exists() and not q.where("id", 9).exists()
    assert q.get_many_and_count()[1] == 3 and [len(b) for b in q.stream_batch(2)] == [2, 1] and len(list(q.stream())) == 3
    with pytest.raises(EntityNotFound):
        q.where("id", 9).get_one_or_fail()
    with pytest.raises(InvalidQuery):
        q.validate(lambda r: r["id"] < 3).get_many()
    assert "Scan" in q.explain() or "LocalTable" in q.explain()
    find = q.prepare(lambda s, least: s.where("id", ">=", least))
    assert [r["id"] for r in find(least=2)] == [2, 3] and q.when(False, lambda s: s.limit(1)).get_count() == 3


def test_pages_and_cursors(blog):
    q = start(blog, "user").order_by(("name", "desc"))
    p = q.paginate(2, 2)
    assert [r["name"] for r in p.data] == ["ann"] and (p.total, p.total_pages, p.has_next_page, p.has_previous_page) == (3, 2, False, True)
    first = q.get_cursor(2)
    second = q.get_cursor(2, first.next_cursor)
    assert [r["name"] for r in first.data + second.data] == ["cy", "bob", "ann"] and first.has_next_page and second.next_cursor is None
    assert paging.decode_cursor("nonsense") is None
    with pytest.raises(InvalidQuery):
        q.get_cursor(2, "nonsense")


def test_keyset_walks_over_nulls(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else i % 4) for i in range(20)], "id int, v int")
    for down in (False, True):
        keys = [("v", down), ("id", False)]
        order = [(F.desc_nulls_first if down else F.asc_nulls_last)("v"), F.asc("id")]
        want, seen, last = [r.id for r in df.orderBy(*order).collect()], [], None
        while True:
            part = (df if last is None else df.filter(paging.after_cursor(keys, last))).orderBy(*order).limit(3).collect()
            seen += [r.id for r in part]
            if not part:
                break
            last = [part[-1].v, part[-1].id]
        assert seen == want


def test_where_compiler(spark):
    df = spark.range(10)
    n = lambda w: df.filter(compile_where(w)).count()
    assert n({"id": {"gte": 3, "lt": 6}}) == 3 and n([{"id": 1}, {"id": [2, 3]}]) == 3 and n({"NOT": {"id": {"in": [1]}}}) == 9 and n({"AND": [{"id": {"gt": 1}}, {"id": {"between": (0, 4)}}]}) == 3 and n(None) == 10
    for bad in ([], {"id": {"what": 1}}):
        with pytest.raises(InvalidQuery):
            compile_where(bad)
    with pytest.raises(InvalidQuery):
        WhereGroup().build()


def test_tenants_codecs_and_layers(spark):
    c = cat.Catalog(spark, strict_tenants=True)
    upper = Codec(to=F.upper, back=F.lower)
    e = define_entity("doc", {"id": Column("int", primary=True), "body": Column("text", codec=upper), "t": Column("text", role="tenant")})
    c.register(e, spark.createDataFrame([(1, "AB", "x"), (2, "CD", "y")], "id int, body string, t string"))
    with cat.tenant("x"):
        assert [r.body for r in c.scan("doc").collect()] == ["ab"]
    with pytest.raises(TenantError):
        c.scan("doc")
    assert c.scan("doc", tenant_scope=False).count() == 2 and e.write(c.scan("doc", tenant_scope=False)).orderBy("id").head().body == "AB"
    top = c.layer()
    top.register(define_entity("doc", {"id": Column("int", primary=True)}), spark.range(5).selectExpr("cast(id as int) id"))
    assert top.scan("doc").count() == 5 and c.entity("doc") is e


def test_introspection(spark):
    df = spark.createDataFrame([(1, "a", 1.5, [1])], "k bigint, s string, d double, l array<int>")
    e = cat.introspect(df, "thing", ["k"])
    assert e.key == ["k"] and {p: c.type for p, c in e.columns.items()} == {"k": "bigint", "s": "text", "d": "double", "l": "array<int>"} and "primary=True" in cat.source_code(e)


def test_range_join_is_the_theta_join(spark):
    left = spark.range(200).select((F.col("id") * 1.7 - 50).alias("p")).unionAll(spark.sql("SELECT CAST(NULL AS DOUBLE)"))
    right = spark.range(30).select((F.col("id") * 9.0 - 60).alias("lo"), (F.col("id") * 9.0 - 60 + F.col("id") % 25).alias("hi"))
    for how in ("inner", "left"):
        want = left.join(right, (F.col("p") >= F.col("lo")) & (F.col("p") <= F.col("hi")), how)
        assert sorted(map(str, range_join(left, right, "p", "lo", "hi", 10.0, how).collect())) == sorted(map(str, want.collect()))
    assert "BroadcastNestedLoop" not in range_join(left, right, "p", "lo", "hi", 10.0)._jdf.queryExecution().executedPlan().toString()


def test_raw_queries(spark):
    spark.range(10).createOrReplaceTempView("nums")
    r = RawQuery(spark).select("id").from_table("nums")
    ids = lambda q, **v: sorted(x.id for x in q.to_df(**v).collect())
    assert ids(r.where("id > :a", a=7)) == [8, 9] and ids(r.where_in("id", [])) == [] and len(ids(r.where_not_in("id", []))) == 10 and ids(r.where_in("id", [1, 2]).or_where("id = 5")) == [1, 2, 5]
    assert ids(r.where("id < :n"), n=2) == [0, 1] and ids(r.where_between("id", 3, 4).union(r.where("id = 9"))) == [3, 4, 9] and ids(r.except_(r.where("id > 1"))) == [0, 1]
    assert ids(RawQuery(spark).select("id").from_table(r.where("id > 6"), "t").order_by("id").limit([1, 1])) == [8]
    assert ids(r.where_in_query("id", r.where("id < 3"), negate=True).where("id < :k", k=5)) == [3, 4]
    tree = RawQuery(spark).with_recursive("t", "SELECT 1", "SELECT n + 1 FROM t WHERE n < 5", "(n)").select("n AS id").from_table("t")
    assert ids(tree) == [1, 2, 3, 4, 5] and r.where("id = :x").prepare()(x=3) == [{"id": 3}]
    with pytest.raises(InvalidQuery):
        r.select_with_window([], [{"expr": "1; drop", "over": "", "alias": "x"}])
    with pytest.raises(InvalidQuery):
        r.join("CROSS", "nums", "true")


def test_pipeline(spark):
    p = Pipeline(spark.range(25))
    assert p.where({"id": {"lt": 5}}).count() == 5 and p.filter(lambda r: r["id"] % 10 == 0).collect() == [{"id": 0}, {"id": 10}, {"id": 20}]
    assert p.map(lambda r: {"x": r["id"] * 2}, "x long").filter(col("x").gt(45)).collect() == [{"x": 46}, {"x": 48}]
    assert [len(b) for b in p.raw(10)] == [10, 10, 5] and p.binary().num_rows == 25
    assert [len(b) for b in p.keyset_batches("id", "id", 10)] == [10, 10, 5] and [len(b) for b in p.offset_batches(["id"], 20)] == [20, 5]


def _queries_of(spark, group, f):
    """Jobs that f starts."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = f()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_keyset_pages_from_one_sort(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 5)) for i in range(230)] + [(3, 3.0)] * 25
    p = Pipeline(spark.createDataFrame(rows, "id long, v double").repartition(5))
    want = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0]))
    pages, jobs = _queries_of(spark, "keyset", lambda: list(p.keyset_batches("v", "id", 10)))
    assert [(r["id"], r["v"]) for page in pages for r in page] == want and [len(x) for x in pages] == [10] * 25 + [5] and jobs < 15
    whole = lambda page: [{"n": len(page), "ids": [r["id"] for r in page]}]
    made = p.keyset_map("v", "id", whole, "n int, ids array<long>", 10).collect()
    assert sorted(m["ids"] for m in made) == sorted([r["id"] for r in x] for x in pages) and sum(m["n"] == 10 for m in made) == 25
    assert Pipeline(p.df.filter("id < 0")).keyset_map("v", "id", whole, "n int, ids array<long>", 10).count() == 0
    with pytest.raises(ValueError):
        p.keyset_map("v", "id", whole, "n int, ids array<long>", 0)


def test_offset_pages_from_one_sort(spark):
    p = Pipeline(spark.createDataFrame([(i * 37 % 211, i % 3) for i in range(211)], "id long, k int").repartition(5))
    pages, jobs = _queries_of(spark, "offset", lambda: list(p.offset_batches(["id"], 10)))
    assert [[r["id"] for r in x] for x in pages] == [list(range(i, min(i + 10, 211))) for i in range(0, 211, 10)] and jobs < 15
    made = p.offset_map(["id"], lambda page: [{"ids": [r["id"] for r in page]}], "ids array<long>", 10).collect()
    assert sorted(m["ids"] for m in made) == [[r["id"] for r in x] for x in pages]
    tied = p.offset_map(["k"], lambda page: [{"id": r["id"], "n": len(page)} for r in page], "id long, n int", 10).collect()
    assert sorted(r["id"] for r in tied) == list(range(211)) and sum(r["n"] == 10 for r in tied) == 210


def test_streamed_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "event_type")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").count().select("window.start", "event_type", "count")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, want.collect()))


def test_filters_reach_the_scan(spark):
    q = query(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o").where("o_totalprice", ">", 1000).where(col("o_orderpriority").starts_with("1")).select("o_orderkey")
    plan = q.explain()
    assert "GreaterThan(o_totalprice" in plan and "StringStartsWith" in plan and "o_orderdate" not in plan.split("ReadSchema")[1]


def test_top_n_is_pruned_before_the_shuffle(spark):
    from quillspark.operators.relations import page_each_parent

    plan = page_each_parent(spark.read.parquet("/root/testdata/sf0.001/orders.parquet"), "o_custkey", ["o_orderkey"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_on_between_meets_in_cells(spark):
    """Any numeric or time axis, either side, without a nested loop."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        points = spark.range(300).select("id", (F.col("id") * 1.3).alias("p"), F.timestamp_seconds(F.col("id") * 60).alias("at"))
        spans = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 20.0).alias("lo"), (F.col("id") * 20.0 + F.col("id")).alias("hi"), F.timestamp_seconds(F.col("id") * 700).alias("t0"), F.timestamp_seconds(F.col("id") * 700 + 100).alias("t1"))
        for names in (("p", "lo", "hi"), ("at", "t0", "t1")):
            want = points.join(spans, F.col(names[0]).between(F.col(names[1]), F.col(names[2])))
            for left, right in ((points, spans), (spans, points)):
                got = query(left, "a").inner_join(right, lambda j: j.on_between(*names)).to_df()
                assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
                assert sorted((r.id, r.k) for r in got.collect()) == sorted((r.id, r.k) for r in want.collect())
            assert query(points, "a").left_join(spans, lambda j: j.on_between(*names)).to_df().count() == points.join(spans, F.col(names[0]).between(F.col(names[1]), F.col(names[2])), "left").count()
        more = query(points, "a").inner_join(spans, lambda j: j.on_between("p", "lo", "hi").on_val("k", ">", 10)).to_df()
        assert more.count() == points.join(spans, F.expr("p BETWEEN lo AND hi AND k > 10")).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_another_database(spark, tmp_path):
    """Derby, which comes with Spark, in memory: write, read in ranges, keys and foreign keys of its catalog."""
    url = f"jdbc:derby:memory:{tmp_path.name};create=true"
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    statement = connection.createStatement()
    for text in ("CREATE TABLE TEAM (ID INT NOT NULL PRIMARY KEY, NAME VARCHAR(20))", "CREATE TABLE MEMBER (A INT NOT NULL, B INT NOT NULL, TEAM INT REFERENCES TEAM(ID), PRIMARY KEY (B, A))"):
        statement.execute(text)
    connection.close()
    cat.jdbc_write(spark.range(10).select(F.col("id").cast("int").alias("ID"), F.concat(F.lit("t"), F.col("id")).alias("NAME")), url, "TEAM")
    assert cat.jdbc(spark, url, "TEAM", "ID", (0, 10), 3).filter("ID > 6").count() == 3
    member = cat.jdbc_entity(spark, url, "MEMBER", "APP")
    assert member.key == ["A", "B"] or member.key == ["B", "A"]
    assert {k: (r.kind, r.target, r.key) for k, r in member.relations.items()} == {"team": ("many_to_one", "TEAM", "TEAM")}


def test_tenants_with_tables_of_their_own(spark, tmp_path):
    for k in (1, 2):
        spark.range(k).write.parquet(str(tmp_path / f"t{k}"))
    c = cat.Catalog(spark)
    c.register(define_entity("thing", {"id": Column("bigint", primary=True)}), cat.tenant_source(str(tmp_path) + "/t{tenant}"))
    for k in (1, 2):
        with cat.tenant(k):
            assert c.scan("thing").count() == k
    with pytest.raises(TenantError):
        c.scan("thing")
