"""Queries through the entity manager, its writes, pages, batches and raw statements, with SQL twins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import expr as E
from quillspark.functions.expr import col, count
from quillspark.manager import EntityManager
from quillspark.operators import write
from quillspark.plans.catalogue import Tables, twin
from quillspark.plans.query import SelectQuery, query
from quillspark.plans.raw import RawQuery
from quillspark.plans.where import exists, not_exists
from quillspark.sources.catalog import describe_table, introspect, list_tables, tenant
from quillspark.sources.entity import Column, Relation, define_entity
from quillspark.streaming.batches import Pipeline


def managed(t: Tables) -> EntityManager:
    """A manager over the test tables' entities."""
    em = EntityManager(t.spark)
    em.catalog = t.catalog()
    return em


def told(t: Tables, rows: list[dict], schema: str) -> DataFrame:
    """Rows that a call has brought to the driver, as a DataFrame again."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    return t.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def scratch(spark: SparkSession) -> str:
    """A folder for written tables: the shared one of a cluster, or a temporary one where none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillspark-")
    return f"{root}/managed-{uuid.uuid4().hex}"


CUSTOMER = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


# the find family


@twin("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_acctbal DESC, c_custkey LIMIT 15 OFFSET 5")
def find_options(t):
    rows = managed(t).find("customer", where={"c_mktsegment": "BUILDING"}, select=["c_custkey", "c_name", "c_acctbal"], order=[("c_acctbal", "desc"), "c_custkey"], take=15, skip=5)
    return told(t, rows, "c_custkey long, c_name string, c_acctbal double")


@twin("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND c_acctbal > 0")
def find_by(t):
    return told(t, managed(t).find_by("customer", {"c_nationkey": 3, "c_acctbal": {"gt": 0}}), "c_custkey long, c_name string")


@twin("""SELECT * FROM (SELECT 'one' AS how, c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1) UNION ALL SELECT 'by', 7 UNION ALL SELECT 'fail', 8 UNION ALL SELECT 'by_fail', 9
UNION ALL SELECT 'pk', 10 UNION ALL SELECT 'none', NULL""")
def find_one_family(t):
    em = managed(t)
    order = [("c_acctbal", "desc"), "c_custkey"]
    found = [("one", em.find_one("customer", order=order)), ("by", em.find_one_by("customer", {"c_custkey": 7})), ("fail", em.find_one_or_fail("customer", where={"c_custkey": 8}))]
    found += [("by_fail", em.find_one_by_or_fail("customer", {"c_custkey": 9})), ("pk", em.find_by_pk("customer", 10)), ("none", em.find_by_pk("customer", -1))]
    return t.spark.createDataFrame([(how, r and r["c_custkey"]) for how, r in found], "how string, c_custkey long")


@twin("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (3, 5, 8, 13)")
def find_by_pks(t):
    em = managed(t)
    rows = em.find_by_pks("customer", [3, 5, 8, 13, -4])
    assert em.find_by_pks_map("customer", [3, 5])[5]["c_name"] == next(r["c_name"] for r in rows if r["c_custkey"] == 5) and em.find_by_pks("customer", []) == []
    return told(t, rows, "c_custkey long, c_name string")


@twin("SELECT c_custkey, n FROM (SELECT c_custkey FROM customer WHERE c_nationkey = 5 ORDER BY c_custkey LIMIT 4), (SELECT count(*) AS n FROM customer WHERE c_nationkey = 5)")
def find_and_count(t):
    rows, n = managed(t).find_and_count("customer", where={"c_nationkey": 5}, order=["c_custkey"], take=4)
    return told(t, [r | {"n": n} for r in rows], "c_custkey long, n long")


@twin("SELECT c_name FROM customer WHERE c_nationkey = 6")
def pluck_names(t):
    return told(t, [{"c_name": x} for x in managed(t).pluck("customer", "c_name", where={"c_nationkey": 6})], "c_name string")


@twin("SELECT c_custkey, 'row' AS how FROM customer WHERE c_nationkey = 1 UNION ALL SELECT c_custkey, 'batch' FROM customer WHERE c_nationkey = 2")
def stream_rows(t):
    em = managed(t)
    rows = [r | {"how": "row"} for r in em.stream("customer", where={"c_nationkey": 1})]
    rows += [r | {"how": "batch"} for batch in em.stream_batch("customer", 7, where={"c_nationkey": 2}) for r in batch]
    return told(t, rows, "c_custkey long, how string")


@twin("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 100 GROUP BY c_nationkey")
def manager_query_text(t):
    t.frame("customer").createOrReplaceTempView("customer")
    return managed(t).query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > :least GROUP BY c_nationkey", least=100)


@twin("SELECT CAST(c_nationkey AS BIGINT) AS k, CAST(c_acctbal AS DOUBLE) AS b FROM customer WHERE c_custkey < 50")
def query_with_shape(t):
    from pyspark.sql import types as T

    t.frame("customer").createOrReplaceTempView("customer")
    shape = T.StructType([T.StructField("k", T.LongType()), T.StructField("b", T.DoubleType())])
    return managed(t).query("SELECT c_nationkey AS k, c_acctbal AS b, c_name FROM customer WHERE c_custkey < 50", shape)


@twin("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_nationkey = 4")
def builder_of_manager(t):
    return managed(t).create_query_builder("customer", "c").where("c_acctbal", ">", 5000).where("c.c_nationkey", 4).select("c_custkey", "c_acctbal")


@twin("SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def repository_calls(t):
    rows = managed(t).repository("nation").find(relations=["region"])
    return told(t, [{"r_name": r["region"]["r_name"], "n_name": r["n_name"]} for r in rows if r["region"]["r_name"] != "ASIA"], "r_name string, n_name string")


@twin("""SELECT c_nationkey, count(*) AS n, sum(c_acctbal) AS total, avg(c_acctbal) AS mean, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer WHERE c_nationkey IN (2, 3) GROUP BY c_nationkey""")
def manager_scalars(t):
    em = managed(t)
    out = []
    for k in (2, 3):
        w = {"c_nationkey": k}
        out.append((k, em.count("customer", w), em.sum("customer", "c_acctbal", w), em.avg("customer", "c_acctbal", w), em.min("customer", "c_acctbal", w), em.max("customer", "c_acctbal", w)))
    return t.spark.createDataFrame(out, "c_nationkey int, n long, total double, mean double, lo double, hi double")


@twin("SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 9000) AS rich, EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 1e9) AS richer, EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F') AS done")
def manager_exists(t):
    em = managed(t)
    row = em.exists("customer", {"c_acctbal": {"gt": 9000}}), em.exists("customer", {"c_acctbal": {"gt": 1e9}}), em.create_query_builder("orders").where("o_orderstatus", "F").exists()
    return t.spark.createDataFrame([row], "rich boolean, richer boolean, done boolean")


@twin("SELECT c_mktsegment, c_nationkey FROM customer GROUP BY ALL HAVING count(*) > 0")
def find_group_by(t):
    return managed(t).find_df("customer", group_by=["c_mktsegment", "c_nationkey"])


@twin("SELECT r_name, count(n_nationkey) AS nations_count FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def find_with_count(t):
    return managed(t).find_df("region", with_count=["nations"], select=["r_name"])


# pages


@twin("SELECT c_custkey, total, 3 AS page, CAST(ceil(total / 10) AS BIGINT) AS pages FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 10 OFFSET 20), (SELECT count(*) AS total FROM customer WHERE c_acctbal > 0)")
def find_with_page(t):
    p = managed(t).find_with_page("customer", 3, 10, where={"c_acctbal": {"gt": 0}})
    return told(t, [r | {"total": p.total, "page": p.page, "pages": p.total_pages} for r in p.data], "c_custkey long, total long, page int, pages long")


@twin("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS place FROM (SELECT * FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 45)")
def find_with_cursor(t):
    em, cursor, rows = managed(t), None, []
    for _ in range(3):
        page = em.find_with_cursor("orders", 15, cursor, where={"o_orderstatus": "P"}, order=[("o_totalprice", "desc")])
        rows, cursor = rows + page.data, page.next_cursor
        if cursor is None:
            break
    return told(t, [{"o_orderkey": r["o_orderkey"], "place": i + 1} for i, r in enumerate(rows)], "o_orderkey long, place long")


@twin("SELECT c_custkey, n AS total, true AS more FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 9 ORDER BY c_acctbal, c_custkey LIMIT 7), (SELECT count(*) AS n FROM customer WHERE c_nationkey < 9)")
def paginate_builder(t):
    p = t.entity("customer").where("c_nationkey", "<", 9).order_by("c_acctbal", "c_custkey").paginate(0, 7)
    return told(t, [r | {"total": p.total, "more": p.has_next_page} for r in p.data], "c_custkey long, total long, more boolean")


@twin("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 6 OFFSET 3")
def take_skip(t):
    return t.customer.order_by(("c_acctbal", "desc")).add_order_by("c_custkey").skip(3).take(6).select("c_custkey")


@twin("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def keyset_batches(t):
    p = Pipeline(t.frame("orders").filter("o_orderstatus = 'P'"))
    return p.keyset_map("o_totalprice", "o_orderkey", lambda page: [{"o_orderkey": r["o_orderkey"]} for r in page], "o_orderkey long", 60).df


@twin("SELECT s_suppkey FROM supplier")
def offset_batches(t):
    return Pipeline(t.frame("supplier")).offset_map(["s_suppkey"], lambda page: [{"s_suppkey": r["s_suppkey"]} for r in page], "s_suppkey long", 40).df


@twin("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer WHERE c_nationkey = 2 AND c_acctbal > 0")
def pipeline_map_filter(t):
    p = managed(t).pipe("customer", where={"c_nationkey": 2}).filter(lambda r: r["c_acctbal"] > 0).map(lambda r: {"c_custkey": r["c_custkey"], "twice": r["c_acctbal"] * 2}, "c_custkey long, twice double")
    return p.df


@twin("SELECT c_custkey FROM customer WHERE c_nationkey = 8 UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey = 9 UNION ALL SELECT count(*) FROM customer WHERE c_nationkey = 9")
def pipeline_terminals(t):
    em = managed(t)
    rows = [r for batch in em.pipe("customer", where={"c_nationkey": 8}).map(["c_custkey"]).raw(5) for r in batch]
    nine = em.pipe("customer", where={"c_nationkey": 9}).map(["c_custkey"])
    rows += nine.binary().to_pylist() + [{"c_custkey": nine.count()}]
    assert len(nine.collect()) == nine.count()
    return told(t, rows, "c_custkey long")


# terminals of builders


@twin("""SELECT 'many' AS how, c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'one', (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 3)
UNION ALL SELECT 'fail', (SELECT max(c_custkey) FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'count', (SELECT count(*) FROM customer WHERE c_nationkey = 3)
UNION ALL SELECT 'map', (SELECT min(c_custkey) FROM customer WHERE c_nationkey = 3) UNION ALL SELECT 'pluck', c_custkey FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'raw', c_custkey FROM customer WHERE c_nationkey = 3""")
def builder_terminals(t):
    q = t.customer.where("c_nationkey", 3).order_by("c_custkey")
    many, n = q.get_many_and_count()
    rows = [("many", r["c_custkey"]) for r in many] + [("one", q.get_one()["c_custkey"]), ("fail", q.order_by(("c_custkey", "desc")).get_one_or_fail()["c_custkey"]), ("count", n)]
    rows += [("map", min(q.get_map("c_custkey")))] + [("pluck", x) for x in q.pluck("c_custkey")] + [("raw", r["c_custkey"]) for r in q.get_raw_many()]
    assert q.get_raw_one() == q.get_one() and q.get_exists()
    return t.spark.createDataFrame(rows, "how string, c_custkey long")


@twin("SELECT 'avg' AS how, avg(c_acctbal) AS v FROM customer UNION ALL SELECT 'min', min(c_acctbal) FROM customer UNION ALL SELECT 'max', max(c_acctbal) FROM customer UNION ALL SELECT 'sum', sum(c_acctbal) FROM customer WHERE c_nationkey = 4")
def builder_scalars(t):
    q = t.customer
    rows = [("avg", q.get_avg("c_acctbal")), ("min", q.get_min("c_acctbal")), ("max", q.get_max("c_acctbal")), ("sum", q.where("c_nationkey", 4).get_sum("c_acctbal"))]
    return t.spark.createDataFrame(rows, "how string, v double")


@twin("SELECT c_custkey FROM customer WHERE c_nationkey = 7 UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey = 8 UNION ALL SELECT c_custkey FROM customer WHERE c_nationkey = 9")
def prepared_queries(t):
    run = t.customer.select("c_custkey").prepare(lambda q, k: q.where("c_nationkey", k))
    raw = t.raw("customer").select("c_custkey").from_table("customer").where("c_nationkey = :k").prepare()
    return told(t, run(k=7) + run(k=8) + raw(k=9), "c_custkey long")


@twin("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_nationkey = 5 ORDER BY c_custkey LIMIT 9")
def when_pipe_clone(t):
    q = t.customer.when(True, lambda q: q.where("c_acctbal", ">", 0)).when(False, lambda q: q.where("c_acctbal", "<", 0), lambda q: q.where("c_nationkey", 5))
    other = q.clone().where("c_nationkey", 6)
    assert "c_nationkey" in other.get_sql() and "Scan" in q.explain()
    return q.pipe(lambda q: q.order_by("c_custkey").limit(9).select("c_custkey"))


@twin("SELECT c_custkey FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'MACHINERY'")
def applied_scope(t):
    c = t.catalog()
    c.register(define_entity("customer", {p: Column(k, primary=p == "c_custkey") for p, k in [("c_custkey", "bigint"), ("c_acctbal", "double"), ("c_mktsegment", "text")]}, scopes={"rich": lambda q, least: q.where("c_acctbal", ">", least)}), t.frame("customer"))
    return SelectQuery(c, c.entity("customer"), c.scan("customer").alias("customer"), "customer").apply_scope("rich", 9000).where("c_mktsegment", "MACHINERY").select("c_custkey")


@twin("SELECT c_custkey, CAST(c_acctbal AS DECIMAL(12, 2)) AS c_acctbal FROM customer WHERE c_custkey < 30")
def select_by_schema(t):
    from pyspark.sql import types as T

    shape = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_acctbal", T.DecimalType(12, 2))])
    q = t.customer.where("c_custkey", "<", 30).select_schema(shape)
    rows = q.validate(lambda r: r["c_custkey"] < 30).validate_array(lambda rows: len(rows) > 0).get_many()
    return t.spark.createDataFrame([(r["c_custkey"], r["c_acctbal"]) for r in rows], shape)


@twin("SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey FROM customer ORDER BY c_nationkey, c_acctbal DESC, c_custkey")
def raw_distinct_on(t):
    return t.raw("customer").select_distinct_on(["c_nationkey"], ["c_nationkey", "c_custkey"], ["c_acctbal DESC", "c_custkey"]).from_table("customer")


@twin("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def raw_select_distinct(t):
    return t.raw("customer").select_distinct("c_mktsegment", "c_nationkey").from_table("customer")


@twin("SELECT c_custkey, c_acctbal + 1 AS more FROM customer WHERE (c_nationkey IN (1, 2) AND c_acctbal BETWEEN 0 AND 5000 AND c_name IS NOT NULL) OR c_custkey = 5")
def raw_where_forms(t):
    q = t.raw("customer").select("c_custkey").add_select_expression("c_acctbal + 1 AS more").from_table("customer")
    q = q.where_in("c_nationkey", [1, 2]).where_not_in("c_nationkey", []).where_between("c_acctbal", 0, 5000).where_not_null("c_name")
    return q.or_where("c_custkey = :one", one=5)


@twin("SELECT c_custkey FROM customer WHERE c_mktsegment IS NULL OR (c_nationkey NOT IN (1, 2, 3) AND c_acctbal > 8000)")
def raw_null_forms(t):
    return t.raw("customer").select("c_custkey").from_table("customer").where_not_in("c_nationkey", [1, 2, 3]).and_where("c_acctbal > 8000").or_where("c_mktsegment IS NULL")


@twin("SELECT n_name, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 UNION ALL SELECT n_name, s_suppkey FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey")
def raw_joins(t):
    left = t.raw("nation", "customer").select("n_name", "c_custkey").from_table("nation").left_join("customer", "c_nationkey = n_nationkey AND c_acctbal > :least", least=9900)
    return left.union_all(t.raw("supplier", "nation").select("n_name", "s_suppkey").from_table("supplier").right_join("nation", "s_nationkey = n_nationkey"))


@twin("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def raw_subqueries(t):
    q = t.raw("customer", "orders", "nation").select("c_custkey").from_table("customer")
    q = q.where_exists(RawQuery(t.spark).select("1").from_table("orders").where("o_custkey = c_custkey AND o_totalprice > :p", p=200000))
    return q.where_in_query("c_nationkey", RawQuery(t.spark).select("n_nationkey").from_table("nation").where("n_regionkey = 1"))


@twin("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def raw_not_subqueries(t):
    q = t.raw("customer", "orders", "nation").select("c_custkey").from_table("customer").where_exists(RawQuery(t.spark).select("1").from_table("orders").where("o_custkey = c_custkey AND o_totalprice > 300000"), negate=True)
    return q.where_in_query("c_nationkey", RawQuery(t.spark).select("n_nationkey").from_table("nation").where("n_regionkey = 1"), negate=True)


@twin("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment)) HAVING count(*) > 5")
def raw_grouping_sets(t):
    return t.raw("customer").select("c_nationkey", "c_mktsegment", "count(*) AS n").from_table("customer").group_by("GROUPING SETS ((c_nationkey), (c_mktsegment))").having("count(*) > :n", n=5)


@twin("SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def raw_except(t):
    return t.raw("customer", "orders").select("c_custkey").from_table("customer").where("c_acctbal > 0").except_(RawQuery(t.spark).select("o_custkey").from_table("orders").where("o_totalprice > 300000"))


@twin("SELECT c_custkey FROM customer ORDER BY c_acctbal NULLS FIRST, c_custkey LIMIT 5 OFFSET 2")
def raw_append(t):
    return t.raw("customer").select("c_custkey").from_table("customer").order_by("c_acctbal NULLS FIRST", "c_custkey").append_sql("LIMIT 5 OFFSET 2")


# filters over relations


@twin("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_nationkey < 3) AND o_orderkey < 4000")
def rel_has(t):
    return t.entity("orders").where_has("customer", {"c_nationkey": {"lt": 3}}).where("o_orderkey", "<", 4000).select("o_orderkey")


@twin("""SELECT o_orderkey, NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0) AS orphan FROM orders""")
def rel_is_null(t):
    c = t.catalog()
    entity = c.entity("orders")
    c.register(c.entity("customer"), t.frame("customer").filter("c_acctbal > 0"))
    orders = lambda: SelectQuery(c, entity, c.scan("orders").alias("orders"), "orders")
    none = orders().where({"customer": {"is": None}}).select("o_orderkey", E.lit(True).as_("orphan"))
    return none.union_all(orders().where({"customer": {"isNot": None}}).select("o_orderkey", E.lit(False).as_("orphan")))


@twin("""SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)
OR (c_nationkey < 5 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey))""")
def rel_or_nested(t):
    return t.entity("customer").where({"OR": [{"c_acctbal": {"gt": 9000}}, {"orders": {"some": {"o_totalprice": {"gt": 300000}}}}, {"AND": [{"c_nationkey": {"lt": 5}}, {"orders": {"none": {}}}]}]}).select("c_custkey")


@twin("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def rel_not(t):
    return t.entity("customer").where({"NOT": {"orders": {"some": {"o_orderstatus": "F"}}}}).select("c_custkey")


@twin("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT (o_totalprice > 3000 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 5)))""")
def rel_every_nested(t):
    return t.entity("customer").where({"orders": {"every": {"o_totalprice": {"gt": 3000}, "items": {"some": {"l_quantity": {"gt": 5}}}}}}).select("c_custkey")


@twin("""SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey = p_partkey AND s_nationkey = 3) AND p_size < 10""")
def rel_many_to_many(t):
    return t.entity("part").where({"suppliers": {"some": {"s_nationkey": 3}}, "p_size": {"lt": 10}}).select("p_partkey")


@twin("""SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) ON o_custkey = c_custkey GROUP BY c_custkey""")
def rel_in_count(t):
    return t.entity("customer").with_count("orders", "n", {"items": {"some": {"l_returnflag": "R"}}}).select("c_custkey", "n")


@twin("SELECT n_nationkey, s_suppkey FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def rel_composite_key(t):
    """A relation over a key of two columns."""
    c = t.catalog()
    shop = define_entity("shop", {"nation": Column("int", primary=True), "half": Column("int", primary=True)}, relations={"staff": Relation("one_to_many", "staff", ("s_nationkey", "half"))})
    c.register(shop, t.frame("nation").select(F.col("n_nationkey").alias("nation"), F.explode(F.array(F.lit(0), F.lit(1))).alias("half")))
    c.register(define_entity("staff", {"s_suppkey": Column("bigint", primary=True), "s_nationkey": Column("int"), "half": Column("int")}), t.frame("supplier").withColumn("half", (F.col("s_suppkey") % 2).cast("int")))
    q = SelectQuery(c, shop, c.scan("shop").alias("shop"), "shop").load_relation("staff")
    return query(q.to_df().select(F.col("nation").alias("n_nationkey"), F.explode("staff").alias("x")).select("n_nationkey", F.col("x.s_suppkey").alias("s_suppkey")))


@twin("""SELECT c_custkey FROM customer WHERE c_acctbal > 9500 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def exists_under_or(t):
    dear = exists(t.orders.where("o_totalprice", ">", 400000), {"c_custkey": "o_custkey"})
    return t.customer.where("c_acctbal", ">", 9500).or_where(dear).or_where(not_exists(t.orders, {"c_custkey": "o_custkey"})).select("c_custkey")


@twin("""SELECT n_nationkey, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS has, CASE WHEN NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) THEN 1 ELSE 0 END AS poor FROM nation""")
def exists_in_select(t):
    rich = not_exists(t.customer.where("c_acctbal", ">", 9900), {"n_nationkey": "c_nationkey"})
    return t.nation.select("n_nationkey", exists(t.supplier.where("s_acctbal", ">", 5000), {"n_nationkey": "s_nationkey"}).as_("has"), E.iff(rich, 1, 0).as_("poor"))


# joins of relations


@twin("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def join_and_select(t):
    return query(t.entity("nation").left_join_and_select("region").to_df()).select("n_name", E.Expr(F.col("region.r_name")).as_("r_name"))


@twin("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND r_name LIKE 'A%'")
def inner_join_and_select(t):
    return query(t.entity("nation").inner_join_relation_and_select("region", where={"r_name": {"startsWith": "A"}}).to_df()).select("n_name", E.Expr(F.col("region.r_name")).as_("r_name"))


@twin("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 3")
def inner_join_relation(t):
    return t.entity("customer").inner_join_relation("orders").where("c_nationkey", 3).select("c_custkey", "o_orderkey")


@twin("SELECT p_partkey, count(DISTINCT l_suppkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey WHERE p_partkey < 200 GROUP BY p_partkey")
def many_to_many_load(t):
    rows = t.entity("part").where("p_partkey", "<", 200).load_relation("suppliers").to_df()
    return query(rows.select("p_partkey", F.size("suppliers").cast("bigint").alias("n")))


@twin("SELECT r_name, n_name, count(c_custkey) AS n FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name, n_name")
def nested_relations(t):
    rows = managed(t).find_df("region", relations={"nations": {"relations": ["customers"]}})
    return rows.select("r_name", F.explode("nations").alias("x")).select("r_name", F.col("x.n_name").alias("n_name"), F.size("x.customers").cast("bigint").alias("n"))


@twin("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_totalprice BETWEEN 100000 AND 120000 AND o_orderpriority IN ('1-URGENT', '3-MEDIUM') AND o_orderstatus IS NOT NULL")
def join_on_values(t):
    return t.orders.right_join(t.customer, lambda j: j.on("o_custkey", "=", "c_custkey").on_val_between("o_totalprice", 100000, 120000).on_in("o_orderpriority", ["1-URGENT", "3-MEDIUM"]).on_not_null("o_orderstatus")).select("o_orderkey", "c_custkey")


@twin("SELECT n_nationkey, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment IS NULL")
def join_on_null(t):
    return t.nation.left_join(t.customer, lambda j: j.on("c_nationkey", "=", "n_nationkey").on_null("c_mktsegment")).select("n_nationkey", "c_custkey")


@twin("""SELECT o_orderkey, lo FROM orders LEFT JOIN (SELECT CAST(p_size * 10000 AS DOUBLE) AS lo, CAST(p_size * 10000 + 4000 AS DOUBLE) AS hi FROM part WHERE p_partkey <= 40) ON o_totalprice BETWEEN lo AND hi WHERE o_orderkey < 6000""")
def join_between_left(t):
    bands = t.frame("part").filter("p_partkey <= 40").select((F.col("p_size") * F.lit(10000.0)).alias("lo"), (F.col("p_size") * F.lit(10000.0) + 4000).alias("hi"))
    return t.orders.left_join(bands, lambda j: j.on_between("o_totalprice", "lo", "hi")).where("o_orderkey", "<", 6000).select("o_orderkey", "lo")


@twin("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45 AND p_partkey BETWEEN 1 AND 5000")
def not_between(t):
    return t.part.where(col("p_size").not_between(5, 45)).where_between("p_partkey", 1, 5000).select("p_partkey")


@twin("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 150000")
def except_rows(t):
    return t.customer.select("c_custkey").except_(t.orders.where("o_totalprice", ">", 150000).select("o_custkey"))


@twin("SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal IS NULL")
def where_lists(t):
    return t.customer.where_in("c_mktsegment", ["BUILDING", "MACHINERY"]).or_where(col("c_acctbal").is_null()).select("c_custkey")


@twin("SELECT c_nationkey, count(*) AS n, max(c_acctbal) AS hi FROM customer GROUP BY c_nationkey HAVING max(c_acctbal) > 9000 AND count(*) >= 5")
def having_twice(t):
    return t.customer.group_by("c_nationkey").agg(count().as_("n"), col("c_acctbal").max().as_("hi")).having(col("hi").gt(9000)).having(col("n").gte(5))


@twin("SELECT c_custkey, c_acctbal / 2 AS half FROM customer WHERE c_custkey <= 25")
def select_raw(t):
    return t.customer.where("c_custkey", "<=", 25).select_raw("c_custkey", "c_acctbal / 2 AS half")


@twin("SELECT c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_mktsegment")
def hinted_join(t):
    return t.customer.hint("merge").use_index("none").inner_join(t.nation, lambda j: j.on("c_nationkey", "=", "n_nationkey")).group_by("c_mktsegment").agg(count().as_("n"))


@twin("SELECT c_custkey FROM customer WHERE c_nationkey = 11")
def cached_result(t):
    kept = t.customer.where("c_nationkey", 11).select("c_custkey").cache()
    rows = told(t, kept.get_many(), "c_custkey long")
    kept.source.unpersist()
    return rows


@twin("SELECT current_date = current_date AS d, true AS ts, true AS r")
def clock_and_chance(t):
    return t.region.limit(1).select((E.current_date().eq(E.current_date())).as_("d"), E.current_timestamp().is_not_null().as_("ts"), E.random().lt(1).as_("r"))


# scopes


def scoped(t: Tables):
    """Customers with a deletion mark and a tenant made from their own columns."""
    em = EntityManager(t.spark)
    kinds = {"c_custkey": Column("bigint", primary=True), "c_nationkey": Column("int", role="tenant"), "c_acctbal": Column("double"), "gone": Column("datetime", role="deleted_at")}
    em.register(define_entity("account", kinds), t.frame("customer").select("c_custkey", "c_nationkey", "c_acctbal", F.when(F.col("c_acctbal") < 0, F.expr("TIMESTAMP_NTZ '2024-01-01'")).alias("gone")))
    return em


@twin("SELECT c_custkey, c_acctbal >= 0 AS live FROM customer")
def with_deleted(t):
    return scoped(t).create_query_builder("account").with_deleted().select("c_custkey", col("gone").is_null().as_("live"))


@twin("SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_nationkey = 7 UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal >= 0 AND c_acctbal > 9500")
def tenant_scopes(t):
    em = scoped(t)
    with tenant(7):
        own = em.find_df("account").select("c_custkey")
        rich = em.create_query_builder("account").without_tenant_scope().where("c_acctbal", ">", 9500).select("c_custkey").to_df()
    return own.unionAll(rich)


@twin("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal >= 0 AND c_nationkey IN (1, 2, 3) GROUP BY c_nationkey")
def for_each_tenant(t):
    found = scoped(t).for_each_tenant([1, 2, 3], lambda em: em.count("account"))
    return t.spark.createDataFrame(list(found.items()), "c_nationkey int, n long")


@twin("SELECT n_nationkey, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal >= 0")
def scope_in_on(t):
    """The scope of a joined entity stands in the join, so nations without live customers stay."""
    em = scoped(t)
    return SelectQuery(em.catalog, None, t.frame("nation").alias("nation"), "nation").left_join("account", lambda j: j.on("c_nationkey", "=", "n_nationkey")).select("n_nationkey", "c_custkey")


# writes


def stocked(t: Tables):
    """A written table of 40 parts."""
    em = EntityManager(t.spark, scratch(t.spark))
    em.register(define_entity("item", {"id": Column("bigint", primary=True, generated="increment"), "name": Column("text"), "size": Column("int"), "v": Column("int", role="version"), "gone": Column("datetime", role="deleted_at")}, unique=(("name",),)))
    em.insert_many("item", t.frame("part").filter("p_partkey <= 40").select(F.col("p_partkey").alias("id"), F.concat(F.lit("part "), F.col("p_partkey")).alias("name"), F.col("p_size").cast("int").alias("size"), F.lit(1).alias("v"), F.lit(None).cast("timestamp_ntz").alias("gone")))
    return em


ITEMS = "(SELECT p_partkey AS id, 'part ' || p_partkey AS name, CAST(p_size AS INTEGER) AS size FROM part WHERE p_partkey <= 40)"


@twin(f"SELECT max(id) + 1 AS id, 'new a' AS name, 7 AS size FROM {ITEMS} UNION ALL SELECT max(id) + 2, 'new b', 8 FROM {ITEMS}")
def insert_returning(t):
    em = stocked(t)
    return em.insert_builder("item").values([{"name": "new a", "size": 7}, {"name": "new b", "size": 8}]).execute_and_return().select("id", "name", "size")


@twin(f"SELECT id, name, CASE WHEN id = 3 THEN 100 ELSE 101 END AS size FROM {ITEMS} WHERE id = 3 UNION ALL SELECT 90, 'fresh', 5")
def upsert_returning(t):
    em = stocked(t)
    rows = [{"id": 3, "name": "part 3", "size": 100}, {"id": 90, "name": "fresh", "size": 5}]
    return em.insert_builder("item").values(rows).on_conflict("id").do_update(["size"]).execute_and_return().select("id", "name", "size")


@twin("SELECT 91 AS id, 'only' AS name")
def ignore_returning(t):
    em = stocked(t)
    return em.insert_builder("item").values([{"id": 4, "name": "x"}, {"id": 91, "name": "only"}]).on_conflict("id").do_nothing().execute_and_return().select("id", "name")


@twin(f"SELECT id, size FROM {ITEMS} WHERE id NOT IN (1, 2) UNION ALL SELECT 1, 77 UNION ALL SELECT 2, 78 UNION ALL SELECT 41, 79")
def save_many(t):
    em = stocked(t)
    em.save_many("item", [{"id": 1, "size": 77}, {"id": 2, "size": 78}, {"name": "n", "size": 79}])
    return em.find_df("item", select=["id", "size"])


@twin(f"SELECT id, CASE WHEN id <= 10 THEN size + 5 WHEN id = 20 THEN size - 1 WHEN id = 30 THEN 0 ELSE size END AS size, CASE WHEN id <= 10 OR id IN (20, 30) THEN 2 ELSE 1 END AS v FROM {ITEMS}")
def update_family(t):
    em = stocked(t)
    em.increment("item", {"id": {"lte": 10}}, "size", 5)
    em.decrement("item", {"id": 20}, "size")
    em.update_builder("item").set_raw(size="size * 0").where({"id": 30}).execute()
    return em.find_df("item", select=["id", "size", "v"])


@twin(f"SELECT id FROM {ITEMS} WHERE id > 10 AND id NOT IN (12, 13, 15)")
def delete_family(t):
    em = stocked(t)
    em.delete("item", {"id": {"lte": 10}})
    em.delete_many("item", [12, 13])
    em.remove("item", {"id": 15})
    return em.find_df("item", select=["id"])


@twin(f"SELECT id, id <= 5 AND id <> 2 AS gone FROM {ITEMS}")
def soft_delete_family(t):
    em = stocked(t)
    em.soft_delete("item", {"id": {"lte": 5}})
    em.restore("item", {"id": 2})
    return em.find_df("item", with_deleted=True).select("id", F.col("gone").isNotNull().alias("gone"))


@twin(f"SELECT id, CASE WHEN id = 1 THEN 9 ELSE size END AS size FROM {ITEMS} UNION ALL SELECT 50, 1")
def batch_upsert(t):
    em = stocked(t)
    em.batch_upsert("item", [{"id": 1, "name": "part 1", "size": 9}, {"id": 50, "name": "p", "size": 1}], ["id"])
    em.insert_ignore("item", [{"id": 50, "name": "q", "size": 2}])
    return em.find_df("item", select=["id", "size"])


@twin(f"SELECT id, CASE WHEN id = 7 THEN 70 ELSE size END AS size FROM {ITEMS} WHERE id <> 8 UNION ALL SELECT 60, 6")
def unit_of_work(t):
    em = stocked(t)
    with em.transaction() as work:
        work.persist("item", {"id": 60, "name": "w", "size": 6})
        work.find_one("item", 7)["size"] = 70
        work.remove("item", em.find_by_pk("item", 8))
    return em.find_df("item", select=["id", "size"])


@twin("SELECT count(*) AS n FROM region WHERE false")
def cleared(t):
    em = stocked(t)
    em.clear("item")
    return t.spark.createDataFrame([(em.count("item"),)], "n long")


@twin("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey <= 5 AND l_suppkey <> 3 UNION SELECT 1, 999")
def attach_detach(t):
    links = t.frame("lineitem").filter("l_partkey <= 5").select("l_partkey", "l_suppkey").distinct()
    more = t.spark.createDataFrame([(1, 999), (1, 999)], "l_partkey long, l_suppkey long")
    gone = links.filter("l_suppkey = 3")
    return write.detach(write.attach(links.select(F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long")), more), gone.select(F.col("l_partkey").cast("long"), F.col("l_suppkey").cast("long")))


# catalog


@twin("SELECT column_name AS name FROM (DESCRIBE nation)")
def describe_and_introspect(t):
    t.frame("nation").createOrReplaceTempView("nation")
    assert "nation" in list_tables(t.spark)
    made = introspect(t.frame("nation"), "nation", ["n_nationkey"])
    assert [c["name"] for c in describe_table(t.spark, "nation")] == list(made.columns)
    return t.spark.createDataFrame([(n,) for n in made.columns], "name string")
