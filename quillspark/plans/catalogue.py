"""Queries over the test tables, one for each group of operators, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import expr as E
from quillspark.functions.expr import Expr, case, col, count, iff, json_path, window
from quillspark.operators import paging, relations, write
from quillspark.plans.query import SelectQuery, query
from quillspark.plans.raw import RawQuery
from quillspark.sources.catalog import Catalog, tenant
from quillspark.sources.entity import Column, Inheritance, Relation, define_entity

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def twin(sql: str):
    """Register a query, a function of a table opener, with its SQL."""

    def add(f: Callable[[Tables], DataFrame | SelectQuery]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(Tables(spark, sf_dir))
            return out.to_df() if isinstance(out, (SelectQuery, RawQuery)) else out

        run.__name__ = f.__name__
        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> SelectQuery:
        if name not in TABLES:
            raise AttributeError(name)
        return query(self.frame(name), name)

    def frame(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def raw(self, *names: str) -> RawQuery:
        for n in names:
            self.frame(n).createOrReplaceTempView(n)
        return RawQuery(self.spark)

    def catalog(self) -> Catalog:
        """customer 1:N orders 1:N lineitem; nation N:1 region; part M:N supplier through lineitem."""
        c = Catalog(self.spark)
        plain = lambda name, key, kinds, **more: c.register(define_entity(name, {p: Column(k, primary=p == key) for p, k in kinds.items()}, **more), self.frame(name))
        plain("region", "r_regionkey", {"r_regionkey": "int", "r_name": "text"}, relations={"nations": Relation("one_to_many", "nation", "n_regionkey")})
        plain("nation", "n_nationkey", {"n_nationkey": "int", "n_name": "text", "n_regionkey": "int"}, relations={"region": Relation("many_to_one", "region", "n_regionkey"), "customers": Relation("one_to_many", "customer", "c_nationkey")})
        plain("customer", "c_custkey", {"c_custkey": "bigint", "c_name": "text", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "text"}, relations={"orders": Relation("one_to_many", "orders", "o_custkey"), "nation": Relation("many_to_one", "nation", "c_nationkey")})
        plain("orders", "o_orderkey", {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "text", "o_totalprice": "double", "o_orderdate": "datetime", "o_orderpriority": "text"}, relations={"customer": Relation("many_to_one", "customer", "o_custkey"), "items": Relation("one_to_many", "lineitem", "l_orderkey")})
        plain("lineitem", "l_orderkey", {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_quantity": "double", "l_returnflag": "text"})
        plain("part", "p_partkey", {"p_partkey": "bigint", "p_name": "text", "p_brand": "text", "p_size": "int"}, relations={"suppliers": Relation("many_to_many", "supplier", through="bridge", through_own="l_partkey", through_other="l_suppkey")})
        plain("supplier", "s_suppkey", {"s_suppkey": "bigint", "s_name": "text", "s_nationkey": "int"})
        c.register(define_entity("bridge", {"l_partkey": Column("bigint", primary=True), "l_suppkey": Column("bigint", primary=True)}), self.frame("lineitem"))
        return c

    def entity(self, name: str) -> SelectQuery:
        c = self.catalog()
        return SelectQuery(c, c.entity(name), c.scan(name).alias(name), name)


# the flagship


@twin("""SELECT c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS revenue, round(avg(o_totalprice), 2) AS mean
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY revenue DESC LIMIT 10""")
def flagship_segment_revenue(t):
    return (
        t.orders.where("o_totalprice", ">", 1000).inner_join(t.customer, lambda j: j.on("o_custkey", "=", "c_custkey"))
        .group_by("c_mktsegment").agg(count().as_("n_orders"), col("o_totalprice").sum().round(2).as_("revenue"), col("o_totalprice").avg().round(2).as_("mean"))
        .having(col("n_orders").gt(10)).order_by(("revenue", "desc")).limit(10)
    )


# filters


@twin("SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 200000 AND o_orderstatus <> 'P' AND o_orderpriority LIKE '1%' AND NOT (o_orderkey <= 100)")
def where_ops(t):
    return t.orders.where("o_totalprice", ">=", 1000).where("o_totalprice", "<", 200000).and_where("o_orderstatus", "<>", "P").where_like("o_orderpriority", "1%").where(E.not_(col("o_orderkey").lte(100))).select("o_orderkey")


@twin("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND (o_totalprice > 100000 OR o_orderpriority IN ('1-URGENT', '2-HIGH'))) OR o_orderkey BETWEEN 10 AND 20")
def where_or_group(t):
    return t.orders.where("o_orderstatus", "F").and_where_group(lambda g: g.where("o_totalprice", ">", 100000).or_where(col("o_orderpriority").in_(["1-URGENT", "2-HIGH"]))).or_where_group(lambda g: g.where_between("o_orderkey", 10, 20)).select("o_orderkey")


@twin("SELECT p_partkey FROM part WHERE 1 = 1 AND p_size IN (1, 5, 9) AND p_size NOT IN (5) UNION ALL SELECT p_partkey FROM part WHERE 1 = 0")
def where_in_empty(t):
    return t.part.where_not_in("p_size", []).where_in("p_size", [1, 5, 9]).where_not_in("p_size", [5]).select("p_partkey").union_all(t.part.where_in("p_size", []).select("p_partkey"))


@twin("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 15 AND p_retailprice NOT BETWEEN 920 AND 960")
def where_between(t):
    return t.part.where_between("p_size", 5, 15).where(col("p_retailprice").not_between(920, 960)).select("p_partkey")


@twin("SELECT n_nationkey, c_custkey FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 WHERE c_custkey IS NULL OR (c_custkey IS NOT NULL AND c_acctbal > 9500)")
def where_null(t):
    return t.nation.left_join(t.customer.to_df(), lambda j: j.on("c_nationkey", "=", "n_nationkey").on_val("c_acctbal", ">", 9000)).where_null("c_custkey").or_where(col("c_custkey").is_not_null().and_(col("c_acctbal").gt(9500))).select("n_nationkey", "c_custkey")


@twin("""SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal >= 0 AND c_acctbal < 5000 AND c_nationkey IN (1, 2, 3, 4)) OR (NOT (c_mktsegment LIKE 'A%') AND c_name LIKE '%7')""")
def where_dict(t):
    return t.entity("customer").where({"OR": [{"c_mktsegment": "BUILDING", "c_acctbal": {"gte": 0, "lt": 5000}, "c_nationkey": [1, 2, 3, 4]}, {"NOT": {"c_mktsegment": {"startsWith": "A"}}, "c_name": {"endsWith": "7"}}]}).select("c_custkey")


@twin("""SELECT p_partkey, starts_with(p_name, 'a') AS a, ends_with(p_type, 'L') AS b, contains(p_name, 'e') AS c, lower(p_brand) = lower('BRAND#11') AS d, p_name ILIKE '%A%' AS e,
contains(lower(p_name), 'ar') AS f, starts_with(lower(p_type), 's') AS g, ends_with(lower(p_type), 'el') AS h, p_name NOT LIKE '%z%' AS i FROM part""")
def like_contains_ci(t):
    n, k = col("p_name"), col("p_type")
    return t.part.select("p_partkey", n.starts_with("a").as_("a"), k.ends_with("L").as_("b"), n.contains("e").as_("c"), col("p_brand").equals_ignore_case("BRAND#11").as_("d"), n.ilike("%A%").as_("e"), n.contains_ignore_case("AR").as_("f"), k.starts_with_ignore_case("S").as_("g"), k.ends_with_ignore_case("EL").as_("h"), n.not_like("%z%").as_("i"))


@twin("SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '[0-9]*[02468]$') AND regexp_matches(c_mktsegment, 'b.*g', 'i')")
def regex_match(t):
    return t.customer.where(col("c_name").matches("[0-9]*[02468]$")).where(col("c_mktsegment").matches("b.*g", "i")).select("c_custkey")


@twin("SELECT o_orderkey FROM orders WHERE (o_orderstatus, o_orderpriority) IN (('F', '1-URGENT'), ('O', '5-LOW')) AND (o_orderstatus, o_orderkey) NOT IN (('F', 1), ('O', 2))")
def tuple_in(t):
    return t.orders.where(E.tuple_("o_orderstatus", "o_orderpriority").in_([("F", "1-URGENT"), ("O", "5-LOW")])).where(E.tuple_("o_orderstatus", "o_orderkey").not_in([("F", 1), ("O", 2)])).select("o_orderkey")


@twin("SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])the([^\\p{L}\\p{N}_]|$)') AND regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])of([^\\p{L}\\p{N}_]|$)')")
def fulltext_tokens(t):
    return t.documents.where(col("text").match_against("the of")).select("doc_id")


# joins


@twin("""SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3 UNION ALL
SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3 UNION ALL SELECT n_name, r_name FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey AND n_nationkey < 9""")
def join_inner_left_right(t):
    on = lambda j: j.on("n_regionkey", "=", "r_regionkey")
    some = lambda q: q.select("n_name", "r_name")
    left = some(t.nation.inner_join(t.region, lambda j: on(j).on_val("r_regionkey", "<", 3))).union_all(some(t.nation.left_join(t.region, lambda j: on(j).on_val("r_regionkey", "<", 3))))
    return left.unionAll(some(t.nation.right_join(t.region, lambda j: on(j).on_val("n_nationkey", "<", 9))).to_df())


@twin("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(t):
    return query(t.frame("nation"), "a").inner_join(t.frame("nation").alias("b"), lambda j: j.on("a.n_regionkey", "=", "b.n_regionkey").and_on("a.n_nationkey", "<", "b.n_nationkey")).select(col("a.n_name").as_("x"), col("b.n_name").as_("y"))


@twin("""SELECT p_partkey, b.id AS band FROM part JOIN (SELECT range AS id, range * 150.0 + 800 AS low, range * 150.0 + 960 AS high FROM range(8)) b ON p_retailprice BETWEEN b.low AND b.high""")
def join_range_between(t):
    bands = t.spark.range(8).select("id", (F.col("id") * 150.0 + 800).alias("low"), (F.col("id") * 150.0 + 960).alias("high"))
    return t.part.inner_join(bands, lambda j: j.on_between("p_retailprice", "low", "high")).select("p_partkey", col("id").as_("band"))


@twin("SELECT n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name IN ('ASIA', 'EUROPE') AND r_name IS NOT NULL")
def join_on_literal(t):
    return t.nation.left_join(t.region, lambda j: j.on("n_regionkey", "=", "r_regionkey").on_in("r_name", ["ASIA", "EUROPE"]).on_not_null("r_name")).select("n_name", "r_name")


@twin("""SELECT r_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""")
def join_five_way(t):
    q = t.lineitem.inner_join(t.orders, lambda j: j.on("l_orderkey", "=", "o_orderkey")).inner_join(t.customer, lambda j: j.on("o_custkey", "=", "c_custkey"))
    q = q.inner_join(t.nation, lambda j: j.on("c_nationkey", "=", "n_nationkey")).inner_join(t.region, lambda j: j.on("n_regionkey", "=", "r_regionkey"))
    return q.group_by("r_name").agg(count().as_("n"), col("l_extendedprice").mul(E.lit(1).sub(col("l_discount"))).sum().round(2).as_("revenue"))


@twin("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
def semi_exists(t):
    return t.customer.where_exists(t.orders.where("o_totalprice", ">", 100000), col("o_custkey").eq(col("c_custkey"))).select("c_custkey")


@twin("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_not_exists(t):
    return t.customer.where_not_exists(t.orders.where("o_orderstatus", "F"), col("o_custkey").eq(col("c_custkey"))).select("c_custkey")


@twin("""SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) UNION ALL
SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT CASE WHEN c_acctbal > 0 THEN c_nationkey END FROM customer) UNION ALL SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE false)""")
def not_in_null_aware(t):
    keys = lambda q: t.nation.where_not_in_subquery("n_nationkey", q).select("n_nationkey")
    one = keys(t.customer.where("c_acctbal", ">", 9000).select("c_nationkey"))
    two = keys(t.customer.select(iff(col("c_acctbal").gt(0), col("c_nationkey"), None).as_("k")))
    return one.union_all(two).unionAll(keys(t.customer.where(E.lit(False)).select("c_nationkey")).to_df())


@twin("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def in_and_scalar_subquery(t):
    mean = t.orders.agg(col("o_totalprice").avg().as_("m"))
    return t.orders.where_in_subquery("o_custkey", t.customer.where("c_mktsegment", "BUILDING").select("c_custkey")).where(col("o_totalprice").gt(mean)).select("o_orderkey")


@twin("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
def scalar_subquery_count(t):
    counts = t.orders.group_by("o_custkey").agg(count().as_("n"))
    return t.customer.add_select_subquery(counts, "n", on=("c_custkey", "o_custkey"), default=0).select("c_custkey", "n")


@twin("SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_max_per_group(t):
    top = t.orders.group_by(col("o_custkey").as_("k")).agg(col("o_totalprice").max().as_("top"))
    return t.orders.inner_join(top, lambda j: j.on("o_custkey", "=", "k").on("o_totalprice", "=", "top")).select("o_orderkey")


# aggregates


@twin("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, round(avg(l_extendedprice), 4) AS p, min(l_discount) AS lo, max(l_tax) AS hi FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def agg_basic(t):
    return t.lineitem.where(col("l_shipdate").lte(E.raw_expr("TIMESTAMP_NTZ '1998-09-02'"))).group_by("l_returnflag", "l_linestatus").agg(count().as_("n"), col("l_quantity").sum().round(2).as_("q"), col("l_extendedprice").avg().round(4).as_("p"), col("l_discount").min().as_("lo"), col("l_tax").max().as_("hi"))


@twin("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS s, round(avg(DISTINCT l_quantity), 6) AS a FROM lineitem GROUP BY l_returnflag")
def agg_distinct(t):
    return t.lineitem.group_by("l_returnflag").agg(col("l_partkey").count_distinct().as_("parts"), col("l_linenumber").sum().distinct().as_("s"), col("l_quantity").avg().distinct().round(6).as_("a"))


@twin("""SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o, count(DISTINCT o_custkey) FILTER (WHERE o_totalprice > 100000) AS rich, count(o_orderkey) FILTER (WHERE o_totalprice < 50000) AS low FROM orders GROUP BY o_orderpriority""")
def agg_filter(t):
    return t.orders.group_by("o_orderpriority").agg(count().filter(col("o_orderstatus").eq("F")).as_("f"), col("o_totalprice").sum_if(col("o_orderstatus").eq("O")).round(2).as_("o"), col("o_custkey").count_distinct().filter(col("o_totalprice").gt(100000)).as_("rich"), col("o_orderkey").count_if(col("o_totalprice").lt(50000)).as_("low"))


@twin("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 2 * avg(o_totalprice) AND count(*) > 3")
def agg_having_agg_vs_agg(t):
    return t.orders.group_by("o_custkey").agg(count().as_("n"), col("o_totalprice").max().as_("hi"), col("o_totalprice").avg().as_("m")).having(col("hi").gt(col("m").mul(2))).having(col("n").gt(3)).select("o_custkey", "n")


@twin("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.5), 6) AS med, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10d FROM lineitem GROUP BY l_returnflag""")
def agg_percentile_cont(t):
    return t.lineitem.group_by("l_returnflag").agg(E.percentile_cont(0.5, "l_quantity").round(6).as_("med"), E.percentile_cont(0.9, "l_extendedprice").round(4).as_("p90"), E.percentile_cont(0.9, "l_extendedprice").desc().round(4).as_("p10d"))


@twin("SELECT p_brand, quantile_disc(p_size, 0.5) AS med, quantile_disc(p_size, 0.25) AS q1 FROM part GROUP BY p_brand")
def agg_percentile_disc(t):
    return t.part.group_by("p_brand").agg(E.percentile_disc(0.5, "p_size").cast("int").as_("med"), E.percentile_disc(0.25, "p_size").cast("int").as_("q1"))


@twin("""WITH c AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS k FROM c) SELECT p_brand, p_size AS m FROM r WHERE k = 1""")
def agg_mode(t):
    return t.part.group_by("p_brand").agg(E.mode("p_size").as_("m"))


@twin("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_totalprice > 100000 AS big, count(*) AS n FROM orders GROUP BY 1, 2")
def group_by_expression(t):
    return t.orders.group_by(col("o_orderdate").year().as_("y"), col("o_totalprice").gt(100000).as_("big")).agg(count().as_("n"))


@twin("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_two_cols(t):
    return t.orders.rollup("o_orderstatus", "o_orderpriority").agg(count().as_("n"))


@twin("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def grouping_sets(t):
    return t.raw("orders").select("o_orderstatus", "o_orderpriority", "count(*) AS n").from_table("orders").group_by("GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")


@twin("""SELECT CAST(year(o_orderdate) AS INTEGER) AS y, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS f, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END), 2) AS o FROM orders GROUP BY 1""")
def pivot_case_sum(t):
    part = lambda s: iff(col("o_orderstatus").eq(s), col("o_totalprice"), 0.0).sum().round(2)
    return t.orders.group_by(col("o_orderdate").year().as_("y")).agg(part("F").as_("f"), part("O").as_("o"))


@twin("""SELECT 'count' AS what, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_totalprice > 1e5 UNION ALL SELECT 'sum', round(coalesce(sum(o_totalprice), 0), 2) FROM orders WHERE o_totalprice < 0 UNION ALL
SELECT 'max', max(o_totalprice) FROM orders UNION ALL SELECT 'agg_count_distinct_o_custkey', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders""")
def scalar_terminals(t):
    n = t.orders.where("o_totalprice", ">", 1e5).get_count()
    named = t.orders.select_aggregates(("count_distinct", "o_custkey")).to_df()
    label = named.columns[0]
    rows = [("count", float(n)), ("sum", float(t.orders.where("o_totalprice", "<", 0).get_sum("o_totalprice"))), ("max", t.orders.get_max("o_totalprice"))]
    return t.spark.createDataFrame(rows, "what string, v double").unionAll(named.select(F.lit(label), F.col(label).cast("double")))


# windows and pages

_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


def _by_customer():
    return window().partition_by("o_custkey").order_by("o_orderdate", "o_orderkey")


@twin(f"SELECT o_orderkey, CAST(row_number() {_W} AS INTEGER) AS rn, CAST(ntile(3) {_W} AS INTEGER) AS nt, round(percent_rank() {_W}, 6) AS pr, round(cume_dist() {_W}, 6) AS cd FROM orders")
def win_row_number_ntile(t):
    w = _by_customer()
    return t.orders.select("o_orderkey", E.row_number().over(w).as_("rn"), E.ntile(3).over(w).as_("nt"), E.percent_rank().over(w).round(6).as_("pr"), E.cume_dist().over(w).round(6).as_("cd"))


@twin("SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS INTEGER) AS d FROM part")
def win_rank_dense(t):
    w = window().partition_by("p_brand").order_by(("p_size", "desc"))
    return t.part.select("p_partkey", E.rank().over(w).as_("r"), E.dense_rank().over(w).as_("d"))


@twin(f"SELECT o_orderkey, lag(o_totalprice) {_W} AS a, lead(o_totalprice, 2, -1.0) {_W} AS b FROM orders")
def win_lag_lead(t):
    w = _by_customer()
    return t.orders.select("o_orderkey", E.lag("o_totalprice").over(w).as_("a"), E.lead("o_totalprice", 2, -1.0).over(w).as_("b"))


@twin(f"SELECT o_orderkey, first_value(o_orderkey) {_W} AS f, last_value(o_orderkey) {_W} AS l, nth_value(o_orderkey, 2) {_W} AS n FROM orders")
def win_first_last_nth(t):
    w = _by_customer()
    return t.orders.select("o_orderkey", E.first_value("o_orderkey").over(w).as_("f"), E.last_value("o_orderkey").over(w).as_("l"), E.nth_value("o_orderkey", 2).over(w).as_("n"))


@twin(f"""SELECT o_orderkey, round(sum(o_totalprice) {_W}, 2) AS s, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS a,
count(*) OVER (PARTITION BY o_custkey) AS n FROM orders""")
def win_running_rolling(t):
    w = _by_customer()
    return t.orders.select("o_orderkey", col("o_totalprice").sum().over(w).round(2).as_("s"), col("o_totalprice").avg().over(w.rows_between("2 PRECEDING", "CURRENT ROW")).round(4).as_("a"), count().over(window().partition_by("o_custkey")).as_("n"))


@twin("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM part")
def win_range_frame(t):
    return t.part.select("p_partkey", count().over(window().partition_by("p_brand").order_by("p_size").range_between("5 PRECEDING", "5 FOLLOWING")).as_("n"))


@twin("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def topn_per_group(t):
    return relations.page_each_parent(t.frame("orders"), "o_custkey", [("o_totalprice", "desc"), "o_orderkey"], 3).select("o_custkey", "o_orderkey")


@twin("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey")
def distinct_on_latest(t):
    return t.orders.select("o_custkey", "o_orderkey", "o_orderdate").distinct_on("o_custkey").order_by("o_custkey", ("o_orderdate", "desc"), "o_orderkey")


@twin("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_offset(t):
    return t.orders.select("o_orderkey", "o_totalprice").order_by(("o_totalprice", "desc"), "o_orderkey").offset(50).limit(25)


@twin("SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1995-06-01', 100) ORDER BY o_orderdate, o_orderkey LIMIT 30")
def keyset_page(t):
    import datetime

    after = paging.after_cursor([("o_orderdate", False), ("o_orderkey", False)], paging.decode_cursor(paging.encode_cursor([datetime.datetime(1995, 6, 1), 100])))
    return t.orders.where(after).order_by("o_orderdate", "o_orderkey").limit(30).select("o_orderkey", "o_orderdate")


@twin("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def select_distinct(t):
    return t.orders.select({"o_orderstatus": True, "o_orderpriority": True, "o_custkey": False}).distinct()


@twin("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS b FROM customer ORDER BY b DESC NULLS LAST, c_custkey LIMIT 20")
def order_nulls_last(t):
    return t.customer.select("c_custkey", iff(col("c_acctbal").lt(0), None, col("c_acctbal")).as_("b")).order_by(col("b").desc().nulls_last(), "c_custkey").limit(20)


@twin("SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS s FROM orders WHERE o_orderkey < 500")
def raw_select_with_window(t):
    return t.raw("orders").select_with_window(["o_orderkey"], [{"expr": "sum(o_totalprice)", "over": "PARTITION BY o_custkey", "alias": "s"}]).from_table("orders").where("o_orderkey < :most", most=500)


# sets, common tables


@twin("SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region")
def union_(t):
    return t.nation.select(col("n_regionkey").as_("k")).union(t.region.select("r_regionkey"))


@twin("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region")
def union_all(t):
    return t.nation.select(col("n_regionkey").as_("k")).union_all(t.region.select("r_regionkey"))


@twin("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect_(t):
    return t.customer.select(col("c_nationkey").as_("k")).intersect(t.supplier.select("s_nationkey"))


@twin("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey > 10")
def except_(t):
    return t.nation.select(col("n_nationkey").as_("k")).except_(t.supplier.where("s_nationkey", ">", 10).select("s_nationkey"))


@twin("WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n FROM big JOIN customer ON c_custkey = o_custkey WHERE s > 300000 GROUP BY c_mktsegment")
def cte(t):
    r = t.raw("orders", "customer")
    return r.with_("big", r.select("o_custkey", "sum(o_totalprice) AS s").from_table("orders").group_by("o_custkey")).select("c_mktsegment", "count(*) AS n").from_table("big").inner_join("customer", "c_custkey = o_custkey").where("s > :least", least=300000).group_by("c_mktsegment")


@twin("""WITH RECURSIVE tree(id, parent, depth) AS (SELECT r_regionkey + 1000, NULL::INT, 0 FROM region UNION ALL SELECT c.id, c.parent, depth + 1 FROM tree t JOIN (SELECT n_nationkey AS id, n_regionkey + 1000 AS parent FROM nation) c ON c.parent = t.id)
SELECT id, parent, depth FROM tree""")
def recursive_tree(t):
    r = t.raw("region", "nation")
    step = "SELECT c.id, c.parent, depth + 1 FROM tree t JOIN (SELECT n_nationkey AS id, n_regionkey + 1000 AS parent FROM nation) c ON c.parent = t.id"
    return r.with_recursive("tree", "SELECT r_regionkey + 1000, CAST(NULL AS INT), 0 FROM region", step, "(id, parent, depth)").select("id", "parent", "depth").from_table("tree")


@twin("SELECT p_brand, p_size FROM part WHERE p_size > 45 UNION SELECT p_brand, p_size FROM part WHERE p_size < 3")
def raw_set_union(t):
    r = t.raw("part").select("p_brand", "p_size").from_table("part")
    return r.where("p_size > 45").union(r.where("p_size < 3"))


# scalars


@twin("""SELECT p_partkey, lower(p_name) AS a, upper(p_name) AS b, trim('  ' || p_brand || ' ') AS c, CAST(length(p_name) AS INTEGER) AS d, substr(p_name, 3, 4) AS e, concat(p_brand, NULL, '-', p_type) AS f, CAST(instr(p_name, 'a') - 1 AS INTEGER) AS g, replace(p_brand, '#', '/') AS h, CAST(p_size AS VARCHAR) AS i FROM part""")
def str_funcs(t):
    n = col("p_name")
    return t.part.select("p_partkey", n.to_lower_case().as_("a"), n.to_upper_case().as_("b"), E.lit("  ").concat(col("p_brand"), " ").trim().as_("c"), n.length().as_("d"), n.substring(2, 6).as_("e"), col("p_brand").concat(None, "-", col("p_type")).as_("f"), n.index_of("a").as_("g"), col("p_brand").replace("#", "/").as_("h"), col("p_size").string_value().as_("i"))


@twin("""SELECT p_partkey, p_size + 1 AS a, p_size - 3 AS b, p_size * 2 AS c, CAST(p_size // 4 AS BIGINT) AS d, p_retailprice / 4 AS e, -(p_size - 20) % 7 AS f, -p_size AS g, abs(p_size - 25) AS h, CAST(floor(p_retailprice) AS BIGINT) AS i, CAST(ceil(p_retailprice) AS BIGINT) AS j, round(p_retailprice, 1) AS k, round(sqrt(p_size), 6) AS l FROM part""")
def num_funcs(t):
    s, p = col("p_size", "int"), col("p_retailprice")
    return t.part.select("p_partkey", s.add(1).as_("a"), s.sub(3).as_("b"), s.mul(2).as_("c"), s.div(4).as_("d"), p.div(4).as_("e"), s.sub(20).neg().mod(7).as_("f"), s.neg().as_("g"), s.sub(25).abs().as_("h"), p.floor().as_("i"), p.ceil().as_("j"), p.round(1).as_("k"), s.sqrt().round(6).as_("l"))


@twin("SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS a, CAST(o_orderkey AS BIGINT) AS b, CAST(o_orderkey AS VARCHAR) AS c, CAST(o_orderkey % 2 AS BOOLEAN) AS d, CAST(o_orderkey AS DOUBLE) AS e FROM orders")
def cast_funcs(t):
    k = col("o_orderkey")
    return t.orders.select("o_orderkey", col("o_totalprice").int_value().as_("a"), k.bigint_value().as_("b"), k.string_value().as_("c"), k.mod(2).boolean_value().as_("d"), k.double_value().as_("e"))


@twin("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'mid' ELSE 'large' END AS a, CASE p_brand WHEN 'Brand#11' THEN 1 WHEN 'Brand#22' THEN 2 END AS b, CASE WHEN p_retailprice > 1000 THEN 'x' ELSE 'y' END AS c,
CASE p_brand WHEN 'Brand#11' THEN 'one' ELSE 'other' END AS d, CASE WHEN p_size >= 40 THEN 'A' WHEN p_size >= 20 THEN 'B' ELSE 'C' END AS e FROM part""")
def case_iff(t):
    s = col("p_size")
    return t.part.select("p_partkey", case().when(s.lt(10)).then("small").when(s.lt(30)).then("mid").otherwise("large").end().as_("a"), case("p_brand").when("Brand#11").then(1).when("Brand#22").then(2).end().as_("b"), iff(col("p_retailprice").gt(1000), "x", "y").as_("c"), E.map_values("p_brand", {"Brand#11": "one"}, "other").as_("d"), E.buckets("p_size", [(40, "A"), (20, "B")], "C").as_("e"))


@twin("""SELECT p_partkey, coalesce(nullif(p_size, 1), 99) AS a, greatest(p_size, 10, NULL) AS b, least(p_size, 40, NULL) AS c FROM part""")
def nullish_greatest_least(t):
    s = col("p_size")
    return t.part.select("p_partkey", s.nullif(1).coalesce(99).as_("a"), E.greatest(s, 10, None).as_("b"), E.least(s, 40, None).as_("c"))


@twin("""SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h, CAST(minute(o_orderdate) AS INTEGER) AS mi, CAST(second(o_orderdate) AS INTEGER) AS s,
CAST(dayofweek(o_orderdate) AS INTEGER) AS dow, CAST(dayofyear(o_orderdate) AS INTEGER) AS doy, CAST(week(o_orderdate) AS INTEGER) AS w, CAST(quarter(o_orderdate) AS INTEGER) AS q FROM orders""")
def date_parts(t):
    d = col("o_orderdate")
    return t.orders.select("o_orderkey", d.year().as_("y"), d.month().as_("m"), d.day().as_("d"), d.hour().as_("h"), d.minute().as_("mi"), d.second().as_("s"), d.day_of_week().as_("dow"), d.day_of_year().as_("doy"), d.week().as_("w"), d.quarter().as_("q"))


@twin("""SELECT o_orderkey, o_orderdate + INTERVAL 1 YEAR AS a, o_orderdate - INTERVAL 2 MONTH AS b, o_orderdate + INTERVAL 10 DAY AS c, o_orderdate + INTERVAL 5 HOUR AS d, o_orderdate - INTERVAL 30 MINUTE AS e, o_orderdate + INTERVAL 90 SECOND AS f FROM orders""")
def date_add(t):
    d = col("o_orderdate")
    return t.orders.select("o_orderkey", d.add_years(1).as_("a"), d.add_months(-2).as_("b"), d.add_days(10).as_("c"), d.add_hours(5).as_("d"), d.add_minutes(-30).as_("e"), d.add_seconds(90).as_("f"))


@twin("""SELECT l_orderkey, l_linenumber, l_partkey, datesub('day', o_orderdate, l_shipdate) AS d, datesub('minute', o_orderdate, l_shipdate) AS m, datesub('hour', o_orderdate, l_shipdate) AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate""")
def date_diff(t):
    diff = lambda u: E.date_diff(u, "l_shipdate", "o_orderdate")
    return t.lineitem.inner_join(t.orders, lambda j: j.on("l_orderkey", "=", "o_orderkey").on("l_shipdate", ">=", "o_orderdate")).select("l_orderkey", "l_linenumber", "l_partkey", diff("day").as_("d"), diff("minute").as_("m"), diff("hour").as_("h"))


@twin("""SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(date_trunc('week', o_orderdate) AS TIMESTAMP) AS w, CAST(date_trunc('quarter', o_orderdate) AS TIMESTAMP) AS q, count(*) AS n FROM orders GROUP BY 1, 2, 3""")
def date_trunc(t):
    cut = lambda u, a: E.date_trunc(u, "o_orderdate").as_(a)
    return t.orders.group_by(cut("month", "m"), cut("week", "w"), cut("quarter", "q")).agg(count().as_("n"))


# JSON and arrays


@twin("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, json_exists(props, '$.k') AS has, json_exists(props, '$.zz') AS none FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) >= 50""")
def json_extract_has_key(t):
    p = json_path("props")
    return t.events.where(p.k.gte(50)).select("event_id", p.k.int_value().as_("k"), p.has_key("k").as_("has"), p.has_key("zz").as_("none"))


_PROFILE = """concat('{"role": "', event_type, '", "tags": ["t', CAST(user_id % 3 AS VARCHAR), '", "all"], "n": ', CAST(user_id AS VARCHAR), ', "items": [{"price": ', CAST(event_id % 90 AS VARCHAR), '}], "gone": null}')"""


def _profile(t) -> SelectQuery:
    return query(t.frame("events").withColumn("profile", F.expr(_PROFILE.replace("VARCHAR", "STRING"))), "events")


@twin(f"""WITH e AS (SELECT *, {_PROFILE} AS profile FROM events) SELECT event_id, json_extract_string(profile, '$.role') AS role, CAST(json_array_length(profile, '$.tags') AS INTEGER) AS n, json_extract_string(profile, '$.tags[0]') = 't1' AS tagged,
CAST(json_extract_string(profile, '$.items[0].price') AS DOUBLE) >= 50 AS dear, user_id % 3 = 2 AS has_t2, true AS nested, 'array' AS kind FROM e WHERE json_extract_string(profile, '$.role') <> 'purchase'""")
def json_paths(t):
    p = json_path("profile")
    return _profile(t).where(p.role.neq("purchase")).select("event_id", p.role.as_("role"), p.tags.array_length().as_("n"), p.path("tags[0]").eq("t1").as_("tagged"), p["items"][0].price.gte(50).as_("dear"), p.tags.contains("t2").as_("has_t2"), p.contains({"tags": ["all"]}).as_("nested"), p.tags.type_of().as_("kind"))


@twin("""SELECT vec_id, list_has_all(list_value(label, label + 1), [3]) AS a, list_has_any(list_value(label, label + 1), [2, 4]) AS b, list_has_all([1, 2, 3], list_value(label, label + 1)) AS c FROM embeddings""")
def array_ops(t):
    q = query(t.frame("embeddings").withColumn("a", F.array("label", F.col("label") + 1)), "e")
    a = col("a")
    return q.select("vec_id", a.array_contains([3]).as_("a"), a.array_overlaps([2, 4]).as_("b"), a.array_contained_by([1, 2, 3]).as_("c"))


# relations


@twin("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders_count, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS done FROM customer")
def rel_with_count(t):
    return t.entity("customer").with_count("orders").with_count("orders", "done", {"o_orderstatus": "F"}).select("c_custkey", "orders_count", "done")


@twin("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def rel_some(t):
    return t.entity("customer").where({"orders": {"some": {"o_totalprice": {"gt": 200000}}}}).select("c_custkey")


@twin("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def rel_none(t):
    return t.entity("customer").where_not_has("orders", {"o_orderstatus": "P"}).select("c_custkey")


@twin("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT coalesce(o_totalprice > 20000, false))")
def rel_every(t):
    return t.entity("customer").where({"orders": {"every": {"o_totalprice": {"gt": 20000}}}}).select("c_custkey")


@twin("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey = 2))")
def rel_is_nested(t):
    return t.entity("orders").where({"customer": {"is": {"nation": {"is": {"n_regionkey": 2}}}}}).select("o_orderkey")


@twin("""SELECT c_custkey, n_name, len(coalesce(os, [])) AS n, coalesce(array_to_string(os, ','), '') AS ids FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS os FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def rel_nested(t):
    q = t.entity("customer").load_relation("orders").load_relation("nation").to_df()
    return q.select("c_custkey", F.col("nation.n_name").alias("n_name"), F.size("orders").cast("bigint").alias("n"), F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("ids"))


@twin("""SELECT c_custkey, coalesce(array_to_string(os, ','), '') AS ids FROM customer LEFT JOIN (SELECT o_custkey, list(o_orderkey ORDER BY k) AS os FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k BETWEEN 2 AND 3 GROUP BY o_custkey) ON o_custkey = c_custkey""")
def rel_page_each_parent(t):
    q = t.entity("customer").load_relation("orders", order=[("o_totalprice", "desc")], take=2, skip=1).to_df()
    return q.select("c_custkey", F.array_join(F.transform("orders", lambda o: o["o_orderkey"].cast("string")), ",").alias("ids"))


@twin("""SELECT p_partkey, count(DISTINCT l_suppkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""")
def rel_many_to_many(t):
    return t.entity("part").with_count("suppliers", "n").select("p_partkey", "n")


@twin("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 5000")
def rel_join_flat(t):
    return t.entity("customer").where("c_acctbal", ">", 5000).left_join_relation("orders").select("c_custkey", "o_orderkey")


# inheritance, scopes


def _payments(t, strategy: str) -> Catalog:
    c = Catalog(t.spark)
    events = t.frame("events")
    base = {"event_id": Column("bigint", primary=True), "user_id": Column("bigint"), "value": Column("double")}
    if strategy == "single":
        c.register(define_entity("event", base | {"event_type": Column("text")}, inheritance=Inheritance("single", discriminator="event_type")), events)
        c.register(define_entity("purchase", base, inheritance=Inheritance("single", "event", "purchase", "event_type")), events)
    elif strategy == "joined":
        c.register(define_entity("event", base, inheritance=Inheritance("joined")), events.select("event_id", "user_id", "value"))
        for kind, prop in (("purchase", "amount"), ("click", "weight")):
            own = events.filter(F.col("event_type") == kind).select("event_id", (F.col("value") * 2).alias(prop))
            c.register(define_entity(kind, {"event_id": Column("bigint", primary=True), prop: Column("double")}, inheritance=Inheritance("joined", "event", kind)), own)
    else:
        c.register(define_entity("event", base, inheritance=Inheritance("concrete", discriminator="kind")), events)
        for kind, prop in (("purchase", "amount"), ("click", "weight")):
            own = events.filter(F.col("event_type") == kind).withColumn(prop, F.col("value") * 2)
            c.register(define_entity(kind, base | {prop: Column("double")}, inheritance=Inheritance("concrete", "event", kind)), own)
    return c


@twin("SELECT event_id, value FROM events WHERE event_type = 'purchase'")
def inherit_sti(t):
    return _payments(t, "single").scan("purchase").select("event_id", "value")


@twin("SELECT event_id, user_id, CASE WHEN event_type = 'purchase' THEN value * 2 END AS amount, CASE WHEN event_type = 'click' THEN value * 2 END AS weight FROM events UNION ALL SELECT event_id, user_id, value * 2, NULL FROM events WHERE event_type = 'purchase'")
def inherit_tpt(t):
    c = _payments(t, "joined")
    return c.scan("event").select("event_id", "user_id", "amount", "weight").unionAll(c.scan("purchase").select("event_id", "user_id", "amount", F.lit(None).cast("double")))


@twin("SELECT event_id, event_type AS kind, CASE WHEN event_type = 'purchase' THEN value * 2 END AS amount, CASE WHEN event_type = 'click' THEN value * 2 END AS weight FROM events WHERE event_type IN ('purchase', 'click')")
def inherit_tpc(t):
    return _payments(t, "concrete").scan("event").select("event_id", "kind", "amount", "weight")


@twin("SELECT o_orderkey, upper(o_orderpriority) || '!' AS label FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT'")
def scopes_soft_delete_tenant_computed(t):
    c = Catalog(t.spark)
    rows = t.frame("orders").withColumn("deleted", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")))
    c.register(define_entity("order", {"id": Column("bigint", "o_orderkey", primary=True), "owner": Column("text", "o_orderpriority", role="tenant"), "deletedAt": Column("datetime", "deleted", role="deleted_at"), "label": Column(compute="upper(owner) || '!'")}), rows)
    with tenant("1-URGENT"):
        return c.scan("order").select(F.col("id").alias("o_orderkey"), "label")


# analytics


@twin("""WITH m AS (SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT m, round(s, 2) AS s, round(s - lag(s) OVER (ORDER BY m), 2) AS delta FROM m""")
def period_over_period(t):
    months = t.orders.group_by(E.date_trunc("month", "o_orderdate").as_("m")).agg(col("o_totalprice").sum().as_("s"))
    # one row a month: a single partition holds few rows at any scale
    return query(months.to_df()).select("m", col("s").round(2).as_("s"), col("s").sub(E.lag("s").over(window().order_by("m"))).round(2).as_("delta"))


@twin("""SELECT event_id, datesub('second', lag(ts) OVER w, ts) AS gap, coalesce(datesub('second', lag(ts) OVER w, ts) > 3600, false) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def gap_detection(t):
    gap = E.date_diff("second", "ts", E.lag("ts").over(window().partition_by("user_id").order_by("ts", "event_id")))
    return t.events.select("event_id", gap.as_("gap"), gap.gt(3600).coalesce(False).as_("fresh"))


@twin("""SELECT user_id, event_type, CAST(sum(datesub('second', ts, nxt)) AS BIGINT) AS seconds FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY 1, 2""")
def time_in_status(t):
    nxt = E.lead("ts").over(window().partition_by("user_id").order_by("ts", "event_id"))
    q = t.events.add_select(nxt, "nxt").to_df()
    return query(q).where_not_null("nxt").group_by("user_id", "event_type").agg(E.date_diff("second", "nxt", "ts").sum().as_("seconds"))


# keyed changes


@twin("""SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 AND s_acctbal < 9000 THEN s_acctbal + 100 ELSE s_acctbal END AS s_acctbal FROM supplier UNION ALL SELECT s_suppkey + 100000, 'new', 100.0 FROM supplier WHERE s_suppkey % 5 = 0""")
def upsert_result(t):
    table = t.frame("supplier").select("s_suppkey", "s_name", "s_acctbal")
    rows = table.filter("s_suppkey % 3 = 0").select("s_suppkey", F.lit("new").alias("s_name"), F.lit(100.0).alias("s_acctbal")).unionAll(table.filter("s_suppkey % 5 = 0").select(F.col("s_suppkey") + 100000, F.lit("new"), F.lit(100.0)))
    return write.upsert(table, rows, ["s_suppkey"], {"s_acctbal": F.col("__old.s_acctbal") + write.excluded("s_acctbal")}, where=F.col("__old.s_acctbal") < 9000)


@twin("SELECT s_suppkey, s_name FROM supplier UNION ALL SELECT 900001, 'x'")
def insert_ignore_result(t):
    table = t.frame("supplier").select("s_suppkey", "s_name")
    rows = table.limit(0).unionAll(t.spark.createDataFrame([(1, "dup"), (900001, "x"), (900001, "x")], "s_suppkey bigint, s_name string"))
    return write.insert_ignore(table, rows, ["s_suppkey"])


@twin("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal FROM customer")
def update_case(t):
    return write.update(t.frame("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), col("c_mktsegment").eq("BUILDING"), {"c_acctbal": col("c_acctbal").mul(2)}).select("c_custkey", "c_acctbal")


@twin("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 7) THEN 'vip' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_limited(t):
    return write.update(t.frame("customer").select("c_custkey", "c_acctbal", "c_mktsegment"), col("c_acctbal").gt(0), {"c_mktsegment": "vip"}, [("c_acctbal", "desc")], 7, ["c_custkey"]).select("c_custkey", "c_mktsegment")


@twin("SELECT o_orderkey FROM orders WHERE NOT coalesce(o_totalprice < 50000, false) AND o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def delete_rows(t):
    rest = write.delete(t.frame("orders"), col("o_totalprice").lt(50000))
    return write.delete_keys(rest, t.frame("orders").filter("o_orderstatus = 'P'").select("o_orderkey"), ["o_orderkey"]).select("o_orderkey")


@twin("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN TIMESTAMP '2020-01-01' END AS gone FROM orders")
def soft_delete_restore(t):
    table = t.frame("orders").select("o_orderkey", "o_orderstatus", F.lit(None).cast("timestamp_ntz").alias("gone"))
    out = write.soft_delete(table, col("o_orderstatus").eq("F"), "gone", F.expr("TIMESTAMP_NTZ '2020-01-01'"))
    return write.restore(out, col("o_orderkey").mod(2).eq(1), "gone").select("o_orderkey", "gone")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from quillspark.plans import managed  # registers its queries here

    return dict(_QUERIES) if managed else {}


def oracle_sql() -> dict[str, str]:
    return {k: _SQL[k] for k in queries() if k in _SQL}


__all__ = ["Expr", "oracle_sql", "queries"]
