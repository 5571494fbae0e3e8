"""Percentiles and modes worked out apart, against Spark's own aggregates."""

import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import expr as E
from quillspark.operators import ordered_sets
from quillspark.plans.query import query


def shuffled(plan) -> int:
    """Bytes that the exchanges of an executed plan have written."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return shuffled(plan.executedPlan())
    if "QueryStage" in name:
        return shuffled(plan.plan())
    children = plan.children()
    own = plan.metrics().get("dataSize").get().value() if name == "Exchange" else 0
    return own + sum(shuffled(children.apply(i)) for i in range(children.size()))


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    made = [(g, h, r.choice([None, float(r.randint(-5, 5)), r.random() * 100, 3.5]), r.randint(0, 1 << 60), f"t{r.randint(0, 3)}") for g, h, n in [(None, 1, 50), ("a", 1, 1), ("b", 2, 7), ("c", 1, 3000), ("c", 2, 1000)] for _ in range(n)]
    made += [("e", 1, x, 4, None) for x in (float("nan"), 1.0, 2.0, float("inf"))] + [("f", 1, None, 5, "t1")] * 5
    return spark.createDataFrame(made, "g string, h int, x double, l long, t string").repartition(4)


def sets() -> list:
    return [
        E.percentile_cont(0.5, "x").round(3).as_("a"), E.percentile_cont(0.9, "x").desc().as_("b"), E.percentile_disc(0.3, "x").as_("c"), E.percentile_disc(0.1, "l").desc().as_("d"),
        E.percentile_cont(1, "l"), E.percentile_cont(0, "x").as_("e"), E.mode("t").as_("m"), E.mode("t").desc(), E.count().as_("n"), E.percentile_cont(0.75, "x").sub(E.percentile_cont(0.25, "x")).as_("iqr"),
    ]


@pytest.mark.parametrize("keys", [[], ["g"], ["g", "h"]])
@pytest.mark.parametrize("largest, bound", [(1024, None), (2, None), (1024, -1e9), (1024, 1e9), (1024, 3.5)])
def test_same_as_spark(rows, monkeypatch, keys, largest, bound):
    """Groups within and beyond the largest, and bounds that miss the values looked for."""
    want = rows.groupBy(*keys).agg(*[E.column(s) for s in sets()])
    expected = sorted(map(repr, want.collect()))
    monkeypatch.setattr(ordered_sets, "LARGEST", largest)
    if bound is not None:
        monkeypatch.setattr(F, "percentile_approx", lambda *_: F.when(F.count("*") > 0, F.array(*[F.lit(bound)] * 20)))
    got = query(rows).group_by(*keys).agg(*sets()).to_df()
    assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(repr, got.collect())) == expected


def test_few_values_of_a_large_group_move(spark):
    df = spark.range(200_000, numPartitions=4).select(F.lit(1).alias("g"), F.hash("id").cast("double").alias("x"))
    got = query(df).group_by("g").agg(E.percentile_cont(0.5, "x").round(2).as_("p")).to_df()
    assert got.collect() == df.groupBy("g").agg(F.round(F.percentile("x", 0.5), 2)).collect()
    assert shuffled(got._jdf.queryExecution().executedPlan()) < 1_000_000


def test_order_and_having_over_them(rows):
    q = query(rows, "r").group_by("r.g").agg(E.percentile_disc(0.5, "r.x").as_("p")).having(E.col("p").gt(2)).order_by(("p", "desc")).select("r.g", "p")
    want = rows.groupBy("g").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)").alias("p")).filter("p > 2")
    assert sorted(map(repr, q.to_df().collect())) == sorted(map(repr, want.collect()))


def test_rows_that_may_change_between_passes_stay_with_spark(spark):
    for df in (spark.range(100).withColumn("x", F.rand()), spark.range(100).limit(7).withColumn("x", F.lit(1.0))):
        plan = query(df).agg(E.percentile_cont(0.5, "x")).to_df()._jdf.queryExecution().analyzed().toString()
        assert "__hot" not in plan
