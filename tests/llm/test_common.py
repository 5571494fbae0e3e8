"""Shared storage."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import common


def test_stored_and_cleared(spark):
    df = common.stored(spark.range(5), "t")
    assert df.count() == 5 and df.dtypes == spark.range(5).dtypes
    own = common.stored_tables(spark)[-1]
    other = common.stored(spark.range(3), "t")
    common.clear_stored(spark, [own])
    assert other.count() == 3 and own not in common.stored_tables(spark)
    common.clear_stored(spark)
    assert common.stored_tables(spark) == [] and common.stored(spark.range(2), "t").count() == 2


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: None)

        class sparkContext:
            applicationId, master = "app", "spark://somewhere"

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[2]"
    assert common.shared_dir(Session) == common.shared_dir(Session)


def test_broadcast_only_within_bounds(spark, monkeypatch):
    hinted = lambda df: "BroadcastHashJoin" in spark.range(9).join(df, "id")._jdf.queryExecution().executedPlan().toString()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert hinted(common.sized(spark.range(100), "s"))
        monkeypatch.setattr(common, "BROADCAST_ROWS", 10)
        assert not hinted(common.sized(spark.range(100), "s"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_crc_mod(spark):
    import zlib

    rows = spark.range(20).select("id", common.crc_mod("id", 5).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 5 for r in rows)
    assert spark.sql("SELECT CAST(NULL AS BIGINT) AS id").select(common.crc_mod(F.col("id"), 5)).head()[0] == 0
