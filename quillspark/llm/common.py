"""What the operators share: table access, shared storage, Arrow helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of local sessions without spark.checkpoint.dir, and the tables stored so far, by application.
_folders: dict[str, str] = {}
_tables: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """This session's part of the folder that all executors share: spark.checkpoint.dir.

    Where that is unset, a local session gets a temporary folder; on a cluster
    it is an error, as each machine would write to a disk of its own.
    """
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if app not in _folders:
            _folders[app] = tempfile.mkdtemp(prefix="quillspark-")
            atexit.register(shutil.rmtree, _folders[app], ignore_errors=True)
        found = _folders[app]
    return f"{found.rstrip('/')}/quillspark/{app}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _tables.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_tables(spark: SparkSession) -> list[str]:
    """The paths of this session's stored tables, in order."""
    return list(_tables.get(spark.sparkContext.applicationId, []))


def clear_stored(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Remove this session's stored tables, or those of ``paths``. Results that still read from them must have been written before."""
    own = _tables.get(spark.sparkContext.applicationId, [])
    for p in list(own) if paths is None else paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        if p in own:
            own.remove(p)


#: Bytes and rows of a table that is broadcast at most; larger ones are joined by a shuffle.
BROADCAST_BYTES, BROADCAST_ROWS = 8 << 20, 500_000


def sized(small: DataFrame, name: str) -> DataFrame:
    """Store a table that is probably small, measure it, and mark it for broadcast only within the bounds above."""
    kept = stored(small, name)
    size = F.lit(16)
    for c in kept.columns:
        size = size + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
    rows, size = kept.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).head()
    return F.broadcast(kept) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else kept


def crc_mod(column: str | Column, modulus: int) -> Column:
    """crc32 of a value's text, modulo ``modulus``; null ids count as the empty text."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % modulus


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text of an Arrow string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def helper_names(df: DataFrame, *wanted: str) -> dict[str, str]:
    """A column name for each helper that no column of ``df`` has, whatever its case."""
    taken = {x.lower() for x in df.columns}
    made = {}
    for w in wanted:
        name = f"_{w}"
        while name in taken:
            name = "_" + name
        made[w] = name
        taken.add(name)
    return made


def release_memory(spark: SparkSession | None = None) -> None:
    """Give freed memory back to the system, so that the driver doesn't keep the peak of each training; with a session, the JVM's heap too."""
    if spark is not None:
        spark._jvm.java.lang.System.gc()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
