"""Helpers shared by the corpus operators: table access, shared scratch tables, batch slicing."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stored tables are written in row groups of this size, since a writer holds one in memory for each task.
ROW_GROUP = 32 << 20
#: Bits of an id filter: 16 for each id, and no fewer or more than these powers of two.
LEAST_BITS, MOST_BITS = 20, 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where nothing is set, a session that is one process on one machine (tests, a laptop) gets a folder of that machine; a cluster has
    to set one, since its machines don't share theirs.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: the corpus operators need a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tidewatch-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def stored(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there,
    nothing is computed twice, and a lost executor costs no more than the tasks it ran. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tidewatch/{label}-{uuid.uuid4().hex}"
    df.write.options(**{"parquet.block.size": str(ROW_GROUP)} | (options or {})).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`stored` that no later step reads."""
    path = getattr(df, "stored_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def small_batches(spark: SparkSession, limit: int = 2 << 20) -> None:
    """A batch that goes to Python holds ``limit`` bytes at most (or one row), however long the texts are: it stands in memory
    on both sides of the worker's pipe, for every core. The setting is read when a plan runs, which is after the operator
    has returned, so it can't be put back here; it has one value for all operators, and a smaller one that is set stays."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not (now.isdigit() and 0 < int(now) <= limit):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(limit))


def given_back(parts):
    """The items of an iterator; at its end the worker, which lives on between tasks, returns freed memory to the machine, so that
    the next stage's Java heap finds it."""
    yield from parts
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def columns_of(df: DataFrame) -> list[Column]:
    """Its columns, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def may_be_in(df: DataFrame, key: str, ids: DataFrame, out: str) -> DataFrame:
    """``df`` with a boolean ``out``: false where ``key`` surely isn't among ``ids`` (one column, stored), so that only the
    other rows need a shuffle to know. Null keys are false.

    The ids' hashes go to every task as bitmaps of 2^MOST_BITS bits (32 MB) together at most, whatever the number of ids.
    """
    name = ids.columns[0]
    size = 1 << max(LEAST_BITS, min(MOST_BITS, (16 * ids.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(size)) + 1
    bits = ids.where(F.col(name).isNotNull()).select(place(F.col(name)).alias("p"))
    bits = bits.groupBy(F.bitmap_bucket_number("p").alias(f"{out}_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias(f"{out}_bits"))
    bits = stored(bits, "bits")
    own = place(F.col(key))
    joined = df.withColumn(f"{out}_bucket", F.bitmap_bucket_number(own)).join(F.broadcast(bits), f"{out}_bucket", "left")
    at = F.bitmap_bit_position(own)
    byte = F.conv(F.hex(F.substring(F.col(f"{out}_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    return joined.withColumn(out, F.coalesce(hit & F.col(key).isNotNull(), F.lit(False))).drop(f"{out}_bucket", f"{out}_bits")


def spans(sizes, limit: int):
    """Consecutive row ranges whose sizes sum to ``limit`` at most (a longer row stands alone)."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def fresh(df: DataFrame, base: str) -> str:
    """A prefix that no column has."""
    name = f"__{base}"
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name
