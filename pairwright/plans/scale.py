"""Layout helpers shared by the operators.

Any key may own a large share of all rows, so order-dependent operators never
put a whole key into one window or one collected list.  They cut a key into
blocks of consecutive positions, work per (key, block), and carry a small
summary from block to block.  Keys that fit in one block pay almost nothing:
the search for longer ones is a pushed-down filter on the position column.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.functions.rules import int_div

BLOCK = 4096
SEGMENT = 64_000_000  #: characters of a key that one row holds
_BLK = "__block"


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the session's ``spark.checkpoint.dir``.

    A local session without one, as in tests, gets a temporary folder.  A cluster
    session without one is an error: its executors would each write to their own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a shared folder; master is {master}")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pairwright-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/pairwright-{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back.

    For results several branches of one plan need and that cost a pass over the
    texts.  The written table also cuts the lineage: a lost executor re-reads
    the table instead of scanning the texts again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("error").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, key: str, name: str, order: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
    """Write a table dealt out by ``key`` and read it back; its rows are moved once.

    Plans over it that group or join by ``key``, alone or with more columns, need no shuffle of
    it.  ``order`` sorts each bucket, so that repeated values compress.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"pairwright_{name}_{uuid.uuid4().hex}".replace("-", "_")
    rows = df.repartition(n, key)
    writer = rows.write.format("parquet").option("path", scratch_path(spark, name)).option("compression", "zstd")
    writer = writer.bucketBy(n, key)
    (writer.sortBy(*order) if order else writer).saveAsTable(table)
    return spark.table(table)


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that is sorted and merged whatever its size, and never broadcast.

    The planner takes what comes out of an ``explode`` for no larger than what went in, and a
    table for as large as its compressed files, so it broadcasts through the driver what does not fit there.
    """
    return df.hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores on a scan with too few splits for them.

    A scan that already has a split per core, as any large table does, is
    returned as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def long_keys(df: DataFrame, key: str, order: str, block: int = BLOCK) -> DataFrame | None:
    """Keys with positions beyond the first block, or None when there are none.

    The filter on the position reaches the scan, so on a stored table this reads
    hardly more than the file footers.  The keys are written, which gives the
    planner their true size.
    """
    found = materialize(df.filter(F.col(order) >= block).select(key).distinct(), "long-keys")
    return None if found.isEmpty() else found


def carry_forward(
    df: DataFrame,
    key: str,
    order: str,
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """Running values over the rows before each row of its key.

    ``sums`` adds a running total and ``lasts`` the latest non-null value, both
    over strictly earlier rows.  ``order`` is a non-negative integer position,
    unique within the key.

    Where no key is longer than a block, a window per key is enough.  Otherwise
    windows run per (key, block), and only the long keys are summarised per
    block to carry their values on.
    """
    sums, lasts = sums or {}, lasts or {}
    blk = int_div(F.col(order), F.lit(block))
    before = Window.partitionBy(key, _BLK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = {n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()}
    running |= {n: F.last(c, ignorenulls=True).over(before) for n, c in lasts.items()}
    rows = df.withColumn(_BLK, blk).withColumns(running)
    long = long_keys(df, key, order, block)
    if long is None:
        return rows.drop(_BLK)

    per_block = (
        df.join(long, key, "left_semi")
        .groupBy(key, blk.alias(_BLK))
        .agg(
            *[F.sum(c).alias(n) for n, c in sums.items()],
            *[F.max_by(c, F.when(c.isNotNull(), F.col(order))).alias(n) for n, c in lasts.items()],
        )
    )
    earlier = Window.partitionBy(key).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        key,
        _BLK,
        *[F.sum(n).over(earlier).alias("__c_" + n) for n in sums],
        *[F.last(n, ignorenulls=True).over(earlier).alias("__c_" + n) for n in lasts],
    )
    total = {n: F.col(n) + F.coalesce(F.col("__c_" + n), F.lit(0)) for n in sums}
    latest = {n: F.coalesce(F.col(n), F.col("__c_" + n)) for n in lasts}
    return (
        rows.join(carried, [key, _BLK], "left")
        .withColumns(total | latest)
        .drop(_BLK, *["__c_" + n for n in running])
    )


def next_value(
    df: DataFrame, key: str, order: str, value: Column, out: str, block: int = BLOCK
) -> DataFrame:
    """``value`` of the row after each row of its key; NULL after the last."""
    blk = int_div(F.col(order), F.lit(block))
    inside = Window.partitionBy(key, _BLK).orderBy(order)
    held = F.struct(value.alias("v"))
    rows = df.withColumn(_BLK, blk).withColumn("__next", F.lead(held).over(inside))
    long = long_keys(df, key, order, block)
    if long is None:
        return rows.withColumn(out, F.col("__next.v")).drop(_BLK, "__next")

    firsts = (
        df.join(long, key, "left_semi")
        .groupBy(key, blk.alias(_BLK))
        .agg(F.min_by(held, F.col(order)).alias("__first"))
    )
    following = firsts.select(
        key, _BLK, F.lead("__first").over(Window.partitionBy(key).orderBy(_BLK)).alias("__first")
    )
    return (
        rows.join(following, [key, _BLK], "left")
        .withColumn(out, F.coalesce(F.col("__next"), F.col("__first"))["v"])
        .drop(_BLK, "__next", "__first")
    )


def ordered_segments(
    df: DataFrame, key: str, order: str, value: Column, size: Column, out: str, block: int = BLOCK, limit: int = SEGMENT
) -> DataFrame:
    """(key, segment, out): the values of each key as an ordered array.

    A key is one row with ``segment`` 0, however many positions it has and however sparse they are, up to
    ``limit`` of ``size`` in all, such as characters.  Only a key beyond it goes on in
    further segments, in order, so that no row outgrows a task.  Values are first packed
    per block of positions; the blocks of long keys are then put together by their volume.
    """
    blk = int_div(F.col(order), F.lit(block)).cast("bigint")
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    parts = df.groupBy(key, blk.alias(_BLK)).agg(packed.alias("__packed"), F.sum(size).alias("__size"))
    parts = parts.select(key, _BLK, "__size", F.transform("__packed", lambda p: p["v"]).alias(out))
    zero = F.lit(0).cast("bigint")
    long = long_keys(df, key, order, block)
    if long is None:
        return parts.select(key, zero.alias("segment"), out)

    earlier = Window.partitionBy(key).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.join(long, key, "left_semi").select(key, _BLK, "__size")
    placed = materialize(
        sizes.select(key, _BLK, int_div(F.coalesce(F.sum("__size").over(earlier), F.lit(0)), F.lit(limit)).alias("segment")),
        "segments",
    )
    listed = F.sort_array(F.collect_list(F.struct(F.col(_BLK).alias("o"), F.col(out).alias("v"))))
    merged = parts.join(placed, [key, _BLK]).groupBy(key, "segment").agg(listed.alias("__blocks"))
    merged = merged.select(key, "segment", F.flatten(F.transform("__blocks", lambda p: p["v"])).alias(out))
    return parts.join(long, key, "left_anti").select(key, zero.alias("segment"), out).unionByName(merged)
