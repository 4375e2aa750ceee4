"""Exact duplicates by an extendible-hash index in shared files.

* Every row gives a narrow entry: its row, id, 64-bit key and SHA-256 of the normalised
  text.  Counting entries by key, combined before the shuffle, gives the index.
* The directory has one slot for each prefix of ``depth`` key bits.  Starting from one
  bucket, an overfull bucket doubles its part of the directory and splits by one more
  bit, so a slot names its bucket by as many bits as that needed.  The directory has
  ``2 ** depth`` slots at most, whatever the input.
* The index is written by key ranges, each owned by one task, with the bucket of each key.
* Keys with several entries are chains.  Their texts are fetched and grouped by key and
  whole text, which compares bytes; texts that differ under one key become separate links.

A group of copies of any size meets as one row from each task.  Null texts count as
empty.  Among equal texts the row with the largest id stays (null ids count as the
smallest); of rows that repeat that id as well, exactly one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.llm.columns import fresh, lower_ascii, whole, with_rows
from pairwright.plans.scale import materialize

CAPACITY = 1 << 16  #: keys of a bucket before it splits
DEPTH = 14  #: most bits of the directory


def normalised(text: Column) -> Column:
    return lower_ascii(whole(text))


def _slot(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth)


def directory(keys: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH) -> DataFrame:
    """Slot of each key prefix: ``slot``, and its bucket as ``bits`` and ``address``.

    The bucket of a slot is the shortest prefix of at most ``capacity`` keys, which is
    where splitting overfull buckets bit by bit ends.
    """
    slots = keys.groupBy(_slot(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    slots = materialize(slots, "directory-slots")
    above = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits"))
    above = above.withColumn("address", F.expr(f"shiftrightunsigned(slot, {depth} - bits)"))
    buckets = above.groupBy("bits", "address").agg(F.sum("n").alias("keys"))
    fits = buckets.filter((F.col("keys") <= capacity) | (F.col("bits") == depth))
    return (
        above.join(fits, ["bits", "address"])
        .groupBy("slot")
        .agg(F.min(F.struct("bits", "address", "keys")).alias("bucket"))
        .select("slot", "bucket.*")
    )


def build_index(entries: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH) -> DataFrame:
    """One row for each key: its bucket and number of entries, in files by key ranges."""
    keys = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "keys")
    slots = materialize(directory(keys, capacity, depth), "directory")
    placed = keys.withColumn("slot", _slot(F.col("key"), depth)).join(slots.drop("keys"), "slot").drop("slot")
    return materialize(placed.repartitionByRange("key").sortWithinPartitions("key"), "hash-index")


def groups(docs: DataFrame, row: str | None = None, capacity: int = CAPACITY, depth: int = DEPTH) -> DataFrame:
    """For every row: doc_id, keep_id, group_size, kept, text_sha256, and ``row``.

    ``row`` names a column that tells rows apart; without one they get a number.
    """
    text = normalised(F.col("text"))
    tagged = docs.withColumn("row", F.col(row)) if row else with_rows(docs)
    base = tagged.select("row", "doc_id", text.alias("norm"))
    hashed = base.select("row", "doc_id", F.xxhash64("norm").alias("key"), F.sha2("norm", 256).alias("digest"))
    entries = materialize(hashed, "entries")
    chained = build_index(entries, capacity, depth).filter(F.col("n") > 1).select("key")
    several = materialize(entries.join(chained, "key", "left_semi"), "chained-entries")
    own = several.groupBy("key", "digest").agg(
        F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep")
    )
    # bytes: equal texts of a key meet as grouping keys, which compare whole values
    # a share of all rows, so not broadcast at one size and shuffled at the next
    ids = several.select(F.col("doc_id").alias("id")).distinct().hint("merge")
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")
    texts = texts.select(normalised(F.col("text")).alias("norm"))
    links = texts.groupBy(F.xxhash64("norm").alias("key"), "norm").agg(F.count(F.lit(1)).alias("same_bytes"))
    links = links.select("key", F.sha2("norm", 256).alias("digest"), "same_bytes")
    agreed = own.join(links, ["key", "digest"]).withColumn(
        "group_size",
        F.when(F.col("group_size") == F.col("same_bytes"), F.col("group_size")).otherwise(
            F.raise_error(F.lit("texts with one digest differ in their bytes")).cast("long")
        ),
    )
    agreed = materialize(agreed.select("key", "digest", "group_size", "keep"), "chains")
    found = entries.join(agreed, ["key", "digest"], "left")
    alone = F.col("keep").isNull()
    return found.select(
        "row",
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep.row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows that stay, with their columns."""
    row = fresh(docs, "row_number")
    tagged = with_rows(docs, row)
    stay = groups(tagged, row).filter("kept").select(F.col("row").alias(row))
    return tagged.join(materialize(stay, "kept-rows").hint("merge"), row, "left_semi").select(*docs.columns)


SQL = """
WITH norm AS (
    SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM norm WINDOW same AS (PARTITION BY t)
"""
