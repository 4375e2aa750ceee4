"""Text columns that several operators share."""

from __future__ import annotations

from itertools import count

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.plans.scale import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text; empty where it is null."""
    return F.coalesce(text, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z, all else as it is.  On pure ASCII the faster general function does the same."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def with_rows(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs`` with a whole number for each row, the same in every scan of it.

    It is made of the row's file and its place in that file, so it does not depend on how
    the files are split, which follows the executors at hand.  ``docs`` is a table read from
    Parquet files or columns or rows of one; any other table is written first.
    """
    try:
        at = docs.metadataColumn("_metadata")
        docs.select(at["row_index"], at["file_path"]).schema
    except AnalysisException:
        docs = materialize(docs, "numbered-rows")
        at = docs.metadataColumn("_metadata")
    files = docs.groupBy(at["file_path"].alias("path")).agg(F.max(at["row_index"]).alias("last"))
    files = materialize(files, "row-files")
    last, n = files.agg(F.coalesce(F.max("last"), F.lit(0)), F.count(F.lit(1))).first()
    bits = max(last.bit_length(), 1)

    def file_part(path: Column, seed: int) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(seed), path), bits + 1)

    # no two files of the table share a number
    seed = next(s for s in count() if files.agg(F.count_distinct(file_part(F.col("path"), s))).first()[0] == n)
    number = F.shiftleft(file_part(at["file_path"], seed), bits).bitwiseOR(at["row_index"])
    return docs.withColumn(name, number)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
