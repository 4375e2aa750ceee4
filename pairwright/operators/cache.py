"""Results kept by key: what is stale, and the last write per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_hashes(df: DataFrame, cv: str = "cv_text", jd: str = "jd_text") -> DataFrame:
    """Content hashes in place of the texts."""
    return df.withColumns({"cv_hash": F.sha2(cv, 256), "jd_hash": F.sha2(jd, 256)}).drop(cv, jd)


def uncached_requests(
    requests: DataFrame, cache: DataFrame, cv: str = "cv_text", jd: str = "jd_text"
) -> DataFrame:
    """Requests without a valid cached result.

    A result is valid for the same key and the same CV and JD content.  ``cache``
    holds (key, cv_hash, jd_hash); only hashes are compared.  Missing texts hash
    to NULL and never match.
    """
    keyed = requests.withColumns({"cv_hash": F.sha2(cv, 256), "jd_hash": F.sha2(jd, 256)})
    names = ["key", "cv_hash", "jd_hash"]
    return keyed.join(cache.select(*names), names, "left_anti")


def cache_upsert(cache: DataFrame, writes: DataFrame, version: str = "version") -> DataFrame:
    """The last write of each key; at equal versions a write beats the cache.

    Only the newest row per key leaves a task, however often a key is written.
    """
    newest = Window.partitionBy("key").orderBy(F.desc(version), F.desc("__new"))
    rows = cache.withColumn("__new", F.lit(0)).unionByName(
        writes.withColumn("__new", F.lit(1)), allowMissingColumns=True
    )
    return rows.withColumn("__n", F.row_number().over(newest)).filter("__n = 1").drop("__n", "__new")
