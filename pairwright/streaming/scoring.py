"""Keep pair scores current as CVs or job descriptions arrive or change.

The state is a folder of tables in which nothing is rewritten.  Each micro-batch is a turn
and writes, in folders named after it, the JDs that changed, the documents that did, their
terms by line, and pair scores.  A replayed batch overwrites its own folders, so the result is
the same.  Every ``COMPACT`` turns the current rows of all four tables go into a
snapshot; a turn reads the last snapshot and the turns since, never all history.  Snapshots are cut
into ``PARTS`` by document or by term, and a turn opens only the parts that its documents
or the key terms of changed JDs fall in.

A turn scores every changed document against all JDs, and every other document
against the changed JDs, from its stored terms.  A pair is therefore current in the
turn where its document or its JD last changed, whichever is later.  A change of the key terms
takes effect with the next batch, or at once by :func:`refresh`; a JD without key terms has
no scores.  All scores of :func:`pairwright.operators.matching.match_score` are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairwright.operators import terms
from pairwright.operators.cache import uncached_requests
from pairwright.operators.matching import OWN, SCORE_COLUMNS, cv_scores, score_lines

COMPACT = 16
PARTS = 64
OUTPUT = ("doc_id", "item_id", *SCORE_COLUMNS, "match_score")
SCHEMAS = {
    "jds": "item_id bigint, jd_hash string, turn bigint",
    "versions": "doc_id bigint, cv_hash string, turn bigint",
    "terms": f"doc_id bigint, line_no int, term string, first boolean, {OWN[0]} bigint, {OWN[1]} bigint, turn bigint",
    "scores": ", ".join(f"{c} bigint" for c in OUTPUT) + ", turn bigint",
}
#: what the snapshot of a table is cut by
CUT = {"versions": "doc_id", "terms": "term"}
Keys = DataFrame | Callable[[SparkSession], DataFrame]


def jd_fingerprints(keys: DataFrame) -> DataFrame:
    """(item_id, jd_hash): one value for the key terms of each JD."""
    return keys.groupBy("item_id").agg(
        F.concat_ws(":", F.count(F.lit(1)), F.bit_xor(F.xxhash64("term", "tf"))).alias("jd_hash")
    )


# --- the folder ----------------------------------------------------------------------------


def _turns(spark: SparkSession, folder: str) -> list[int]:
    """The turns that a folder has subfolders of, by its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(n.removeprefix("turn=")) for n in names if n.startswith("turn="))


class Store:
    """The tables as they are before a turn."""

    def __init__(self, spark: SparkSession, path: str, before: int):
        self.spark, self.path, self.turn = spark, path, before
        snapshots = [t for t in _turns(spark, f"{path}/snapshot/done") if t < before]
        self.base = max(snapshots, default=None)
        since = -1 if self.base is None else self.base
        self.log = [t for t in _turns(spark, f"{path}/jds") if since < t < before]

    def read(self, name: str, cut: DataFrame | None = None) -> DataFrame:
        """Rows of the last snapshot and the turns since; ``cut``, a column of keys, bounds the parts opened."""
        schema = SCHEMAS[name]
        rows = self.spark.createDataFrame([], schema)
        if self.log:
            folders = [f"{self.path}/{name}/turn={t}" for t in self.log]
            rows = self.spark.read.schema(schema).parquet(*folders)
        if self.base is not None:
            folder = f"{self.path}/snapshot/{name}/turn={self.base}"
            held = self.spark.read.schema(schema + (", part int" if name in CUT else "")).parquet(folder)
            if cut is not None:
                opened = [r[0] for r in cut.select(_part(cut.columns[0])).distinct().collect()]  # PARTS at most
                held = held.filter(F.col("part").isin(opened))
            rows = rows.unionByName(held.drop("part"))
        return rows

    def write(self, name: str, rows: DataFrame) -> DataFrame:
        folder = f"{self.path}/{name}/turn={self.turn}"
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows.withColumn("turn", F.lit(self.turn).cast("bigint")).select(*columns).write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(SCHEMAS[name]).parquet(folder)

    def jds(self) -> DataFrame:
        return _latest(self.read("jds"), "item_id", "jd_hash")

    def versions(self, of: DataFrame | None = None) -> DataFrame:
        """The newest version of each document, or of those in ``of``."""
        rows = self.read("versions", of)
        return _latest(rows if of is None else rows.join(of, "doc_id", "left_semi"), "doc_id", "cv_hash")

    def scores(self) -> DataFrame:
        """Pair scores of the newest version of each document against the JDs as they are."""
        docs = self.versions().select("doc_id", F.col("turn").alias("doc_turn"))
        jds = self.jds().filter(F.col("jd_hash").isNotNull()).select("item_id", F.col("turn").alias("jd_turn"))
        rows = self.read("scores").join(jds, "item_id").join(docs, "doc_id")
        return rows.filter(F.col("turn") == F.greatest("doc_turn", "jd_turn")).select(*OUTPUT, "turn")

    def compact(self) -> None:
        """Write the current rows as the snapshot of the turn before this one, unless it is there."""
        upto = self.turn - 1
        if self.base == upto:
            return
        docs = self.versions()
        current = {
            "jds": self.jds(),
            "versions": docs,
            "terms": self.read("terms").join(docs.select("doc_id", "turn"), ["doc_id", "turn"], "left_semi"),
            "scores": self.scores(),
        }
        for name, rows in current.items():
            folder = f"{self.path}/snapshot/{name}/turn={upto}"
            if name in CUT:
                parted = rows.withColumn("part", _part(CUT[name])).repartition("part")
                parted.write.mode("overwrite").partitionBy("part").parquet(folder)
            else:
                rows.write.mode("overwrite").parquet(folder)
        # last, so that a snapshot counts when all of it is there
        mark = self.spark.createDataFrame([(upto,)], "turn bigint")
        mark.write.mode("overwrite").parquet(f"{self.path}/snapshot/done/turn={upto}")


def _part(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")


def _latest(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, turn) of the last turn that wrote each key."""
    last = rows.groupBy(key).agg(F.max(F.struct("turn", value)).alias("last"))
    return last.select(key, f"last.{value}", "last.turn")


# --- a turn --------------------------------------------------------------------------------


def _changed_jds(store: Store, keys: DataFrame) -> DataFrame:
    """JDs whose key terms are new, changed or gone (jd_hash NULL)."""
    known = store.jds().select("item_id", F.col("jd_hash").alias("known"))
    now = jd_fingerprints(keys).join(known, "item_id", "full")
    return now.filter(~F.col("jd_hash").eqNullSafe(F.col("known"))).select("item_id", "jd_hash")


def _index(docs: DataFrame, carry: Mapping[str, Column]) -> DataFrame:
    """All terms of the documents by line, with the scores of the CV."""
    return docs.withColumns(dict(carry)).select("doc_id", *OWN, F.inline(terms.marked_terms()))


def _scored(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The scores of index rows and key terms; what meets is moved once, by document."""
    return score_lines(rows.join(keys.drop("df"), "term").repartition("doc_id")).select(*OUTPUT)


def _advance(store: Store, docs: DataFrame | None, keys: DataFrame, carry: Mapping[str, Column]) -> None:
    changed_jds = store.write("jds", _changed_jds(store, keys))
    empty = store.spark.createDataFrame([], SCHEMAS["versions"])
    if docs is None:
        written, fresh = store.write("versions", empty), store.write("terms", store.spark.createDataFrame([], SCHEMAS["terms"]))
    else:
        order = Window.partitionBy("doc_id").orderBy(F.col("version").desc())
        last = docs.withColumn("__n", F.row_number().over(order)).filter("__n = 1")
        # JDs are followed on their own, so a document's version depends on its text alone
        none = F.lit("")
        newest = last.select(F.col("doc_id").alias("key"), F.col("text").alias("cv_text"), none.alias("jd_text"))
        known = store.versions(docs.select("doc_id"))
        known = known.select(F.col("doc_id").alias("key"), "cv_hash", F.sha2(none, 256).alias("jd_hash"))
        stale = uncached_requests(newest, known).withColumnRenamed("key", "doc_id")
        written = store.write("versions", stale)
        todo = last.join(written.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")
        fresh = store.write("terms", _index(todo, carry))

    scores = _scored(fresh, keys)
    if not changed_jds.isEmpty():
        again = keys.join(changed_jds, "item_id", "left_semi")
        rows = store.read("terms", again.select("term")).join(again.select("term"), "term", "left_semi")
        current = store.versions().join(written.select("doc_id"), "doc_id", "left_anti").select("doc_id", "turn")
        held = rows.join(current, ["doc_id", "turn"], "left_semi")
        scores = scores.unionByName(_scored(held, again))
    store.write("scores", scores)


def _now(keys: Keys, spark: SparkSession) -> DataFrame:
    return keys(spark) if callable(keys) else keys


def score_batch(
    docs: DataFrame, batch: int, keys: Keys, path: str, carry: Mapping[str, Column] | None = None, compact: int = COMPACT
) -> None:
    """Bring the scores up to date with the documents of one batch and the key terms.

    ``docs``: (doc_id, text, version).  Unchanged content is not scored again.
    ``keys``: the key terms of all JDs as they are now, or a function that reads them.
    ``carry``: the scores of the CV itself, by default :func:`cv_scores`.
    """
    spark, turn = docs.sparkSession, 2 * batch  # the odd turns are for refreshes
    if batch and batch % compact == 0:
        Store(spark, path, turn).compact()
    _advance(Store(spark, path, turn), docs, _now(keys, spark), carry or cv_scores())


def refresh(spark: SparkSession, keys: Keys, path: str) -> None:
    """Bring the scores up to date with the key terms, without a document.

    For use between batches.  It is a turn of its own after the last batch; refreshes
    that follow each other without a batch share it.
    """
    last = max(_turns(spark, f"{path}/jds"), default=0)
    _advance(Store(spark, path, last | 1), None, _now(keys, spark), {})


def expire(spark: SparkSession, path: str) -> None:
    """Delete what lies before the last snapshot.  Only batches after it can then be replayed."""
    last = max(_turns(spark, f"{path}/snapshot/done"), default=-1)
    for folder in [f"{path}/{name}" for name in SCHEMAS] + [f"{path}/snapshot/{name}" for name in ("done", *SCHEMAS)]:
        for turn in _turns(spark, folder):
            if turn < last or (turn == last and "/snapshot/" not in folder[len(path) :]):
                at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/turn={turn}")
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stream_incremental_scoring(
    docs: DataFrame, keys: Keys, path: str, checkpoint: str, carry: Mapping[str, Column] | None = None,
    compact: int = COMPACT,
) -> StreamingQuery:
    """Start scoring a stream of (doc_id, text, version) into ``path``."""
    return (
        docs.writeStream.foreachBatch(lambda rows, batch: score_batch(rows, batch, keys, path, carry, compact))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_scores(spark: SparkSession, path: str) -> DataFrame:
    """All scores of the newest version of each document against the JDs as they are now."""
    last = max(_turns(spark, f"{path}/jds"), default=-1)
    return Store(spark, path, last + 1).scores().select(*OUTPUT)
