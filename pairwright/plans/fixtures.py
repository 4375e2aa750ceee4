"""Operator inputs derived from the given tables."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import pairwright
from pairwright.functions.rules import clamp, int_div
from pairwright.functions.text import lines
from pairwright.plans import scale
from pairwright.sources.tables import CV_SCHEMA, JD_SCHEMA, load_corpus

FIXTURE_FILLERS = ("ờ", "ừm", "à", "thì là", "the", "of the", "le", "und", "que")
FIXTURE_HEADINGS = ("the", "le", "la", "die", "el")
PDF = "application/pdf"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they run."""
    shipped = [p for p in spark.sparkContext.listFiles if p.endswith("pairwright.zip")]
    if not shipped:
        root = os.path.dirname(os.path.dirname(os.path.abspath(pairwright.__file__)))
        base = os.path.join(tempfile.mkdtemp(prefix="pairwright-"), "pairwright")
        spark.sparkContext.addPyFile(shutil.make_archive(base, "zip", root, "pairwright"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.spread(load_corpus(spark, f"{sf_dir}/documents.parquet", schema=CV_SCHEMA))


def jds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_corpus(spark, f"{sf_dir}/benchmark.parquet", schema=JD_SCHEMA)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scale.spread(table(spark, sf_dir, "documents"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, item_id): the JD each conversation is about."""
    n_jds = table(spark, sf_dir, "benchmark").agg(F.count(F.lit(1))).scalar()
    ids = turns(spark, sf_dir).select("conv_id").distinct()
    return scale.materialize(ids.withColumn("item_id", F.pmod("conv_id", n_jds)), "interviews")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        int_div(F.col("event_id"), F.lit(3)).alias("request_id"),
        (F.col("event_id") % 3).cast("int").alias("provider_rank"),
        F.lit(1).alias("attempt"),
        F.when(~failed, F.col("props")).alias("content"),
        F.when(failed, F.concat(F.lit("failed "), F.col("event_id").cast("string"))).alias("error"),
    )


def category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("interview_id"),
        F.col("event_type").alias("category"),
        F.floor(clamp("value", 0.0, 100.0)).cast("bigint").alias("score"),
    )


def as_fragments(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").alias("session_id"),
        F.col("event_id").alias("ord"),
        F.concat(F.lit(" "), F.col("event_type"), F.lit("-"), F.col("event_id").cast("string")).alias("text"),
        (F.col("event_type") == "purchase").alias("is_final"),
    )


def slug_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c_custkey, slug): catalog slugs and, for the rest, nation names as slugs."""
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name"
    )
    pick = F.col("c_custkey") % 5
    named = F.replace(F.lower("n_name"), F.lit("_"), F.lit("-"))
    slug = (
        F.when(pick == 0, "it-phan-mem").when(pick == 1, "marketing").when(pick == 2, "nhan-su-hr")
        .otherwise(named)
    )
    return (
        table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        .join(nation, "c_nationkey").select("c_custkey", slug.alias("slug"))
    )


def every(col: str, n: int, value: Column, otherwise: Column) -> Column:
    return F.when(F.col(col) % n == 0, value).otherwise(otherwise)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests, with blanks, wrong types and parse failures injected."""
    kinds = ("upload", "extract", "analyze", "finish", "speech", "writer")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("doc_id") % 6 + 1).cast("int"))
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("request_id"),
        kind.alias("kind"),
        every("doc_id", 11, F.lit("text/plain"), F.lit(PDF)).alias("content_type"),
        (F.col("doc_id") % 13 != 0).alias("parsed"),
        every("doc_id", 7, F.lit("  \n"), F.col("text")).alias("cv_text"),
        every("doc_id", 17, F.lit(" "), F.col("source")).alias("jd_text"),
        (F.col("doc_id") % 4).alias("n_messages"),
    )


def edits(docs: DataFrame) -> DataFrame:
    """Two edits per document: mark the first line, then change the mark."""
    first = F.get(lines("text"), 0)
    star, dash = F.concat(F.lit("* "), first), F.concat(F.lit("- "), first)
    pairs = F.array(
        F.struct(
            F.lit(0).alias("ord"),
            every("doc_id", 4, F.concat(F.lit("~"), first), first).alias("original_text"),
            star.alias("upgraded_text"),
        ),
        F.struct(F.lit(1).alias("ord"), star.alias("original_text"), dash.alias("upgraded_text")),
    )
    return docs.select("doc_id", F.inline(pairs))


def channel(n: int) -> Column:
    names = ("email", "linkedin", "zalo", "custom", "other")[:n]
    return F.element_at(F.array(*[F.lit(c) for c in names]), (F.col("doc_id") % n + 1).cast("int"))


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, raw): interview-turn JSON from labels, with a fault by doc_id % 8."""
    score = (F.col("quality") * 50 + F.col("toxic") * 7 + F.col("doc_id") % 10).cast("string")
    pick = F.col("doc_id") % 8
    confidence = (
        F.when(pick == 1, F.concat(F.lit('"'), score, F.lit('"')))
        .when(pick == 2, F.concat(score, F.lit(".0")))
        .when(pick == 3, F.concat(score, F.lit(".5")))
        .when(pick == 5, F.lit("140"))
        .otherwise(score)
    )
    rating = F.when(pick == 7, "GOOD").otherwise("TỐT")
    hint = F.when(pick == 4, "").otherwise('"hint_for_user":"h",')
    raw = F.concat(
        F.lit('{"ai_feedback":"ok","next_question":"q'), F.col("doc_id").cast("string"), F.lit('",'),
        hint,
        F.lit('"extra":[1],"metrics":{"confidence_score":'), confidence,
        F.lit(',"confidence_feedback":"a","jd_relevance_score":'), score,
        F.lit(',"jd_relevance_feedback":"b","tech_vocab_rating":"'), rating, F.lit('"}}'),
    )
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.when(pick == 6, F.concat(F.lit("Sure! "), raw)).otherwise(raw).alias("raw")
    )
