"""Corpus scans, page assembly, input routing, result tables and nested export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions import values as V
from pairwright.functions.text import is_blank, strip_left, strip_right, strip_text
from pairwright.plans import scale

CV_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
)
JD_SCHEMA = T.StructType(
    [T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())]
)


def load_corpus(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = CV_SCHEMA
) -> DataFrame:
    """Read a table of texts under a declared schema.

    ``parquet``, ``orc``, ``json`` and ``csv`` read the declared columns only.
    ``text`` reads one document per file and keeps its path as the id.
    """
    if fmt == "text":
        return spark.read.text(path, wholetext=True).select(
            F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
        )
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.format(fmt).load(path)


def assemble_page_text(
    pages: DataFrame, doc: str, page_no: str, text: str, block: int = scale.BLOCK, limit: int = scale.SEGMENT
) -> DataFrame:
    """Page texts to document text: a missing page is empty, one line feed after
    each page, the whole stripped.

    One row per document; only one of more than ``limit`` characters goes on in further segments,
    which joined in order give its text.
    """
    body = F.concat(F.coalesce(F.col(text), F.lit("")), F.lit("\n"))
    segments = scale.ordered_segments(pages, doc, page_no, body, F.length(body), "__pages", block, limit)
    segments = segments.select(doc, "segment", F.array_join("__pages", "").alias("text"))
    # Blank pages can fill whole segments at either end, so the first and last segment
    # with text decide where to strip.  Short documents know theirs without a shuffle.
    long = scale.long_keys(pages, doc, page_no, block)
    if long is None:
        return segments.withColumn("text", strip_text("text"))
    filled = (
        segments.join(long, doc, "left_semi").filter(~is_blank("text"))
        .groupBy(doc).agg(F.min("segment").alias("__first"), F.max("segment").alias("__last"))
    )
    first, last = (F.coalesce(n, F.lit(0)) for n in ("__first", "__last"))
    here = F.col("segment")
    stripped = (
        F.when((here == first) & (here == last), strip_text("text"))
        .when(here == first, strip_left("text"))
        .when(here == last, strip_right("text"))
        .otherwise(F.col("text"))
    )
    marked = segments.join(scale.materialize(filled, "filled-segments"), doc, "left")
    return marked.filter(here.between(first, last)).select(doc, "segment", stripped.alias("text"))


# --- input routing ---------------------------------------------------------------


def rejection() -> Column:
    """The first input rule a request breaks, as struct(code, reason); else NULL.

    Columns: ``kind`` (upload, extract, analyze, finish, speech, writer),
    ``content_type``, ``parsed`` (did the file parse), ``cv_text``, ``jd_text``,
    ``n_messages``.
    """
    kind = F.col("kind")

    def out(rule: tuple[int, str]) -> Column:
        return F.struct(F.lit(rule[0]).alias("code"), F.lit(rule[1]).alias("reason"))

    is_file = kind.isin("upload", "extract")
    no_cv, no_jd = is_blank("cv_text"), is_blank("jd_text")
    not_pdf = ~F.equal_null(F.col("content_type"), F.lit("application/pdf"))
    return (
        F.when(is_file & not_pdf, out(V.REJECT_NOT_PDF))
        .when(is_file & ~F.coalesce(F.col("parsed"), F.lit(False)), out(V.REJECT_UNPARSEABLE))
        .when(kind.isin("upload", "analyze") & no_cv, out(V.REJECT_EMPTY_TEXT))
        .when((kind == "finish") & (F.coalesce(F.col("n_messages"), F.lit(0)) == 0),
              out(V.REJECT_EMPTY_HISTORY))
        .when((kind == "speech") & no_cv, out(V.REJECT_EMPTY_SPEECH))
        .when((kind == "writer") & (no_cv | no_jd), out(V.REJECT_CV_OR_JD))
    )


def classify_requests(reqs: DataFrame) -> DataFrame:
    """Every request with ``code`` and ``reason``; both NULL when accepted."""
    return (
        reqs.withColumn("__r", rejection())
        .withColumns({"code": F.col("__r.code"), "reason": F.col("__r.reason")})
        .drop("__r")
    )


def route_requests(reqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected requests; the rejected carry ``code`` and ``reason``."""
    rows = classify_requests(reqs)
    return rows.filter(F.col("code").isNull()).drop("code", "reason"), rows.filter(
        F.col("code").isNotNull()
    )


def has_data(reqs: DataFrame, cv: str = "cv_text", jd: str = "jd_text") -> DataFrame:
    """Rows whose CV and JD both hold more than whitespace."""
    return reqs.filter(~is_blank(cv) & ~is_blank(jd))


# --- results ---------------------------------------------------------------------


def write_results(
    df: DataFrame, path: str, by: str = "item_id", buckets: int = 16, fmt: str = "parquet"
) -> None:
    """Persist results, each row with its JSON form, in folders by JD bucket.

    Folders are per bucket, not per JD, so their number does not grow with the
    JDs.  The rebalance hint gathers a bucket into few files and splits one that
    a popular JD makes large.
    """
    bucket = F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int")
    (
        df.withColumn("payload", F.to_json(F.struct(*df.columns)))
        .withColumn("bucket", bucket)
        .hint("rebalance", "bucket")
        .write.mode("overwrite")
        .partitionBy("bucket")
        .format(fmt)
        .save(path)
    )


def read_results(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet"
) -> DataFrame:
    """Read a result table back under its declared schema."""
    full = T.StructType([*schema.fields, T.StructField("payload", T.StringType())])
    return spark.read.schema(full).format(fmt).load(path).select(*full.names)


def export_faq_json(
    rows: DataFrame, group: str, order: str, question: str, answer: str, block: int = scale.BLOCK,
    limit: int = scale.SEGMENT,
) -> DataFrame:
    """Question-answer rows to one nested JSON page per group, in segments beyond ``limit`` characters."""
    entry = F.struct(
        F.lit("Question").alias("@type"),
        F.col(question).alias("name"),
        F.struct(F.lit("Answer").alias("@type"), F.col(answer).alias("text")).alias(
            "acceptedAnswer"
        ),
    )
    size = F.length(F.coalesce(question, F.lit(""))) + F.length(F.coalesce(answer, F.lit("")))
    pages = scale.ordered_segments(rows, group, order, entry, size, "mainEntity", block, limit)
    page = F.struct(
        F.lit("https://schema.org").alias("@context"),
        F.lit("FAQPage").alias("@type"),
        F.col("mainEntity"),
    )
    return pages.select(group, "segment", F.to_json(page).alias("page"))
