"""One registered query for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pairwright.llm import exact, fingerprints, html_text, langid, line_dedup, mixing, near, packing, prefix_trie
from pairwright.llm import private, simhash, token_files, variants
from pairwright.plans.fixtures import ship_package
from pairwright.plans.scale import scratch_path

CAPACITY = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    docs = _table(spark, sf_dir, "documents")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read(spark, path)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=CAPACITY)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_documents(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.groups(_table(spark, sf_dir, "documents")).drop("row")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(_table(spark, sf_dir, "documents"), n=2, percent=80).drop("row")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.protect(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_near_dedup": op5_near_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_html_text": op7_html_text,
    "op8_surrogates": op8_surrogates,
    "op9_line_dedup": op9_line_dedup,
    "op10_fingerprints": op10_fingerprints,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op4_exact_dedup": exact.SQL,
    "op5_near_dedup": near.SQL,
    "op6_source_mixing": mixing.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op11_spelling_variants": variants.SQL,
    "op13_prefix_trie": prefix_trie.SQL,
}
