"""Corpora, input rules, result tables, catalog and nested export."""

from __future__ import annotations

import json

import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from pairwright.functions import text
from pairwright.operators import templates
from pairwright.plans.queries import QUERIES
from pairwright.sources import catalog, tables


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_corpus_formats(spark, tmp_path, fmt):
    data = [(1, 'one "quoted"\nline'), (2, "hai, ba")]
    path = str(tmp_path / fmt)
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    writer = df.write.option("header", True).option("escape", '"') if fmt == "csv" else df.write
    writer.format(fmt).save(path)
    assert rows(tables.load_corpus(spark, path, fmt)) == data


def test_whole_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x\ny", encoding="utf-8")
    got = tables.load_corpus(spark, str(tmp_path), "text").collect()
    assert [(r.path.endswith("a.txt"), r.text) for r in got] == [(True, "x\ny")]


PDF = "application/pdf"
REQUESTS = [
    ("upload", "text/plain", True, "", "", 0, (400, "not_pdf")),
    ("upload", PDF, False, "", "", 0, (422, "unparseable")),
    ("upload", PDF, True, " \n", "", 0, (422, "empty_text")),
    ("upload", PDF, True, "x", "", 0, None),
    ("extract", None, True, "x", "", 0, (400, "not_pdf")),
    ("extract", PDF, True, "", "", 0, None),
    ("analyze", None, None, " ", "j", 0, (422, "empty_text")),
    ("analyze", None, None, "x", "", 0, None),
    ("finish", None, None, None, None, 0, (422, "empty_history")),
    ("finish", None, None, None, None, 1, None),
    ("speech", None, None, "\t", None, 0, (400, "empty_speech")),
    ("writer", None, None, "x", " ", 0, (422, "cv_or_jd_missing")),
    ("writer", None, None, None, "x", 0, (422, "cv_or_jd_missing")),
    ("writer", None, None, "x", "x", 0, None),
]


def test_input_rules(spark):
    schema = (
        "id int, kind string, content_type string, parsed boolean, cv_text string, jd_text string, n_messages int"
    )
    df = spark.createDataFrame([(i, *r[:-1]) for i, r in enumerate(REQUESTS)], schema)
    ok, rejected = tables.route_requests(df)
    got = {r.id: (r.code, r.reason) for r in rejected.collect()} | {r.id: None for r in ok.collect()}
    assert got == {i: r[-1] for i, r in enumerate(REQUESTS)}
    assert rows(tables.has_data(df).select("id")) == [(13,)]


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_results_read_back_unchanged(spark, tmp_path, fmt):
    df = spark.range(100).select(
        (F.col("id") % 3).alias("item_id"), F.col("id").alias("doc_id"), F.lit("é\n").alias("note")
    )
    path = str(tmp_path / "r")
    for _ in range(2):
        tables.write_results(df, path, buckets=4, fmt=fmt)
    back = tables.read_results(spark, path, df.schema, fmt)
    assert rows(back.select("item_id", "doc_id", "note")) == rows(df)
    assert json.loads(back.filter("doc_id = 7").first().payload) == {"item_id": 1, "doc_id": 7, "note": "é\n"}


@pytest.mark.parametrize(("block", "limit"), [(2, 6), (2, 10**6), (4096, 6)])
def test_faq_export_parses_back(spark, block, limit):
    data = [(1, i, f'q"{i}', f"a\n{i}") for i in range(5)]
    df = spark.createDataFrame(data, "g int, ord int, q string, a string")
    pages = [json.loads(r.page) for r in tables.export_faq_json(df, "g", "ord", "q", "a", block, limit).orderBy("segment").collect()]
    assert len(pages) == (3 if (block, limit) == (2, 6) else 1)
    got = [(e["name"], e["acceptedAnswer"]["text"]) for p in pages for e in p["mainEntity"]]
    assert got == [(q, a) for _, _, q, a in data]
    assert pages[0]["@type"] == "FAQPage"


def test_catalog_lookups(spark):
    found = catalog.template_catalog(spark)
    assert [f.name for f in found.schema] == catalog.CATALOG_SCHEMA.names
    reqs = spark.createDataFrame([("marketing",), ("to-chuc-su-kien",), ("",)], "slug string")
    assert rows(templates.template_lookup_strict(reqs, found).select("slug")) == [("marketing",)]
    got = {r.slug: r for r in templates.template_lookup_fallback(reqs, found, brand="B").collect()}
    assert got["marketing"].page_title == "Mẫu CV chuẩn ATS ngành Marketing / Truyền thông chuẩn ATS 2026 | B"
    assert got["to-chuc-su-kien"].name == "to chuc su kien"
    assert got["to-chuc-su-kien"].page_keywords is None
    assert got["to-chuc-su-kien"].page_title == "Cách viết CV ngành to-chuc-su-kien chuẩn ATS | B"
    assert got[""].title == "Mẫu CV ngành Chuyên nghiệp"
    assert got[""].template.experience[0].achievements


def test_keyword_preview(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a", "b", "c", "d", "e"],)], "k array<string>")
    got = [(r.p.preview, r.p.more) for r in df.select(templates.keyword_preview("k").alias("p")).collect()]
    assert got == [(["a", "b", "c"], None), (["a", "b", "c"], "+2")]


def test_record_rendering(spark):
    record = catalog.template_catalog(spark).filter("slug = 'it-phan-mem'")
    body = record.select(text.render_nested_record("template")).first()[0]
    assert body.startswith("NGUYỄN VĂN A\nFull-stack engineer\nname@example.com\n\nSUMMARY\n")
    assert "\n\nSKILLS\nPython\nSQL\nSpark\n\nEXPERIENCE\n\nSenior engineer | Example Software | 2022 - now\n• Cut" in body
    assert "\n• Led a team of 6\n\n\nEngineer | Example Agency" in body
    assert body.endswith("\n\nEDUCATION\nBSc Computer Science")


def test_exported_pages_of_the_fixture_parse(spark):
    for r in QUERIES["export_nested_json"](spark, SF).collect():
        assert json.loads(r.page)["mainEntity"]


def test_scratch_folder_must_be_shared_on_a_cluster():
    from types import SimpleNamespace

    from pairwright.plans.scale import scratch_root

    conf = SimpleNamespace(get=lambda key, default: default)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(SimpleNamespace(conf=conf, sparkContext=context))


def test_catalog_is_the_broadcast_side(spark):
    for name in ("template_lookup_fallback", "template_lookup_strict"):
        text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
