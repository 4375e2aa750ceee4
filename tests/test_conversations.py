"""Turn walks, with conversations longer than a block and block edges everywhere."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairwright.functions import values as V
from pairwright.operators import conversations as C
from pairwright.operators import matching, terms
from pairwright.sources import tables

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def make(seed=7, convs=6, longest=40):
    rng = random.Random(seed)
    out = []
    for conv in range(convs):
        n = rng.randint(1, longest)
        for turn in range(n):
            role = rng.choice(("user", "assistant", "assistant", "system", "user"))
            body = rng.choice((f"t{conv}-{turn}", "", " \n", None)) if rng.random() < 0.3 else f"t{conv}-{turn}"
            out.append((conv, turn, role, body))
    return out


@pytest.fixture(scope="module")
def data():
    return make()


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_qa_pairs(spark, data, block):
    want, last = [], {}
    for conv, turn, role, body in data:
        if role == "user" and last.get(conv) is not None:
            want.append((conv, turn, last[conv], body))
        if role == "assistant" and body is not None:
            last[conv] = body
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(C.qa_pairs(df, block)) == sorted(want, key=lambda r: r[:2])
    counts = {r[0]: r[1] for r in C.question_totals(df).collect()}
    assert counts == {c: sum(1 for w in want if w[0] == c) for c in {d[0] for d in data}}


@pytest.mark.parametrize("block", [1, 4, 4096])
def test_attach_feedback(spark, data, block):
    want = []
    for i, (conv, turn, role, body) in enumerate(data):
        if role == "user":
            nxt = data[i + 1] if i + 1 < len(data) and data[i + 1][0] == conv else None
            want.append((conv, turn, body, nxt[3] if nxt and nxt[2] == "assistant" else None))
    df = spark.createDataFrame(data, SCHEMA).withColumn("fb", F.col("text"))
    assert rows(C.attach_feedback(df, "fb", block)) == sorted(want, key=lambda r: r[:2])


@pytest.mark.parametrize("block", [1, 5, 4096])
@pytest.mark.parametrize("total", V.INTERVIEW_LENGTHS)
def test_question_progress(spark, data, block, total):
    want, seen = [], {}
    for conv, turn, role, body in data:
        before = seen.get(conv, 0)
        if before >= total:
            continue
        answered = role == "user" and bool(body and body.strip())
        want.append((conv, turn, min(before + 1, total), answered and before == total - 1))
        seen[conv] = before + answered
    got = C.question_progress(spark.createDataFrame(data, SCHEMA), total, block)
    assert rows(got.select("conv_id", "turn", "question_no", F.coalesce("finishes", F.lit(False)))) == want


@pytest.mark.parametrize(("block", "limit"), [(1, 10**6), (1, 5), (3, 20), (4096, 5)])
def test_assemble_page_text(spark, data, block, limit):
    want = {}
    for conv, turn, _, body in data:
        want[conv] = want.get(conv, "") + (body or "") + "\n"
    got = {}
    df = spark.createDataFrame(data, SCHEMA)
    found = tables.assemble_page_text(df, "conv_id", "turn", "text", block, limit).orderBy("conv_id", "segment").collect()
    assert limit < 10**6 or len(found) == len(want)
    for r in found:
        got[r.conv_id] = got.get(r.conv_id, "") + r.text
    assert {k: v for k, v in got.items() if v} == {k: v.strip() for k, v in want.items() if v.strip()}


def test_a_document_of_many_pages_counts_once(spark):
    """5,000 pages at sparse positions through page assembly, terms and pair scores."""
    long = [(1, 7 * i, "user", "spark" if i in (0, 4999) else f"page{i}") for i in range(5000)]
    pages = spark.createDataFrame(long + [(2, 0, "user", "spark"), (3, 0, "user", "none")], SCHEMA)
    docs = tables.assemble_page_text(pages, "conv_id", "turn", "text")
    assert rows(docs.select("conv_id", "segment")) == [(1, 0), (2, 0), (3, 0)]
    cvs = docs.select(F.col("conv_id").alias("doc_id"), "text")
    assert rows(terms.term_document_freq(cvs).filter("term = 'spark'")) == [("spark", 2, 3)]
    jds = spark.createDataFrame([(9, "spark page17 absent")], "item_id bigint, text string")
    inputs = matching.prepare(cvs, jds, True, matching.cv_scores(), max_df_percent=100)
    assert rows(matching.keyword_coverage(inputs)) == [(1, 9, 2, 3, 67), (2, 9, 1, 3, 33)]
    assert rows(matching.match_score(inputs).select("doc_id", "keyword_coverage")) == [(1, 67), (2, 33)]


@pytest.mark.parametrize(("block", "limit"), [(2, 10**6), (2, 9), (4096, 9)])
def test_flatten_history(spark, data, block, limit):
    got = {}
    for r in C.flatten_history(spark.createDataFrame(data, SCHEMA), block, limit).orderBy("segment").collect():
        got.setdefault(r.conv_id, []).append(r.history)
    want = {}
    for conv, _, role, body in data:
        want.setdefault(conv, []).append(f"{role}: {body or ''}")
    assert {k: "\n".join(v) for k, v in got.items()} == {k: "\n".join(v) for k, v in want.items()}


def test_interview_payload(spark):
    turns = [
        (1, 0, "assistant", "Bạn hãy giới thiệu bản thân nhé?"),
        (1, 1, "user", "Mình là dev FE 5 năm kinh nghiệm."),
    ]
    df = spark.createDataFrame(turns, SCHEMA)
    assert rows(C.qa_pairs(df)) == [(1, 1, turns[0][3], turns[1][3])]
    assert rows(C.role_counts(df)) == [(1, 1, 1, False)]
    replies = spark.createDataFrame([(1, "next?", "hint"), (2, None, "lost")],
                                    "conv_id bigint, next_question string, hint_for_user string")
    after = {(r.conv_id, r.turn): (r.role, r.text, r.hint_for_user) for r in C.append_response(df, replies, "B").collect()}
    assert after[(1, 2)] == ("assistant", "next?", "hint")
    assert after[(2, 0)] == ("assistant", V.APOLOGY.replace("{brand}", "B"), None)


def test_roles_and_seeds(spark):
    df = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "assistant", "a")], SCHEMA)
    assert [r.role for r in C.normalize_roles(df).orderBy("turn").collect()] == ["user", "assistant"]
    ids = spark.createDataFrame([(1,), (2,)], "conv_id bigint")
    assert (2, 0, "user", V.START_CUE) in rows(C.seed_empty_history(df, ids))
    history = C.project_history(C.normalize_roles(df))
    system = spark.createDataFrame([(1, "rules")], "conv_id bigint, content string")
    assert rows(C.build_messages(history, system))[0] == (1, 0, "system", "rules")


def test_latest_prompt(spark):
    data = [
        (1, 0, "assistant", "q", "h"), (2, 0, "assistant", "q", ""), (3, 0, "assistant", "q", "h"),
        (3, 1, "user", "a", None), (4, 0, "user", "a", None),
    ]
    df = spark.createDataFrame(data, SCHEMA + ", hint_for_user string")
    wait = V.DEFAULT_HINT
    assert rows(C.latest_prompt(df)) == [(1, "q", "h"), (2, "q", wait), (3, "q", wait), (4, None, wait)]


def test_blank_answers_do_not_count_as_progress(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "real"), (1, 1, "user", "  "), (1, 2, "user", None)],
        "conv_id long, turn int, role string, text string",
    )
    assert C.completion(turns, 3).first().answered == 1
