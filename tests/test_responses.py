"""Validation of structured responses, checks, and the fallback waterfall."""

from __future__ import annotations

import json
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairwright.functions import values as V
from pairwright.operators import cache, completion, responses

REPORT = {
    "overall_score": 80,
    "overall_feedback": "fine",
    "sub_scores": [{"category": c, "score": 70, "label": "Tốt"} for c in V.REPORT_CATEGORIES],
    "key_strengths": ["a", "b"],
    "areas_for_improvement": [],
    "top_topics_covered": ["x"],
    "ai_feedback_summary": {"positive": "p", "warning": "w", "actionable": "a"},
    "turn_by_turn_analysis": [
        {"question": "q", "user_answer": "u", "feedback": "f", "ideal_answer_snippet": "i"}
    ],
}
TURN = {
    "ai_feedback": "Tốt lắm", "next_question": "React?", "hint_for_user": "STAR",
    "metrics": {
        "confidence_score": 95, "confidence_feedback": "c", "jd_relevance_score": 85,
        "jd_relevance_feedback": "j", "tech_vocab_rating": "TỐT",
    },
}
MATCH = {
    "match_score": 10, "missing_skills": ["k8s"],
    "tailored_cv": {
        "name": "n", "summary": "s", "education": "e", "skills": ["a"],
        "experience": [{"company": "c", "role": "r", "bullet_points": ["x", "y"]},
                       {"company": "d", "role": "s", "bullet_points": []}],
    },
}
ANALYSIS = {
    **{k: 50 for k in ("match_score", "technical_match", "experience_relevance", "keyword_coverage",
                       "impact_evidence", "tone_quality", "ats_readiness")},
    "match_headline": "h", "match_summary": "s", "missing_keywords": ["k"],
    "suggested_edits": [{"section": "s", "original_text": "o", "upgraded_text": "u", "reason": "r"}],
    "cv_strengths": ["a"],
    "prioritized_keywords": [{"keyword": "k", "priority": "High"}],
    "evidence_analysis": [{"claim": "c", "evidence_strength": "Weak", "comment": "m"}],
}
WRITER = {"subject_line": "", "content": "c", "tips": ["t"]}
VALID = {
    "final_report": REPORT, "interview_turn": TURN, "match_result": MATCH, "cv_analysis": ANALYSIS, "writer": WRITER
}


def changed(base, path, value):
    out = json.loads(json.dumps(base))
    at = out
    *parents, last = path.split(".")
    for p in parents:
        at = at[int(p)] if p.isdigit() else at[p]
    if value is KeyError:
        del at[last]
    else:
        at[last] = value
    return json.dumps(out, ensure_ascii=False)


def parse(spark, raw, model):
    df = spark.createDataFrame([(raw,)], "raw string")
    return responses.parse_responses(df, "raw", model).first()


@pytest.mark.parametrize("model", sorted(VALID))
def test_valid_models_come_back_whole(spark, model):
    row = parse(spark, json.dumps(VALID[model]), model)
    assert row.error is None
    assert row.parsed.asDict(recursive=True) == VALID[model]


CASES = [
    ("interview_turn", "metrics.confidence_score", "95", None),
    ("interview_turn", "metrics.confidence_score", 95.0, None),
    ("interview_turn", "metrics.confidence_score", "95.0", None),
    ("interview_turn", "metrics.confidence_score", 140, None),
    ("interview_turn", "metrics.confidence_score", True, None),
    ("interview_turn", "metrics.confidence_score", 95.5, "int metrics.confidence_score"),
    ("interview_turn", "metrics.confidence_score", "high", "int metrics.confidence_score"),
    ("interview_turn", "metrics.confidence_score", None, "int metrics.confidence_score"),
    ("interview_turn", "metrics.confidence_score", [1], "int metrics.confidence_score"),
    ("interview_turn", "metrics.confidence_score", KeyError, "missing metrics.confidence_score"),
    ("interview_turn", "hint_for_user", KeyError, "missing hint_for_user"),
    ("interview_turn", "hint_for_user", 5, "type hint_for_user"),
    ("interview_turn", "metrics", "x", "type metrics"),
    ("interview_turn", "metrics.tech_vocab_rating", "GOOD", "enum metrics.tech_vocab_rating"),
    ("interview_turn", "unknown", {"a": 1}, None),
    ("writer", "tips", "x", "type tips"),
    ("writer", "tips", [1], "type tips[]"),
    ("writer", "tips", [], None),
    ("final_report", "sub_scores.2.score", "x", "int sub_scores[].score"),
    ("cv_analysis", "prioritized_keywords.0.priority", "Urgent", "enum prioritized_keywords[].priority"),
    ("match_result", "tailored_cv.experience.1.role", KeyError, "missing tailored_cv.experience[].role"),
]


@pytest.mark.parametrize(("model", "path", "value", "error"), CASES)
def test_faults(spark, model, path, value, error):
    row = parse(spark, changed(VALID[model], path, value), model)
    assert row.error == error
    assert (row.parsed is None) == (error is not None)


@pytest.mark.parametrize(
    ("raw", "error"), [("", "empty response"), (None, "empty response"), ("{bad", "invalid json"), ("[]", "type response")]
)
def test_broken_text(spark, raw, error):
    assert parse(spark, raw, "writer").error == error


def test_flattening(spark):
    df = spark.createDataFrame([(1, json.dumps(MATCH)), (2, json.dumps({**MATCH, "tailored_cv": {**MATCH["tailored_cv"], "experience": []}}))], "id int, raw string")
    parsed = responses.parse_responses(df, "raw", "match_result")
    got = rows(responses.explode_experience(parsed, "id", "parsed.tailored_cv.experience"))
    assert got == [
        (1, 0, "c", "r", 0, "x"), (1, 0, "c", "r", 1, "y"), (1, 1, "d", "s", None, None),
        (2, None, None, None, None, None),
    ]
    report = responses.parse_responses(
        spark.createDataFrame([(1, json.dumps(REPORT))], "id int, raw string"), "raw", "final_report"
    )
    children = responses.explode_report(report, "id")
    assert children["sub_scores"].count() == 5
    assert children["areas_for_improvement"].count() == 0
    assert rows(children["turn_by_turn_analysis"]) == [(1, 0, "q", "u", "f", "i")]
    sizes = responses.check_list_sizes(report.select("id", "parsed.*")).first().violations
    assert sizes == ["areas_for_improvement", "top_topics_covered"]


def test_all_lists_in_one_table(spark):
    df = spark.createDataFrame([(1, json.dumps(MATCH)), (2, "no json")], "id int, raw string")
    got = responses.explode_children(responses.parse_responses(df, "raw", "match_result"), "id")
    assert rows(got.filter("child LIKE '%experience%'").selectExpr("child", "pos", "map_values(item)")) == [
        ("tailored_cv.experience", [0], ["c", "r"]),
        ("tailored_cv.experience", [1], ["d", "s"]),
        ("tailored_cv.experience.bullet_points", [0, 0], ["x"]),
        ("tailored_cv.experience.bullet_points", [0, 1], ["y"]),
    ]
    assert {r.child for r in got.collect()} == {
        "missing_skills", "tailored_cv.skills", "tailored_cv.experience", "tailored_cv.experience.bullet_points"
    } - {n for n, v in (("missing_skills", MATCH["missing_skills"]), ("tailored_cv.skills", MATCH["tailored_cv"]["skills"])) if not v}


def test_checks_flag_null(spark):
    df = spark.createDataFrame([(None, None, -1), ("High", 100, 0)], "p string, s int, t int")
    enums = [r.violations for r in responses.check_enums(df, {"p": V.PRIORITIES}).collect()]
    ranges = [r.violations for r in responses.check_ranges(df, ["s", "t"]).collect()]
    assert enums == [["p"], []] and ranges == [["s", "t"], []]


def waterfall(spark, providers, retries=1):
    message = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))
    reqs = spark.range(4).select(F.col("id").alias("request_id"), message.alias("messages"))
    model = {"test_message": "str", "success": "bool"}
    return completion.complete_batch(reqs, providers, model, max_retries=retries, pause=0.0)


def providers():
    """Fakes that fail and succeed; local functions travel to workers by value."""

    def fails(messages):
        raise RuntimeError("Simulated limit")

    def works(messages):
        assert messages == [{"role": "user", "content": "hi"}]
        return '{"test_message": "Recovered", "success": true}'

    return fails, works


def test_two_fail_one_succeeds(spark):
    fails, works = providers()
    done, log = waterfall(spark, [fails, fails, works])
    assert {(r.status, r.provider_rank, r.parsed.success, r.last_error) for r in done.collect()} == {(200, 2, True, None)}
    assert rows(completion.provider_health(log)) == [(0, 4, 4, 0), (1, 4, 4, 0), (2, 4, 0, 100)]
    assert completion.all_failed(log).count() == 0


def test_all_fail(spark):
    done, log = waterfall(spark, [providers()[0], lambda m: "", lambda m: "{}"], retries=2)
    assert {(r.status, r.last_error) for r in done.collect()} == {(503, "missing test_message")}
    assert log.count() == 4 * 3 * 2
    assert completion.all_failed(log).count() == 4


def test_no_call_after_success(spark):
    done, log = waterfall(spark, list(reversed(providers())))
    assert log.count() == 4 and done.filter("status = 200").count() == 4


def test_messages_of_a_request(spark):
    said = [{"role": "assistant", "content": "q"}, {"role": "user", "content": "a"}]
    schema = "request_id string, system string, prompt string, history array<struct<role:string,content:string>>"
    reqs = spark.createDataFrame([("x", "Talk", "hi", said), ("y", "as json", "hi", []), ("z", None, "hi", None)], schema)
    got = {r.request_id: [tuple(m) for m in r.m] for r in reqs.select("request_id", completion.chat_messages(reqs).alias("m")).collect()}
    assert got == {
        "x": [("system", "Talk" + V.JSON_INSTRUCTION), ("assistant", "q"), ("user", "a")],
        "y": [("system", "as json"), ("user", "hi")],
        "z": [("user", "hi")],
    }


def test_pauses_and_calls_at_once(spark):
    """Ids of any type; a pause after an invalid answer too; slow calls overlap in a task."""
    model = {"a": "int"}
    reqs = spark.createDataFrame([(f"r{i}", "hi") for i in range(6)], "request_id string, prompt string").coalesce(1)

    def invalid(messages):
        return '{"a": 1.5}'

    def slow(messages):
        import time

        time.sleep(0.5)
        return '{"a": 2}'

    def timed(providers, **how):
        start = time.perf_counter()
        done, log = completion.complete_batch(reqs, providers, model, **how)
        assert {(r.request_id, r.parsed.a) for r in done.collect()} == {(f"r{i}", 2) for i in range(6)}
        return time.perf_counter() - start, log

    timed([slow], pause=0.0)  # workers started, code compiled
    one, _ = timed([slow], pause=0.0)
    many, _ = timed([slow], pause=0.0, concurrency=6)
    assert one - many > 1.5
    paused, log = timed([invalid, slow], pause=0.6, concurrency=1)
    assert paused - one > 6 * 0.6 - 1
    assert rows(completion.provider_health(log)) == [(0, 6, 6, 0), (1, 6, 0, 100)]


def test_pauses_grow_while_a_provider_fails(monkeypatch):
    waits = []
    monkeypatch.setattr(completion.time, "sleep", waits.append)
    pauses = completion.Pauses(2, 1.0, 2.0, 5.0)
    for rank, failed in [(0, True), (0, True), (1, True), (0, True), (0, True), (0, False), (0, True)]:
        pauses.after(rank, failed)
    assert waits == [1, 2, 1, 4, 5, 0, 1]


def test_the_validator_in_a_task_agrees_with_the_column_form(spark):
    turn = {
        "ai_feedback": "f", "next_question": "q", "hint_for_user": "h",
        "metrics": {
            "confidence_score": 95, "confidence_feedback": "c", "jd_relevance_score": 85,
            "jd_relevance_feedback": "j", "tech_vocab_rating": "TỐT",
        },
    }
    texts = [None, "", " ", "{", "[]", "null", "3", '"x"', json.dumps(turn), json.dumps(turn) + " x", '{"a": 1, "a": 2}', "{'a': 1}", "NaN"]
    for value in (95.0, 95.5, "95", " 95 ", "95.0", "x", "", None, True, [], {}, 1e3, 10**30, -7, "1e2"):
        texts.append(json.dumps({**turn, "metrics": {**turn["metrics"], "confidence_score": value}}))
    for value in ("GOOD", None, 3, "TỐT"):
        texts.append(json.dumps({**turn, "metrics": {**turn["metrics"], "tech_vocab_rating": value}}))
    texts += [json.dumps({**turn, k: v}) for k in turn for v in (None, 1, [], "s")] + [json.dumps({k: v for k, v in turn.items() if k != gone}) for gone in turn]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, raw string")
    want = {r.id: r.error for r in responses.parse_responses(df, "raw", "interview_turn").collect()}
    got = {i: responses.fault_of(t, responses.MODELS["interview_turn"]) for i, t in enumerate(texts)}
    assert {i: (texts[i], got[i], want[i]) for i in got if got[i] != want[i]} == {}
    bools = [json.dumps({"b": x}) for x in (True, False, "true", "Yes", "x", None, 1, 0, [])]
    df = spark.createDataFrame(list(enumerate(bools)), "id int, raw string")
    want = {r.id: r.error for r in responses.parse_responses(df, "raw", {"b": "bool"}).collect()}
    assert {i: (bools[i], want[i]) for i in want if responses.fault_of(bools[i], {"b": "bool"}) != want[i]} == {}


def test_cache(spark):
    schema = "key bigint, content string, version int"
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], schema)
    new = spark.createDataFrame([(1, "c", 2), (3, "d", 1), (2, "e", 1)], schema)
    once = cache.cache_upsert(old, new)
    assert rows(once) == [(1, "c", 2), (2, "e", 1), (3, "d", 1)]
    assert rows(cache.cache_upsert(once, new)) == rows(once)
    reqs = spark.createDataFrame(
        [(1, "cv", "jd"), (2, "cv2", "jd"), (3, None, "jd")], "key bigint, cv_text string, jd_text string"
    )
    stored = spark.createDataFrame([(1, "cv", "jd"), (2, "cv", "jd"), (3, None, "jd")], reqs.schema)
    left = cache.uncached_requests(reqs, cache.with_hashes(stored))
    assert rows(left.select("key")) == [(2,), (3,)]
