"""Pair scores against a plain loop, properties, and plan shape."""

from __future__ import annotations

import random
import re

import pytest
from conftest import SF, plan, rows
from pyspark.sql import functions as F

from pairwright.operators import details, language, matching, ranking, terms
from pairwright.plans.queries import QUERIES

CVS = [
    (1, "Python and Spark jobs\nBuilt 3 pipelines with Spark\nteam lead"),
    (2, "Accounting\n\nsales | marketing"),
    (3, "spark python docker kafka airflow terraform"),
    (4, ""),
    (5, None),
]
JDS = [(10, "Spark Spark Spark python, kafka. We use Docker and docker"), (11, "nurse"), (12, "of in at")]


def toks(text):
    return [t for t in re.split(r"[\W_]+", (text or "").lower()) if t]


def pct(h, n):
    return 0 if n == 0 else (200 * h + n) // (2 * n)


@pytest.fixture(scope="module")
def inputs(spark):
    cvs = spark.createDataFrame(CVS, "doc_id bigint, text string")
    jds = spark.createDataFrame(JDS, "item_id bigint, text string")
    return matching.prepare(cvs, jds, True, matching.cv_scores(("team",)), max_df_percent=60, graded=True)


def expected():
    df = {}
    for _, text in CVS:
        for t in set(toks(text)):
            df[t] = df.get(t, 0) + 1
    keys = {}
    for item, text in JDS:
        tf = {}
        for t in toks(text):
            if len(t) >= 3 and df.get(t, 0) * 100 <= 60 * len(CVS):
                tf[t] = tf.get(t, 0) + 1
        keys[item] = tf
    out = {}
    for doc, text in CVS:
        for item, tf in keys.items():
            hit = set(toks(text)) & set(tf)
            if hit:
                best = max(len(set(toks(x)) & set(tf)) for x in text.split("\n"))
                out[(doc, item)] = (
                    pct(len(hit), len(tf)),
                    pct(sum(tf[t] for t in hit), sum(tf.values())),
                    pct(best, len(tf)),
                )
    return keys, out


def test_scores_equal_a_plain_loop(inputs):
    _, want = expected()
    got = {
        (r.doc_id, r.item_id): (r.keyword_coverage, r.technical_match, r.experience_relevance)
        for r in matching.match_score(inputs).collect()
    }
    assert got == want
    simple = {(r.doc_id, r.item_id): r.keyword_coverage for r in matching.keyword_coverage(inputs).collect()}
    assert simple == {k: v[0] for k, v in want.items()}


def test_weights_and_bounds(inputs):
    for r in matching.match_score(inputs, (0, 0, 0, 0, 1)).collect():
        assert r.match_score == r.ats_readiness
    for r in matching.match_score(inputs).collect():
        parts = [r[c] for c in matching.SCORE_COLUMNS]
        assert all(0 <= p <= 100 for p in parts)
        assert r.match_score == (2 * sum(parts) + 5) // 10


def test_technical_match_of_a_skill_list(spark, inputs):
    skills = spark.createDataFrame([("kafka",), ("kafka",), ("docker",)], "term string")
    got = rows(matching.technical_match(inputs, skills))
    assert got == [(3, 10, 100)]


def test_matched_and_missing_split_the_key_terms(inputs):
    keys, want = expected()
    pairs = matching.keyword_coverage(inputs).select("doc_id", "item_id")
    got = {}
    for name, df in (
        ("hit", details.matched_keywords(pairs, inputs)), ("miss", details.missing_keywords(pairs, inputs))
    ):
        for r in df.collect():
            got.setdefault((r.doc_id, r.item_id), {"hit": set(), "miss": set()})[name].add(r.term)
    assert set(got) == set(want)
    for (doc, item), sides in got.items():
        assert sides["hit"] | sides["miss"] == set(keys[item])
        assert not sides["hit"] & sides["miss"]
        assert (want[(doc, item)][0] == 100) == (not sides["miss"])


def test_rank_breaks_ties_by_document(spark):
    scores = spark.createDataFrame(
        [(3, 1, 50), (1, 1, 50), (2, 1, 70), (9, 2, 1)], "doc_id bigint, item_id bigint, match_score bigint"
    )
    assert rows(matching.rank_candidates(scores, 2).select("item_id", "rank", "doc_id")) == [
        (1, 1, 2), (1, 2, 1), (2, 1, 9)
    ]


def test_claims_keep_the_missing_ones(spark, inputs):
    pairs = spark.createDataFrame([(1, 10), (2, 10)], "doc_id bigint, item_id bigint")
    claims = spark.createDataFrame([(10, "spark"), (10, "kafka")], "item_id bigint, claim string")
    evidence = details.claims_with_evidence(pairs, claims, inputs)
    said = rows(details.with_lines(evidence, inputs.cvs).select("doc_id", "claim", "line_no", "line"))
    assert said == [
        (1, "kafka", None, None), (1, "spark", 0, "Python and Spark jobs"), (1, "spark", 1, "Built 3 pipelines with Spark"),
        (2, "kafka", None, None), (2, "spark", None, None),
    ]
    assert rows(details.evidence_strength(evidence)) == [
        (1, 10, "kafka", "Missing"), (1, 10, "spark", "Strong"),
        (2, 10, "kafka", "Missing"), (2, 10, "spark", "Missing"),
    ]


@pytest.mark.parametrize(
    ("line", "want"),
    [("spark 3", "Strong"), ("spark a b c d e f g", "Medium"), ("spark a b c d e f", "Weak")],
)
def test_evidence_grades(spark, line, want):
    docs = spark.createDataFrame([(1, "\n" + line)], "doc_id bigint, text string")
    index = terms.line_terms(docs, graded=True).filter("term = 'spark'")
    ev = index.withColumns({"item_id": F.lit(1), "claim": F.col("term")})
    assert details.evidence_strength(ev).first().strength == want


def test_weakest_lines(spark):
    docs = spark.createDataFrame([(1, "one 1\n\ntwo words here\nshort\n2\nlast one")], "doc_id bigint, text string")
    got = [r.line for r in details.weakest_lines(docs, 4).orderBy("rank").collect()]
    assert got == ["short", "last one", "two words here", "2"]


def test_edits_run_in_order(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "keep")], "doc_id bigint, text string")
    edits = spark.createDataFrame(
        [(1, 2, "b", "c"), (1, 1, "a", "b"), (1, 3, "", "zzz")],
        "doc_id bigint, ord int, original_text string, upgraded_text string",
    )
    for block in (1, 1024):
        assert rows(details.apply_edits(docs, edits, block)) == [(1, "c c c"), (2, "keep")]
    far = [(1, o, f"{a}", f"{b}") for o, (a, b) in zip((None, 0, 2000, 4000, 6000), ("ab", "bc", "cd", "de", "ef"), strict=True)]
    chain = spark.createDataFrame(far, edits.schema)
    text = spark.createDataFrame([(1, "a"), (2, "keep"), (3, None)], docs.schema)
    for block in (1, 2, 1024):
        assert rows(details.apply_edits(text, chain, block)) == [(1, "f"), (2, "keep"), (3, None)]
    checked = rows(details.check_verbatim_edits(edits, docs).select("ord", "verbatim"))
    assert checked == [(1, True), (2, True), (3, False)]


def test_ats_checks(spark):
    docs = spark.createDataFrame(
        [(1, "Skills:\nSQL"), (2, "x\ty"), (3, "📧 mail\nskillset"), (4, None)], "doc_id bigint, text string"
    )
    got = {r.doc_id: r for r in matching.ats_readiness(docs).collect()}
    assert got[1].ats_readiness == 100
    assert (got[2].no_table, got[2].two_lines) == (False, False)
    assert (got[3].no_symbol, got[3].has_heading) == (False, False)
    assert got[4].ats_readiness == 40


def test_language_ties_and_silence(spark):
    docs = spark.createDataFrame(
        [(1, "the of und"), (2, "the und"), (3, "xyz"), (4, "của và là")], "doc_id bigint, text string"
    )
    got = rows(language.main_language(docs).select("doc_id", "main_lang"))
    assert got == [(1, "en"), (2, "de"), (3, None), (4, "vi")]


def test_document_frequency_keeps_unseen_terms(spark):
    jds = spark.createDataFrame([(1, "kubernetes")], "item_id bigint, text string")
    cvs = spark.createDataFrame([(1, "spark")], "doc_id bigint, text string")
    keys = terms.key_terms(terms.jd_postings(jds), terms.doc_terms(cvs), terms.row_count(cvs))
    assert rows(keys) == [(1, "kubernetes", 1, 0)]


PAIR_QUERIES = (
    "candidate_pairs", "keyword_coverage", "match_score", "rank_candidates", "matched_keywords",
    "missing_keywords", "claims_with_evidence", "ungrounded_terms", "jd_relevance_score",
)


@pytest.mark.parametrize("name", PAIR_QUERIES)
def test_no_pairwise_plans(spark, name):
    shape = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in shape
    assert "NestedLoop" not in shape
    assert "Python" not in shape and "Pandas" not in shape


def test_without_broadcast_the_results_are_the_same(spark):
    want = rows(QUERIES["match_score"](spark, SF))
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        df = QUERIES["match_score"](spark, SF)
        assert "Broadcast" not in plan(df)
        assert rows(df) == want
    finally:
        for k in off:
            spark.conf.unset(k)


def test_scans_read_only_what_they_need(spark):
    shape = plan(QUERIES["impact_evidence"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in shape
    log = plan(QUERIES["question_totals"](spark, SF))
    assert "BroadcastNestedLoop" not in log


def test_short_conversations_take_one_shuffle(spark):
    for name in ("qa_pairs", "question_progress", "attach_feedback"):
        assert plan(QUERIES[name](spark, SF)).count("Exchange") == 1


def test_ranking_prunes_before_the_shuffle(spark):
    shape = plan(QUERIES["rank_candidates"](spark, SF))
    assert "WindowGroupLimit" in shape and shape.index("Final") < shape.index("Partial")


@pytest.fixture(scope="module")
def crowd(spark):
    """4,000 CVs of which some fit a JD well; terms of every frequency, many equal scores."""
    picked = F.array(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(20 + 25 * i)) for i in range(12)])
    said = F.array_join(F.transform(picked, lambda x: F.concat(F.lit("word"), x.cast("string"))), " ")
    jd_words = [[f"word{x}" for x in (j, j + 8, 40 + 3 * j, 70 + 5 * j, 120 + 7 * j, 200 + j, 240 + j, 270 + j)] for j in range(8)]
    whole = F.get(F.array(*[F.lit(" ".join(w)) for w in jd_words]), (F.col("id") % 8).cast("int"))
    fits = F.when(F.col("id") % 37 == 0, whole).otherwise("")
    rest = F.when(F.col("id") % 7 < 2, "year 2020\nteam").otherwise("plain line")
    cvs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat_ws("\n", said, rest, fits).alias("text"))
    jds = spark.createDataFrame([(j, " ".join(w + w[:3])) for j, w in enumerate(jd_words)], "item_id bigint, text string")
    return matching.prepare(cvs, jds, True, matching.cv_scores(("team",)), max_df_percent=50, graded=True)


@pytest.mark.parametrize(("k", "weights"), [(1, (1, 1, 1, 1, 1)), (7, (3, 1, 2, 0, 0)), (20, (0, 0, 0, 1, 2)), (5000, (1, 0, 4, 1, 0))])
def test_top_candidates_are_the_best_of_all_pairs(crowd, k, weights):
    want = matching.rank_candidates(matching.match_score(crowd, weights), k)
    assert rows(ranking.top_candidates(crowd, k, weights, direct=0).select(*want.columns)) == rows(want)
    assert rows(ranking.top_candidates(crowd, k, weights).select(*want.columns)) == rows(want)


def test_hopeless_pairs_are_never_joined(crowd):
    k, weights = 10, (1, 1, 1, 1, 1)
    all_lines = matching._met(crowd).count()
    all_pairs = matching.candidate_pairs(crowd.hits, crowd.keys).count()
    levels = ranking.leveled(ranking.needs(crowd.keys, ranking.floors(crowd, k, weights), weights), weights)
    pairs = ranking.candidates(crowd, k, weights)
    joined = ranking.essential_hits(crowd, levels, weights).count()
    joined += ranking.pair_lines(crowd, ranking.by_document(pairs)).count()
    assert 4 * joined < all_lines
    assert 8 * pairs.count() < all_pairs


def test_scoring_moves_no_row(crowd):
    """The index lies by document and the key terms are broadcast."""
    for df in (matching.match_score(crowd), matching.experience_relevance(crowd), matching.pair_coverage(crowd)):
        shape = plan(df)
        assert "Exchange hashpartitioning" not in shape and "Bucketed: true" in shape
    asked = ranking.by_document(ranking.candidates(crowd, 3))
    assert "Exchange hashpartitioning" not in plan(matching.score_lines(ranking.pair_lines(crowd, asked)))


def test_details_read_the_texts_once_at_most(spark, crowd):
    pairs = ranking.top_candidates(crowd, 2).select("doc_id", "item_id")
    evidence = details.claims_with_evidence(pairs, details.top_claims(crowd.keys), crowd)
    assert "text#" not in plan(details.evidence_strength(evidence))
    shape = plan(QUERIES["ungrounded_terms"](spark, SF))
    assert shape.count("documents.parquet") == 1


def test_a_hot_term_and_a_hot_jd(spark):
    """One JD and one term hold most rows; nothing is lost."""
    n = 3000
    cvs = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.concat(F.when(F.col("id") % 3 > 0, "hotterm ").otherwise(""), F.lit("word"), F.col("id").cast("string"))
        .alias("text"),
    )
    jds = spark.createDataFrame(
        [(i, "hotterm") for i in range(20)] + [(99, "hotterm word7")], "item_id bigint, text string"
    )
    inputs = matching.prepare(cvs, jds, max_df_percent=100)
    pairs = matching.candidate_pairs(inputs.hits, inputs.keys)
    assert pairs.count() == 21 * 2 * n // 3
    assert pairs.filter("hits = 2").count() == 1


def test_layout_checks_do_not_cut_the_text(spark):
    """Two filled lines are found without splitting the text, on blanks of every kind."""
    rng = random.Random(6)
    pieces = ["\n", "\n", "\r\n", "\r", " ", "\t", "\x85", "\u00a0", "\ufeff", "|", "the", "a", "7", "#"]
    odd = ["".join(rng.choice(pieces) for _ in range(rng.randrange(9))) for _ in range(400)] + [None, "\n", "a\n", "a" * 50_000]
    cvs = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    made = cvs.select("text", *[c.alias(n) for n, c in matching.ats_checks("text", ("the",)).items()])
    assert "split(" not in plan(made)
    for r in made.collect():
        t = r.text or ""
        blank = re.compile(r"[\t-\r\x1c-\x20\x85\u00a0]*")
        assert r.two_lines == (sum(not blank.fullmatch(x) for x in re.split(r"\r?\n", t)) >= 2), t
        assert r.no_table == ("|" not in t and "\t" not in t), t
        assert r.has_heading == bool(re.search(r"(^|\n)[ \t]*#*[ \t]*the([^A-Za-z0-9]|$)", t)), t
