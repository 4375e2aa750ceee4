"""The registered queries: every operator over the whole given tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions import prompts, rules, text
from pairwright.functions import values as V
from pairwright.operators import cache, completion, conversations, details, interview, language
from pairwright.operators import matching, ranking, responses, templates, terms
from pairwright.plans import fixtures as fx
from pairwright.plans import scale
from pairwright.sources import catalog, tables
from pairwright.streaming import interviews as live
from pairwright.streaming import scoring, transcripts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TOP_K = 10
TOTAL = 3


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _inputs(spark: SparkSession, d: str, by_line: bool = False) -> matching.MatchInputs:
    return matching.prepare(fx.cvs(spark, d), fx.jds(spark, d), by_line)


def _scored_inputs(spark: SparkSession, d: str, graded: bool = False) -> matching.MatchInputs:
    scores = matching.cv_scores(fx.FIXTURE_HEADINGS)
    return matching.prepare(fx.cvs(spark, d), fx.jds(spark, d), True, scores, graded=graded)


def _top_pairs(inputs: matching.MatchInputs, k: int = TOP_K) -> DataFrame:
    """The best pairs by match score; written once because details join it repeatedly."""
    top = ranking.top_candidates(inputs, k).select("doc_id", "item_id")
    return scale.materialize(top, "top-pairs")


# --- sources and sinks -----------------------------------------------------------------


@query
def load_corpus(spark: SparkSession, d: str) -> DataFrame:
    cv = fx.cvs(spark, d).select(F.lit("cv").alias("kind"), F.col("doc_id").alias("id"), "text")
    jd = fx.jds(spark, d).select(F.lit("jd").alias("kind"), F.col("item_id").alias("id"), "text")
    return cv.unionByName(jd)


@query
def assemble_page_text(spark: SparkSession, d: str) -> DataFrame:
    pages = fx.turns(spark, d).withColumn("text", F.when(F.col("turn") % 5 != 3, F.col("text")))
    return tables.assemble_page_text(pages, "conv_id", "turn", "text")


@query
def route_requests(spark: SparkSession, d: str) -> DataFrame:
    ok, rejected = tables.route_requests(fx.requests(spark, d))
    kept = ok.select("request_id", "kind", F.lit(200).alias("code"), F.lit("accepted").alias("reason"))
    return kept.unionByName(rejected.select("request_id", "kind", "code", "reason"))


@query
def template_catalog(spark: SparkSession, d: str) -> DataFrame:
    found = templates.template_lookup_strict(fx.slug_requests(spark, d), catalog.template_catalog(spark))
    roles = F.aggregate(
        "template.experience", F.lit(0), lambda n, e: n + F.size(e["achievements"])
    )
    return found.groupBy("slug", "name", "title").agg(
        F.count(F.lit(1)).alias("n_requests"),
        F.max(F.size("keywords")).alias("n_keywords"),
        F.max(F.size("pro_tips")).alias("n_tips"),
        F.max(roles).alias("n_achievements"),
    )


@query
def result_sink(spark: SparkSession, d: str) -> DataFrame:
    scores = matching.keyword_coverage(_inputs(spark, d))
    path = scale.scratch_path(spark, "results")
    tables.write_results(scores, path)
    return tables.read_results(spark, path, scores.schema)


@query
def export_nested_json(spark: SparkSession, d: str) -> DataFrame:
    pairs = conversations.qa_pairs(fx.turns(spark, d))
    return tables.export_faq_json(pairs, "conv_id", "turn", "question", "answer")


# --- projections and checks --------------------------------------------------------------


@query
def normalize_roles(spark: SparkSession, d: str) -> DataFrame:
    return conversations.normalize_roles(fx.turns(spark, d)).select("conv_id", "turn", "role")


@query
def project_history(spark: SparkSession, d: str) -> DataFrame:
    return conversations.project_history(fx.turns(spark, d))


@query
def has_data(spark: SparkSession, d: str) -> DataFrame:
    return tables.has_data(fx.requests(spark, d)).select("request_id")


@query
def question_strategy(spark: SparkSession, d: str) -> DataFrame:
    rows = conversations.question_progress(fx.turns(spark, d), TOTAL)
    return rows.select(
        "conv_id", "turn", "question_no",
        rules.question_strategy("question_no", F.lit(TOTAL)).alias("strategy"),
    )


@query
def score_band(spark: SparkSession, d: str) -> DataFrame:
    score = F.floor(rules.clamp("value", 0.0, 100.0)).cast("bigint")
    rows = fx.table(spark, d, "events").select("event_id", score.alias("score"))
    return rows.withColumns({k: rules.score_band("score", k) for k in rules.BANDS})


@query
def confidence_band(spark: SparkSession, d: str) -> DataFrame:
    rows = confidence_score(spark, d)
    return rows.withColumn("band", rules.confidence_band("confidence_score"))


@query
def check_enums(spark: SparkSession, d: str) -> DataFrame:
    def pick(options: tuple[str, ...], n: int):
        values = F.array(*[F.lit(o) for o in options], F.lit("Unknown"), F.lit(None).cast("string"))
        return F.get(values, (F.col("doc_id") % n).cast("int"))

    rows = fx.table(spark, d, "labels").select(
        "doc_id",
        pick(V.VOCABULARY_RATINGS, 6).alias("rating"),
        pick(V.PRIORITIES, 5).alias("priority"),
        pick(V.EVIDENCE_STRENGTHS, 6).alias("strength"),
    )
    specs = {
        "rating": V.VOCABULARY_RATINGS, "priority": V.PRIORITIES, "strength": V.EVIDENCE_STRENGTHS
    }
    shown = responses.enum_display("priority", {"High": "red", "Medium": "orange"}, "green")
    return responses.check_enums(rows, specs).select(
        "doc_id", responses.violation_text().alias("violations"), shown.alias("badge")
    )


@query
def check_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.table(spark, d, "labels").select(
        "doc_id",
        (F.col("quality") * 60 + F.col("doc_id") % 50).alias("overall_score"),
        F.when(F.col("doc_id") % 9 != 0, F.col("toxic") * 90 - F.col("doc_id") % 5).alias("ats_readiness"),
    )
    return responses.check_ranges(rows, ["overall_score", "ats_readiness"]).select(
        "doc_id", "overall_score", "ats_readiness", responses.violation_text().alias("violations")
    )


@query
def check_list_sizes(spark: SparkSession, d: str) -> DataFrame:
    seen = F.col("seen")
    rows = fx.cvs(spark, d).select("doc_id", "text", text.distinct_tokens("text").alias("seen")).select(
        "doc_id",
        F.filter(seen, lambda t: F.length(t) >= 14).alias("missing_keywords"),
        text.lines("text").alias("cv_strengths"),
        F.filter(seen, lambda t: F.length(t) == 2).alias("sub_scores"),
        F.filter(seen, lambda t: F.length(t) == 1).alias("tips"),
    )
    return responses.check_list_sizes(rows).select(
        "doc_id", responses.violation_text().alias("violations")
    )


@query
def check_verbatim_edits(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.cvs(spark, d)
    return details.check_verbatim_edits(fx.edits(docs), docs).select("doc_id", "ord", "verbatim")


@query
def check_channel_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.cvs(spark, d).withColumns(
        {"channel": fx.channel(3), "subject": fx.every("doc_id", 2, F.lit(" "), F.lit("S"))}
    )
    broken = completion.check_channel_rules("channel", "subject", "text")
    return rows.withColumn("violations", broken).select(
        "doc_id", "channel", responses.violation_text().alias("violations")
    )


@query
def default_fields(spark: SparkSession, d: str) -> DataFrame:
    labels = fx.table(spark, d, "labels").withColumns(
        {"topics": F.array(F.lit("a"), F.lit("b")), "note": F.lit("labelled")}
    )
    joined = fx.documents(spark, d).select("doc_id").join(labels, "doc_id", "left")
    filled = responses.default_fields(joined, {"quality": 0, "topics": [], "note": ""})
    return filled.select("doc_id", "quality", text.join_keywords("topics").alias("topics"), "note")


@query
def progress_pct(spark: SparkSession, d: str) -> DataFrame:
    return conversations.completion(fx.turns(spark, d), TOTAL)


# --- joins -----------------------------------------------------------------------------------


@query
def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    inputs = _inputs(spark, d)
    return matching.candidate_pairs(inputs.hits, inputs.keys).drop("n_key_terms", "key_tf")


@query
def matched_keywords(spark: SparkSession, d: str) -> DataFrame:
    inputs = _scored_inputs(spark, d)
    return details.matched_keywords(_top_pairs(inputs), inputs)


@query
def missing_keywords(spark: SparkSession, d: str) -> DataFrame:
    inputs = _scored_inputs(spark, d)
    return details.missing_keywords(_top_pairs(inputs), inputs)


def _evidence(spark: SparkSession, d: str) -> tuple[DataFrame, matching.MatchInputs]:
    inputs = _scored_inputs(spark, d, graded=True)
    claims = details.top_claims(inputs.keys)
    return details.claims_with_evidence(_top_pairs(inputs), claims, inputs), inputs


@query
def claims_with_evidence(spark: SparkSession, d: str) -> DataFrame:
    evidence, inputs = _evidence(spark, d)
    stored = scale.materialize(evidence, "evidence")
    return details.with_lines(stored, inputs.cvs).select("doc_id", "item_id", "claim", "line_no", "line")


@query
def template_lookup_fallback(spark: SparkSession, d: str) -> DataFrame:
    found = templates.template_lookup_fallback(fx.slug_requests(spark, d), catalog.template_catalog(spark))
    return found.select(
        "c_custkey", "slug", "known", "name", "title", "page_title", "page_description",
        "page_keywords", text.join_keywords("keywords").alias("keywords"),
        F.size("pro_tips").alias("n_tips"),
    )


@query
def template_lookup_strict(spark: SparkSession, d: str) -> DataFrame:
    found = templates.template_lookup_strict(fx.slug_requests(spark, d), catalog.template_catalog(spark))
    return found.select("c_custkey", "slug", "title", text.join_keywords("keywords").alias("keywords"))


def _other_key(n: int):
    """The document's id as key for every n-th one, an unused key for the others."""
    return fx.every("doc_id", n, F.col("doc_id"), -F.col("doc_id") - 1).alias("key")


@query
def uncached_requests(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.documents(spark, d)
    reqs = docs.select(
        F.col("doc_id").alias("key"), F.col("text").alias("cv_text"), F.col("source").alias("jd_text")
    )
    old = fx.every("doc_id", 6, F.concat("text", F.lit("!")), F.col("text"))
    stored = docs.select(_other_key(3), old.alias("cv_text"), F.col("source").alias("jd_text"))
    return cache.uncached_requests(reqs, cache.with_hashes(stored)).select("key")


@query
def language_consistency(spark: SparkSession, d: str) -> DataFrame:
    return language.language_consistency(fx.turns(spark, d))


@query
def ungrounded_terms(spark: SparkSession, d: str) -> DataFrame:
    inputs = _inputs(spark, d)
    generated = inputs.cvs.select((F.col("doc_id") - 1).alias("doc_id"), "text")
    return language.ungrounded_terms(generated, inputs.hits, inputs.keys)


@query
def apply_edits(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.cvs(spark, d)
    return details.apply_edits(docs, fx.edits(docs))


# --- aggregations ------------------------------------------------------------------------------


@query
def term_document_freq(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_document_freq(fx.cvs(spark, d))


@query
def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    return matching.keyword_coverage(_inputs(spark, d))


@query
def technical_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.technical_match(_inputs(spark, d))


@query
def experience_relevance(spark: SparkSession, d: str) -> DataFrame:
    return matching.experience_relevance(_inputs(spark, d, by_line=True))


@query
def impact_evidence(spark: SparkSession, d: str) -> DataFrame:
    return fx.cvs(spark, d).select("doc_id", matching.impact_evidence().alias("impact_evidence"))


@query
def ats_readiness(spark: SparkSession, d: str) -> DataFrame:
    return matching.ats_readiness(fx.cvs(spark, d), fx.FIXTURE_HEADINGS).drop("text")


@query
def match_score(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_score(_scored_inputs(spark, d))


@query
def evidence_strength(spark: SparkSession, d: str) -> DataFrame:
    return details.evidence_strength(_evidence(spark, d)[0])


@query
def keyword_priority(spark: SparkSession, d: str) -> DataFrame:
    return details.keyword_priority(fx.jds(spark, d))


@query
def main_language(spark: SparkSession, d: str) -> DataFrame:
    return language.main_language(fx.documents(spark, d)).select("doc_id", "lang", "main_lang")


@query
def sub_score_grid(spark: SparkSession, d: str) -> DataFrame:
    names = ("click", "error", "purchase", "signup", "view")
    return interview.sub_score_grid(fx.category_scores(spark, d), names)


@query
def role_counts(spark: SparkSession, d: str) -> DataFrame:
    return conversations.role_counts(fx.turns(spark, d))


@query
def question_totals(spark: SparkSession, d: str) -> DataFrame:
    return conversations.question_totals(fx.turns(spark, d))


@query
def overall_score(spark: SparkSession, d: str) -> DataFrame:
    return interview.overall_score(fx.category_scores(spark, d))


@query
def provider_health(spark: SparkSession, d: str) -> DataFrame:
    log = fx.attempts(spark, d)
    dead = completion.all_failed(log).agg(F.count(F.lit(1)).alias("failed_requests"))
    return completion.provider_health(log).withColumn("failed_requests", dead.scalar())


# --- interview metrics -----------------------------------------------------------------------


@query
def confidence_score(spark: SparkSession, d: str) -> DataFrame:
    score = interview.confidence_score("text", fx.FIXTURE_FILLERS)
    return interview.answers(fx.turns(spark, d)).select(
        "conv_id", "turn", score.alias("confidence_score")
    )


def _jd_lists(spark: SparkSession, d: str) -> DataFrame:
    lists = interview.jd_term_lists(*terms.corpus_key_terms(fx.cvs(spark, d), fx.jds(spark, d)))
    return scale.materialize(lists, "jd-lists")


def _metrics(spark: SparkSession, d: str, turns: DataFrame) -> DataFrame:
    return interview.turn_metrics(turns, fx.interviews(spark, d), _jd_lists(spark, d), fx.FIXTURE_FILLERS)


@query
def jd_relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return interview.jd_relevance_score(_metrics(spark, d, fx.turns(spark, d)))


@query
def tech_vocab_rating(spark: SparkSession, d: str) -> DataFrame:
    return interview.tech_vocab_rating(_metrics(spark, d, fx.turns(spark, d)))


@query
def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    return interview.metrics_rollup(_metrics(spark, d, fx.turns(spark, d)))


# --- order-dependent walks -----------------------------------------------------------------------


@query
def qa_pairs(spark: SparkSession, d: str) -> DataFrame:
    return conversations.qa_pairs(fx.turns(spark, d))


@query
def attach_feedback(spark: SparkSession, d: str) -> DataFrame:
    return conversations.attach_feedback(fx.turns(spark, d).withColumn("fb", F.col("text")), "fb")


@query
def latest_prompt(spark: SparkSession, d: str) -> DataFrame:
    hint = F.when(F.col("turn") % 4 != 3, F.concat(F.lit("hint "), F.col("turn").cast("string")))
    return conversations.latest_prompt(fx.turns(spark, d).withColumn("hint_for_user", hint))


@query
def question_progress(spark: SparkSession, d: str) -> DataFrame:
    return conversations.question_progress(fx.turns(spark, d), TOTAL).drop("text")


@query
def first_valid_response(spark: SparkSession, d: str) -> DataFrame:
    log = fx.attempts(spark, d)
    return completion.first_valid_response(log.select("request_id"), log)


@query
def cache_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = fx.documents(spark, d)
    old = docs.select(F.col("doc_id").alias("key"), F.col("source").alias("content"), F.lit(1).alias("version"))
    version = (F.col("doc_id") % 3).cast("int").alias("version")
    new = docs.select(_other_key(4), F.col("lang").alias("content"), version)
    return cache.cache_upsert(old, new)


# --- top-k ------------------------------------------------------------------------------------------


@query
def top_missing_keywords(spark: SparkSession, d: str) -> DataFrame:
    return details.top_missing_keywords(missing_keywords(spark, d))


@query
def weakest_lines(spark: SparkSession, d: str) -> DataFrame:
    return details.weakest_lines(fx.cvs(spark, d))


@query
def strengths_and_gaps(spark: SparkSession, d: str) -> DataFrame:
    return interview.strengths_and_gaps(fx.category_scores(spark, d))


@query
def keyword_preview(spark: SparkSession, d: str) -> DataFrame:
    named = F.split(F.concat_ws(" ", "p_name", "p_type", "p_brand"), " ")
    keywords = fx.every("p_partkey", 3, F.array("p_type"), named)
    shown = fx.table(spark, d, "part").withColumn("p", templates.keyword_preview(keywords))
    return shown.select("p_partkey", text.join_keywords("p.preview").alias("preview"), "p.more")


@query
def rank_candidates(spark: SparkSession, d: str) -> DataFrame:
    ranked = ranking.top_candidates(_scored_inputs(spark, d), TOP_K)
    return ranked.select("item_id", "rank", "doc_id", "match_score")


@query
def order_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return details.order_by_priority(keyword_priority(spark, d))


@query
def top_topics(spark: SparkSession, d: str) -> DataFrame:
    return language.top_topics(fx.turns(spark, d))


# --- message lists -----------------------------------------------------------------------------------


@query
def build_messages(spark: SparkSession, d: str) -> DataFrame:
    turns = fx.turns(spark, d)
    prompt = F.concat(F.lit("Interview "), F.col("conv_id").cast("string"))
    system = turns.select("conv_id").distinct().withColumn("content", prompt)
    history = conversations.project_history(conversations.normalize_roles(turns))
    return conversations.build_messages(history, system)


@query
def append_response(spark: SparkSession, d: str) -> DataFrame:
    turns = fx.turns(spark, d)
    named = F.concat(F.lit("Q"), F.col("conv_id").cast("string"))
    replies = turns.select("conv_id").distinct().select(
        "conv_id",
        F.when(F.col("conv_id") % 5 != 0, named).alias("next_question"),
        F.lit("hint").alias("hint_for_user"),
    )
    return conversations.append_response(turns, replies)


@query
def seed_empty_history(spark: SparkSession, d: str) -> DataFrame:
    turns = fx.turns(spark, d)
    ids = turns.select("conv_id").distinct()
    return conversations.seed_empty_history(
        turns, ids.unionByName(ids.select((-F.col("conv_id") - 1).alias("conv_id")))
    )


# --- column functions ------------------------------------------------------------------------------------


@query
def strip_text(spark: SparkSession, d: str) -> DataFrame:
    padded = F.concat(F.lit(" \t "), F.col("text"), F.lit("  \n"))
    return fx.cvs(spark, d).select("doc_id", text.strip_text(padded).alias("stripped"))


@query
def word_count(spark: SparkSession, d: str) -> DataFrame:
    body = fx.every("doc_id", 9, F.lit("  \n"), F.col("text"))
    return fx.cvs(spark, d).select(
        "doc_id", text.word_count(body).alias("n_words"), text.word_label(body).alias("label")
    )


@query
def clamp(spark: SparkSession, d: str) -> DataFrame:
    pick = F.col("event_id") % 10
    value = F.when(pick == 1, F.lit(float("nan"))).when(pick != 0, F.col("value"))
    bounded = rules.clamp("v", 10.0, 100.0)
    return fx.table(spark, d, "events").select("event_id", value.alias("v")).select(
        "event_id", F.isnan("v").alias("is_nan"), F.when(~F.isnan("v"), bounded).alias("clamped")
    )


@query
def preview_text(spark: SparkSession, d: str) -> DataFrame:
    short = F.concat(F.lit("JD "), F.col("id").cast("string"))
    body = fx.every("id", 4, short, F.col("text"))
    return load_corpus(spark, d).select("kind", "id", text.preview_text(body).alias("preview"))


@query
def slug_to_name(spark: SparkSession, d: str) -> DataFrame:
    slug = fx.every("c_custkey", 7, F.lit(""), F.col("slug"))
    return fx.slug_requests(spark, d).select("c_custkey", text.slug_to_name(slug).alias("name"))


@query
def join_keywords(spark: SparkSession, d: str) -> DataFrame:
    return fx.table(spark, d, "part").select(
        "p_partkey", text.join_keywords(F.array("p_brand", "p_type", "p_name")).alias("keywords")
    )


@query
def render_nested_record(spark: SparkSession, d: str) -> DataFrame:
    """A record for each customer: orders as roles, their lines as achievements, all in order."""
    lines = fx.table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    orders = fx.table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")

    def named(label: str, col: str):
        return F.concat(F.lit(label + " "), F.col(col).cast("string"))

    bought = F.concat(named("part", "l_partkey"), F.lit(" x "), F.col("l_quantity").cast("bigint").cast("string"))
    items = templates.nest(lines, "o_orderkey", ("l_linenumber", "l_partkey", "l_quantity"), bought, "achievements")
    role = F.struct(
        named("order", "o_orderkey").alias("role"), F.col("o_orderpriority").alias("company"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("period"),
        F.coalesce("achievements", F.array().cast("array<string>")).alias("achievements"),
    )
    roles = templates.nest(orders.join(items, "o_orderkey", "left"), "c_custkey", ("o_orderkey",), role, "experience")
    record = F.struct(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("title"), named("customer", "c_custkey").alias("contact"),
        F.concat(F.coalesce(F.size("experience"), F.lit(0)).cast("string"), F.lit(" orders")).alias("summary"),
        F.coalesce("experience", F.array()).alias("experience"), F.lit("none").alias("education"),
        F.array("c_mktsegment", "c_name").alias("skills"),
    )
    customers = fx.table(spark, d, "customer").join(roles, "c_custkey", "left")
    return customers.select("c_custkey", text.render_nested_record(record).alias("body"))


@query
def build_prompts(spark: SparkSession, d: str) -> DataFrame:
    inputs = _scored_inputs(spark, d)
    pairs = _top_pairs(inputs)
    texts = (
        pairs.join(inputs.cvs.withColumnRenamed("text", "cv"), "doc_id")
        .join(inputs.jds.withColumnRenamed("text", "jd"), "item_id")
    )
    current = F.col("item_id") % 5 + 1
    return texts.select(
        "doc_id", "item_id",
        prompts.match_input("cv", "jd").alias("match_input"),
        prompts.analysis_input("cv", "jd").alias("analysis_input"),
        prompts.interview_prompt("cv", "jd", current, F.lit(5)).alias("interview"),
        prompts.report_prompt("cv", "jd").alias("report"),
    )


@query
def build_writer_prompt(spark: SparkSession, d: str) -> DataFrame:
    custom = fx.every("doc_id", 2, F.col("source"), F.lit(""))
    rows = fx.documents(spark, d).withColumns({"channel": fx.channel(5), "custom": custom})
    return rows.select(
        "doc_id", prompts.writer_prompt("channel", F.lit(V.DEFAULT_TONE), "custom").alias("prompt")
    )


@query
def copy_text(spark: SparkSession, d: str) -> DataFrame:
    subject = fx.every("doc_id", 2, F.lit(""), F.col("source"))
    return fx.documents(spark, d).select("doc_id", text.copy_text(subject, "text").alias("body"))


@query
def ensure_json_instruction(spark: SparkSession, d: str) -> DataFrame:
    prompt = fx.every("doc_id", 2, F.concat("text", F.lit(" as Json")), F.col("text"))
    return fx.cvs(spark, d).select("doc_id", prompts.ensure_json_instruction(prompt).alias("prompt"))


@query
def flatten_history(spark: SparkSession, d: str) -> DataFrame:
    return conversations.flatten_history(conversations.normalize_roles(fx.turns(spark, d)))


@query
def request_key(spark: SparkSession, d: str) -> DataFrame:
    key = text.request_key(fx.channel(5), F.lit(V.DEFAULT_TONE), "text", "source")
    return fx.documents(spark, d).select("doc_id", key.alias("key"))


# --- structured responses ----------------------------------------------------------------------------


@query
def parse_responses(spark: SparkSession, d: str) -> DataFrame:
    parsed = responses.parse_responses(fx.raw_responses(spark, d), "raw", "interview_turn")
    return parsed.select(
        "doc_id", "error", "parsed.next_question", "parsed.metrics.confidence_score",
        "parsed.metrics.jd_relevance_score", "parsed.metrics.tech_vocab_rating",
    )


@query
def explode_experience(spark: SparkSession, d: str) -> DataFrame:
    def entry(company: str, role: str, *bullets: str):
        listed = F.array(*bullets) if bullets else F.array().cast("array<string>")
        return F.struct(
            F.lit(company).alias("company"), F.lit(role).alias("role"), listed.alias("bullet_points")
        )

    entries = F.array(
        entry("first", "r1", "o_orderstatus", "o_orderpriority"), entry("second", "r2")
    )
    nested = fx.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, entries).alias("experience")
    )
    return responses.explode_experience(nested, "o_orderkey")


@query
def explode_report(spark: SparkSession, d: str) -> DataFrame:
    """All lists of a report and an analysis made of each document's long words and lines."""
    long, said = F.filter(text.tokens("text"), lambda t: F.length(t) >= 14), text.lines("text")
    rows = fx.cvs(spark, d).select("doc_id", long.alias("w"), said.alias("l"))

    def items(of: str, **fields):
        return F.transform(of, lambda x: F.struct(*[f(x).alias(n) for n, f in fields.items()]))

    def even(x):
        return F.length(x) % 2 == 0

    def const(value: str):
        return lambda x: F.lit(value)

    report = F.struct(
        F.length(F.array_join("w", "")).alias("overall_score"),
        items("w", category=lambda x: x, score=F.length, label=const("L")).alias("sub_scores"),
        F.col("w").alias("key_strengths"),
        F.filter("w", even).alias("areas_for_improvement"),
        F.filter("w", lambda x: ~even(x)).alias("top_topics_covered"),
        items("l", question=lambda x: x, user_answer=lambda x: F.left(x, F.lit(9)), feedback=const("f"), ideal_answer_snippet=const(""))
        .alias("turn_by_turn_analysis"),
    )
    analysis = F.struct(
        F.slice("w", 1, 5).alias("missing_keywords"),
        items("l", section=const("s"), original_text=lambda x: x, upgraded_text=lambda x: F.concat(F.lit("* "), x), reason=const("r"))
        .alias("suggested_edits"),
        F.col("l").alias("cv_strengths"),
        items("w", keyword=lambda x: x, priority=lambda x: F.when(even(x), "High").otherwise("Low")).alias("prioritized_keywords"),
        items("w", claim=lambda x: x, evidence_strength=const("Weak"), comment=const("")).alias("evidence_analysis"),
    )
    parsed = rows.select("doc_id", F.struct(report.alias("report"), analysis.alias("analysis")).alias("parsed"))
    return responses.explode_children(parsed, "doc_id").select(
        "doc_id", "child", F.get("pos", F.lit(0)).alias("pos"), F.array_join(F.map_values("item"), "|").alias("value")
    )


# --- completion and streams ------------------------------------------------------------------------


def _fake(rank: int):
    """Deterministic provider: 0 raises, 1 answers badly, 2 is empty, by text length."""

    def call(messages: list[dict]) -> str:
        if "JSON" not in messages[0]["content"]:
            raise RuntimeError("no JSON was asked for")
        n = len(messages[-1]["content"])
        if rank == 0 and n % 3 == 0:
            raise RuntimeError("rate limit")
        if rank == 1 and n % 2 == 0:
            return '{"subject_line": 1}'
        if rank == 2 and n % 5 == 0:
            return ""
        return json.dumps({"subject_line": f"p{rank}", "content": f"{n} chars", "tips": ["t"]})

    return call


@query
def complete_batch(spark: SparkSession, d: str) -> DataFrame:
    fx.ship_package(spark)
    system = F.lit("Write a short message for this text.")
    reqs = fx.cvs(spark, d).select(
        F.col("doc_id").alias("request_id"), system.alias("system"), F.col("text").alias("prompt")
    )
    done, _ = completion.complete_batch(reqs, [_fake(0), _fake(1), _fake(2)], "writer", pause=0.0)
    return done.select("request_id", "status", "provider_rank", "last_error", "parsed.subject_line", "parsed.content")


def _run(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, into a table, and read the table."""
    spark = stream.sparkSession
    path, state = scale.scratch_path(spark, name), scale.scratch_path(spark, name + "-state")
    job = (
        stream.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _stream(spark: SparkSession, d: str, name: str, columns: list[str]) -> DataFrame:
    """The table as a stream, be it one file or a folder of files; a stream takes a single file only by a pattern."""
    schema = fx.table(spark, d, name).select(*columns).schema
    return spark.readStream.schema(schema).parquet(f"{d}/{name}.parque[t]")


@query
def stream_transcripts(spark: SparkSession, d: str) -> DataFrame:
    fx.ship_package(spark)
    events = _stream(spark, d, "events", ["event_id", "user_id", "event_type"])
    deltas = _run(transcripts.stream_transcripts(fx.as_fragments(events)), "transcripts")
    return transcripts.assemble_deltas(deltas)


@query
def stream_interviews(spark: SparkSession, d: str) -> DataFrame:
    fx.ship_package(spark)
    turns = _stream(spark, d, "conversations", ["conv_id", "turn", "role", "text"])
    scored = _metrics(spark, d, turns)
    return live.current_states(_run(live.stream_interviews(scored, TOTAL), "interviews"), TOTAL)


@query
def stream_incremental_scoring(spark: SparkSession, d: str) -> DataFrame:
    """Two drops: all documents, then the changed ones; a third of the JDs change in between."""
    keys = scale.materialize(terms.corpus_key_terms(fx.cvs(spark, d), fx.jds(spark, d))[0], "all-keys")
    draft = keys.filter((F.col("item_id") % 3 != 0) | (F.length("term") % 2 == 0)).drop("n_key_terms", "key_tf")
    draft = scale.materialize(terms.with_totals(draft), "draft-keys")
    source, out = scale.scratch_path(spark, "drops"), scale.scratch_path(spark, "scores")
    docs = fx.cvs(spark, d)
    changed = F.concat("text", F.lit(" draft"))
    first = docs.select(
        "doc_id", fx.every("doc_id", 3, changed, F.col("text")).alias("text"), F.lit(1).alias("version")
    )
    second = docs.filter(F.col("doc_id") % 3 == 0).select("doc_id", "text", F.lit(2).alias("version"))
    for drop, known in ((first, draft), (second, keys)):
        drop.write.mode("append").parquet(source)
        stream = spark.readStream.schema(first.schema).parquet(source)
        job = scoring.stream_incremental_scoring(
            stream, known, out, out + "-state", matching.cv_scores(fx.FIXTURE_HEADINGS)
        )
        job.awaitTermination()
    return scoring.current_scores(spark, out)
