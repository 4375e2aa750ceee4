"""Plain SQL for the registered queries, for an independent engine to run."""

from __future__ import annotations

from pairwright.functions import prompts as P
from pairwright.functions import rules
from pairwright.functions import values as V
from pairwright.plans import fixtures as fx
from pairwright.sources import catalog as C

ORACLES: dict[str, str] = {}

SERVER_SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"
CLIENT_SPACE = r"[\t-\r\x{feff}\p{Z}]"
TOP_K = 10
TOTAL = 3


def q(value: str) -> str:
    """A string as SQL literal."""
    quoted = value.replace("'", "''")
    return "'" + "'||chr(10)||'".join(quoted.split("\n")) + "'" if "\n" in quoted else f"'{quoted}'"


def q_list(values) -> str:
    return ", ".join(q(v) for v in values)


def strip(x: str, space: str = SERVER_SPACE) -> str:
    return rf"regexp_replace({x}, '\A{space}+|{space}+\z', '', 'g')"


def tokens(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{CLIENT_SPACE}+'), lambda w: w <> '')"


def lines(x: str) -> str:
    return rf"string_split_regex({x}, '\r?\n')"


def filled_lines(x: str) -> str:
    return f"list_filter({lines(x)}, lambda l: {strip('l')} <> '')"


def pct(h: str, n: str) -> str:
    return f"(CASE WHEN {n} = 0 THEN 0 ELSE (200 * ({h}) + {n}) // (2 * ({n})) END)::BIGINT"


def mean(s: str, n: str) -> str:
    return f"((2 * ({s}) + {n}) // (2 * ({n})))::BIGINT"


def bands(x: str, steps) -> str:
    arms = " ".join(f"WHEN {x} >= {b} THEN {q(t.replace('{brand}', V.BRAND))}" for b, t in steps if b is not None)
    rest = next(t.replace("{brand}", V.BRAND) for b, t in steps if b is None)
    return f"(CASE {arms} WHEN {x} IS NOT NULL THEN {q(rest)} END)"


def pick(index: str, values) -> str:
    return f"list_extract([{q_list(values)}], ({index} + 1)::INT)"


def fill(template: str, **parts: str) -> str:
    """Template with slots as an SQL concatenation."""
    out, rest = [], template
    while rest:
        found = sorted((rest.find("{" + k + "}"), k) for k in parts if "{" + k + "}" in rest)
        if not found:
            out.append(q(rest))
            break
        at, key = found[0]
        if at:
            out.append(q(rest[:at]))
        out.append(f"coalesce(({parts[key]})::VARCHAR, '')")
        rest = rest[at + len(key) + 2 :]
    return "(" + " || ".join(out) + ")"


# --- shared tables -------------------------------------------------------------------

JD_TERMS = f"""
jd_terms AS (
  SELECT item_id, term, count(*) AS tf
  FROM (SELECT item_id, unnest({tokens('text')}) AS term FROM benchmark)
  WHERE length(term) >= 3 GROUP BY item_id, term)"""

KEYS = f"""{JD_TERMS},
cv_terms AS (SELECT doc_id, unnest(list_distinct({tokens('text')})) AS term FROM documents),
dfs AS (SELECT term, count(*) AS df FROM cv_terms GROUP BY term),
key_terms AS (
  SELECT j.item_id, j.term, j.tf FROM jd_terms j LEFT JOIN dfs USING (term)
  WHERE coalesce(df, 0) * 10 <= (SELECT count(*) FROM documents)),
totals AS (
  SELECT item_id, count(*) AS n_key_terms, sum(tf)::BIGINT AS key_tf FROM key_terms GROUP BY item_id)"""

PAIRS = f"""{KEYS},
pairs AS (
  SELECT doc_id, item_id, count(*) AS hits, sum(tf)::BIGINT AS hit_tf
  FROM cv_terms JOIN key_terms USING (term) GROUP BY doc_id, item_id),
coverage AS (
  SELECT doc_id, item_id, hits, n_key_terms, {pct('hits', 'n_key_terms')} AS keyword_coverage,
         {pct('hit_tf', 'key_tf')} AS technical_match
  FROM pairs JOIN totals USING (item_id))"""


RELEVANCE = f"""
line_terms AS (
  SELECT doc_id, line_no, unnest(list_distinct({tokens('line')})) AS term
  FROM (SELECT doc_id, unnest(range(len({lines('text')}))) AS line_no, unnest({lines('text')}) AS line
        FROM documents)),
relevance AS (
  SELECT doc_id, item_id, {pct('max(hits)', 'any_value(n_key_terms)')} AS experience_relevance
  FROM (SELECT doc_id, item_id, line_no, count(*) AS hits
        FROM line_terms JOIN key_terms USING (term) GROUP BY doc_id, item_id, line_no)
  JOIN totals USING (item_id) GROUP BY doc_id, item_id)"""

N_DIGIT_LINES = f"len(list_filter({filled_lines('text')}, lambda l: regexp_matches(l, '[0-9]')))"
IMPACT = pct(N_DIGIT_LINES, f"len({filled_lines('text')})")
HEADING = (
    r"regexp_matches(lower(text), '(^|\n)[ \t]*#*[ \t]*(" + "|".join(fx.FIXTURE_HEADINGS)
    + r")([^\p{L}\p{N}]|$)')"
)
ATS = f"""
ats_checks AS (
  SELECT doc_id, {strip('text')} <> '' AS has_text, NOT regexp_matches(text, '[|\\t]') AS no_table,
         NOT regexp_matches(text, '\\p{{So}}') AS no_symbol,
         len({filled_lines('text')}) >= 2 AS two_lines, {HEADING} AS has_heading
  FROM documents),
ats AS (
  SELECT *, 20 * (has_text::BIGINT + no_table::BIGINT + no_symbol::BIGINT + two_lines::BIGINT
                  + has_heading::BIGINT) AS ats_readiness FROM ats_checks)"""

SCORES = f"""{PAIRS}, {RELEVANCE}, {ATS},
impact AS (SELECT doc_id, {IMPACT} AS impact_evidence FROM documents),
scores AS (
  SELECT doc_id, item_id, keyword_coverage, technical_match, experience_relevance,
         impact_evidence, ats_readiness,
         (2 * (keyword_coverage + technical_match + experience_relevance + impact_evidence
               + ats_readiness) + 5) // 10 AS match_score
  FROM coverage JOIN relevance USING (doc_id, item_id) JOIN impact USING (doc_id)
  JOIN ats USING (doc_id))"""

def top_pairs(k: int = TOP_K) -> str:
    return f"""{SCORES},
top_pairs AS (
  SELECT doc_id, item_id FROM scores
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY match_score DESC, doc_id) <= {k})"""


MISSING = f"""{top_pairs()},
missing AS (
  SELECT p.doc_id, p.item_id, k.term, k.tf FROM top_pairs p JOIN key_terms k USING (item_id)
  WHERE NOT EXISTS (SELECT 1 FROM cv_terms c WHERE c.doc_id = p.doc_id AND c.term = k.term))"""

EVIDENCE = f"""{top_pairs()},
claims AS (
  SELECT item_id, term AS claim FROM key_terms
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY tf DESC, term) <= 5),
text_lines AS (
  SELECT doc_id, unnest(range(len({lines('text')}))) AS line_no, unnest({lines('text')}) AS line
  FROM documents WHERE doc_id IN (SELECT doc_id FROM top_pairs)),
mentions AS (
  SELECT doc_id, line_no, line, unnest(list_distinct({tokens('line')})) AS claim FROM text_lines),
evidence AS (
  SELECT p.doc_id, p.item_id, c.claim, m.line_no, m.line
  FROM top_pairs p JOIN claims c USING (item_id)
  LEFT JOIN mentions m ON m.doc_id = p.doc_id AND m.claim = c.claim)"""

KINDS = ("upload", "extract", "analyze", "finish", "speech", "writer")
REQUESTS = f"""
requests AS (
  SELECT doc_id AS request_id, {pick('doc_id % 6', KINDS)} AS kind,
         doc_id % 11 <> 0 AS is_pdf, doc_id % 13 <> 0 AS parsed,
         {strip("CASE WHEN doc_id % 7 = 0 THEN '  ' || chr(10) ELSE text END")} = '' AS no_cv,
         {strip("CASE WHEN doc_id % 17 = 0 THEN ' ' ELSE source END")} = '' AS no_jd,
         doc_id % 4 AS n_messages
  FROM documents)"""

SLUGS = """
slugs AS (
  SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'it-phan-mem' WHEN 1 THEN 'marketing'
                    WHEN 2 THEN 'nhan-su-hr' ELSE replace(lower(n_name), '_', '-') END AS slug
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_RECORDS = [dict(zip(C.CATALOG_SCHEMA.names, C._record(*r), strict=True)) for r in C.INDUSTRIES]
_GENERIC = dict(zip(C.CATALOG_SCHEMA.names, C.fallback_record(), strict=True))
_ROWS = ", ".join(
    f"({q(r['slug'])}, {q(r['name'])}, {q(r['title'])}, {q(', '.join(r['keywords']))}, "
    f"{len(r['keywords'])}, {len(r['pro_tips'])}, {sum(len(e[3]) for e in r['template'][4])})"
    for r in _RECORDS
)
CATALOG = f"""
catalog(slug, name, title, keywords, n_keywords, n_tips, n_achievements) AS (VALUES {_ROWS})"""

TURNS_BEFORE = """
progress AS (
  SELECT conv_id, turn, role, text, answered, answers_before,
         least(answers_before + 1, {total}) AS question_no,
         answered AND answers_before = {total} - 1 AS finishes
  FROM (SELECT *, coalesce(sum(answered::BIGINT) OVER (PARTITION BY conv_id ORDER BY turn
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS answers_before
        FROM (SELECT *, role = 'user' AND {strip} <> '' AS answered FROM conversations))
  WHERE answers_before < {total})""".format(total=TOTAL, strip=strip("text"))

ATTEMPTS = """
attempts AS (
  SELECT event_id // 3 AS request_id, event_id % 3 AS provider_rank, 1 AS attempt,
         CASE WHEN event_type <> 'error' THEN props END AS content,
         CASE WHEN event_type = 'error' THEN 'failed ' || event_id END AS error
  FROM events)"""

CATEGORY_MEANS = f"""
means AS (
  SELECT user_id AS interview_id, event_type AS category, {mean('sum(score)', 'count(score)')} AS score
  FROM (SELECT user_id, event_type, floor(least(greatest(value, 0), 100))::BIGINT AS score FROM events)
  GROUP BY user_id, event_type)"""


def filler_count(x: str) -> str:
    singles = [f for f in fx.FIXTURE_FILLERS if " " not in f]
    padded = f"(' ' || array_to_string({tokens(x)}, '  ') || ' ')"
    out = [f"len(list_filter({tokens(x)}, lambda t: t IN ({q_list(singles)})))"]
    for phrase in (f for f in fx.FIXTURE_FILLERS if " " in f):
        needle = " " + phrase.replace(" ", "  ") + " "
        out.append(f"(length({padded}) - length(replace({padded}, {q(needle)}, ''))) // {len(needle)}")
    return "(" + " + ".join(out) + ")"


def confidence(x: str) -> str:
    n = f"len({words(x)})"
    return (
        f"(CASE WHEN {n} < 5 THEN 30 ELSE greatest(100 - (500 * {filler_count(x)}) // {n}, 0) END)::BIGINT"
    )


def rating(share: str) -> str:
    return (
        f"(CASE WHEN {share} < 5 THEN 'YẾU' WHEN {share} < 15 THEN 'KHÁ' "
        f"WHEN {share} < 30 THEN 'TỐT' ELSE 'XUẤT SẮC' END)"
    )


ANSWERS = f"""
answers AS (SELECT conv_id, turn, text, {tokens('text')} AS toks FROM conversations WHERE role = 'user')"""
INTERVIEWS = """
interviews AS (
  SELECT DISTINCT conv_id, conv_id % (SELECT count(*) FROM benchmark) AS item_id FROM conversations)"""
RELEVANCE_TURNS = f"""{KEYS}, {ANSWERS}, {INTERVIEWS},
turn_hits AS (
  SELECT conv_id, turn, count(*) AS hits
  FROM (SELECT DISTINCT conv_id, turn, unnest(toks) AS term FROM answers)
  JOIN interviews USING (conv_id) JOIN key_terms USING (item_id, term) GROUP BY conv_id, turn),
jd_relevance AS (
  SELECT a.conv_id, a.turn, i.item_id,
         coalesce({pct('coalesce(hits, 0)', 'n_key_terms')}, 0) AS jd_relevance_score
  FROM answers a JOIN interviews i USING (conv_id) LEFT JOIN totals t USING (item_id)
  LEFT JOIN turn_hits h ON h.conv_id = a.conv_id AND h.turn = a.turn)"""
VOCAB_TURNS = f"""
tech_hits AS (
  SELECT conv_id, turn, count(*) AS n_tech
  FROM (SELECT conv_id, turn, item_id, unnest(toks) AS term FROM answers JOIN interviews USING (conv_id))
  JOIN jd_terms USING (item_id, term) GROUP BY conv_id, turn),
tech AS (
  SELECT conv_id, turn, {pct('coalesce(n_tech, 0)', 'len(toks)')} AS tech_share
  FROM answers LEFT JOIN tech_hits USING (conv_id, turn)),
vocab AS (SELECT *, {rating('tech_share')} AS tech_vocab_rating FROM tech)"""


def language(text_tokens: str) -> dict[str, str]:
    return {
        lang: f"len(list_filter({text_tokens}, lambda t: t IN ({q_list(ws)})))"
        for lang, ws in sorted(V.STOP_WORDS.items())
    }


def winner(votes: list[tuple[str, str]]) -> str:
    best = "greatest(" + ", ".join(c for _, c in votes) + ")"
    return "CASE " + " ".join(f"WHEN {c} = {best} AND {c} > 0 THEN {q(k)}" for k, c in votes) + " END"


LANGS = sorted(V.STOP_WORDS)
LANG_COLUMNS = ", ".join(f"{e} AS v_{k}" for k, e in language("toks").items())

# --- sources and sinks ------------------------------------------------------------------

ORACLES["load_corpus"] = """
SELECT 'cv' AS kind, doc_id AS id, text FROM documents
UNION ALL SELECT 'jd', item_id, text FROM benchmark"""

ORACLES["assemble_page_text"] = f"""
SELECT conv_id, 0 AS segment, {strip('body')} AS text
FROM (SELECT conv_id, string_agg(coalesce(CASE WHEN turn % 5 <> 3 THEN text END, '') || chr(10), ''
                                 ORDER BY turn) AS body
      FROM conversations GROUP BY conv_id)"""

ORACLES["route_requests"] = f"""
WITH {REQUESTS},
judged AS (
  SELECT request_id, kind,
    CASE WHEN kind IN ('upload', 'extract') AND NOT is_pdf THEN 'not_pdf'
         WHEN kind IN ('upload', 'extract') AND NOT parsed THEN 'unparseable'
         WHEN kind IN ('upload', 'analyze') AND no_cv THEN 'empty_text'
         WHEN kind = 'finish' AND n_messages = 0 THEN 'empty_history'
         WHEN kind = 'speech' AND no_cv THEN 'empty_speech'
         WHEN kind = 'writer' AND (no_cv OR no_jd) THEN 'cv_or_jd_missing'
         ELSE 'accepted' END AS reason
  FROM requests)
SELECT request_id, kind, reason,
  CASE WHEN reason = 'accepted' THEN 200 WHEN reason IN ('not_pdf', 'empty_speech') THEN 400 ELSE 422 END AS code
FROM judged"""

ORACLES["template_catalog"] = f"""
WITH {SLUGS}, {CATALOG}
SELECT slug, name, title, count(*) AS n_requests, n_keywords, n_tips, n_achievements
FROM slugs JOIN catalog USING (slug) GROUP BY ALL"""

ORACLES["keyword_coverage"] = f"WITH {PAIRS} SELECT * EXCLUDE (technical_match) FROM coverage"

ORACLES["result_sink"] = f"""
WITH {PAIRS}
SELECT * EXCLUDE (technical_match),
  '{{"doc_id":' || doc_id || ',"item_id":' || item_id || ',"hits":' || hits || ',"n_key_terms":'
  || n_key_terms || ',"keyword_coverage":' || keyword_coverage || '}}' AS payload
FROM coverage"""

QA = """
qa AS (
  SELECT conv_id, turn, question, text AS answer
  FROM (SELECT *, last_value(CASE WHEN role = 'assistant' THEN text END IGNORE NULLS) OVER (
                    PARTITION BY conv_id ORDER BY turn
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS question FROM conversations)
  WHERE role = 'user' AND question IS NOT NULL)"""

ORACLES["export_nested_json"] = f"""
WITH {QA}
SELECT conv_id, 0 AS segment,
  '{{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[' || string_agg(
    '{{"@type":"Question","name":' || to_json(question)::VARCHAR ||
    ',"acceptedAnswer":{{"@type":"Answer","text":' || to_json(answer)::VARCHAR || '}}}}', ',' ORDER BY turn)
  || ']}}' AS page
FROM qa GROUP BY conv_id"""

# --- projections and checks -----------------------------------------------------------------

ROLE = "CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END"
ORACLES["normalize_roles"] = f"SELECT conv_id, turn, {ROLE} AS role FROM conversations"
ORACLES["project_history"] = "SELECT conv_id, turn, role, text AS content FROM conversations"
ORACLES["has_data"] = f"WITH {REQUESTS} SELECT request_id FROM requests WHERE NOT no_cv AND NOT no_jd"
ORACLES["question_strategy"] = f"""
WITH {TURNS_BEFORE}
SELECT conv_id, turn, question_no,
  CASE WHEN question_no = 1 THEN {q(V.STRATEGY_INTRO)} WHEN question_no = {TOTAL} THEN {q(V.STRATEGY_FINAL)}
       ELSE {q(V.STRATEGY_DEEP)} END AS strategy
FROM progress"""
_BAND_COLUMNS = ", ".join(f"{bands('score', b)} AS {k}" for k, b in rules.BANDS.items())
ORACLES["score_band"] = f"""
SELECT *, {_BAND_COLUMNS}
FROM (SELECT event_id, floor(least(greatest(value, 0), 100))::BIGINT AS score FROM events)"""
ORACLES["confidence_score"] = f"""
SELECT conv_id, turn, {confidence('text')} AS confidence_score FROM conversations WHERE role = 'user'"""
ORACLES["confidence_band"] = f"""
SELECT *, {bands('confidence_score', V.CONFIDENCE_BANDS)} AS band FROM ({ORACLES['confidence_score']})"""


def _violations(checks: dict[str, str]) -> str:
    arms = ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, bad in sorted(checks.items()))
    return f"array_to_string(list_filter([{arms}], lambda v: v IS NOT NULL), ',')"


def _outside(n: int, allowed) -> str:
    position = f"doc_id % {n}"
    return f"({position} >= {len(allowed)})"


ORACLES["check_enums"] = f"""
SELECT doc_id, {_violations({
    "rating": _outside(6, V.VOCABULARY_RATINGS), "priority": _outside(5, V.PRIORITIES),
    "strength": _outside(6, V.EVIDENCE_STRENGTHS)})} AS violations,
  CASE doc_id % 5 WHEN 0 THEN 'red' WHEN 1 THEN 'orange' ELSE 'green' END AS badge
FROM labels"""
ORACLES["check_ranges"] = f"""
SELECT *, {_violations({
    "overall_score": "coalesce(overall_score NOT BETWEEN 0 AND 100, true)",
    "ats_readiness": "coalesce(ats_readiness NOT BETWEEN 0 AND 100, true)"})} AS violations
FROM (SELECT doc_id, quality * 60 + doc_id % 50 AS overall_score,
             CASE WHEN doc_id % 9 <> 0 THEN toxic * 90 - doc_id % 5 END AS ats_readiness FROM labels)"""


def _size_check(field: str, size: str) -> str:
    lo, hi = V.LIST_SIZES[field]
    return f"{size} NOT BETWEEN {lo} AND {hi}"


ORACLES["check_list_sizes"] = f"""
SELECT doc_id, {_violations({
    "missing_keywords": _size_check("missing_keywords", "len(list_filter(seen, lambda t: length(t) >= 14))"),
    "cv_strengths": _size_check("cv_strengths", f"len({lines('text')})"),
    "sub_scores": _size_check("sub_scores", "len(list_filter(seen, lambda t: length(t) = 2))"),
    "tips": _size_check("tips", "len(list_filter(seen, lambda t: length(t) = 1))")})} AS violations
FROM (SELECT doc_id, text, list_distinct({tokens('text')}) AS seen FROM documents)"""

EDITS = f"""
firsts AS (SELECT doc_id, text, list_extract({lines('text')}, 1) AS line FROM documents),
edits AS (
  SELECT doc_id, text, 0 AS ord, CASE WHEN doc_id % 4 = 0 THEN '~' || line ELSE line END AS o,
         '* ' || line AS u FROM firsts
  UNION ALL SELECT doc_id, text, 1, '* ' || line, '- ' || line FROM firsts)"""
ORACLES["check_verbatim_edits"] = f"""
WITH {EDITS} SELECT doc_id, ord, o <> '' AND contains(text, o) AS verbatim FROM edits"""
ORACLES["check_channel_rules"] = f"""
SELECT doc_id, channel, {_violations({
    "too_long": "(channel = 'zalo' AND n >= 150) OR (channel = 'linkedin' AND n >= 200)",
    "subject_not_allowed": "channel IN ('zalo', 'linkedin') AND doc_id % 2 <> 0",
    "subject_missing": "channel = 'email' AND doc_id % 2 = 0"})} AS violations
FROM (SELECT doc_id, {pick('doc_id % 3', ('email', 'linkedin', 'zalo'))} AS channel,
             len({words('text')}) AS n FROM documents)"""
ORACLES["default_fields"] = """
SELECT d.doc_id, coalesce(quality, 0) AS quality, CASE WHEN l.doc_id IS NULL THEN '' ELSE 'a, b' END AS topics,
  CASE WHEN l.doc_id IS NULL THEN '' ELSE 'labelled' END AS note
FROM documents d LEFT JOIN labels l USING (doc_id)"""
ORACLES["progress_pct"] = f"""
SELECT conv_id, answered, answered::DOUBLE / {TOTAL}::DOUBLE * 100.0::DOUBLE AS progress
FROM (SELECT conv_id,
      least(count(*) FILTER (WHERE role = 'user' AND text IS NOT NULL AND {strip("text")} <> ''), {TOTAL}) AS answered
      FROM conversations GROUP BY conv_id)"""

# --- joins ---------------------------------------------------------------------------------------

ORACLES["candidate_pairs"] = f"WITH {PAIRS} SELECT * FROM pairs"
ORACLES["matched_keywords"] = f"""
WITH {top_pairs()}
SELECT p.doc_id, p.item_id, k.term, k.tf FROM top_pairs p JOIN key_terms k USING (item_id)
WHERE EXISTS (SELECT 1 FROM cv_terms c WHERE c.doc_id = p.doc_id AND c.term = k.term)"""
ORACLES["missing_keywords"] = f"WITH {MISSING} SELECT * FROM missing"
ORACLES["claims_with_evidence"] = f"WITH {EVIDENCE} SELECT * FROM evidence"
_SHOWN = f"coalesce(nullif(replace(slug, '-', ' '), ''), {q(V.DEFAULT_INDUSTRY)})"
_META = {"title": "c.title", "slug": "s.slug", "brand": q(V.BRAND)}
ORACLES["template_lookup_fallback"] = f"""
WITH {SLUGS}, {CATALOG}
SELECT c_custkey, s.slug, c.slug IS NOT NULL AS known, coalesce(c.name, {_SHOWN.replace('slug', 's.slug')}) AS name,
  coalesce(c.title, {q(C.FALLBACK_TITLE)} || {_SHOWN.replace('slug', 's.slug')}) AS title,
  CASE WHEN c.slug IS NOT NULL THEN {fill(C.PAGE_TITLE, **_META)}
       ELSE {fill(C.FALLBACK_PAGE_TITLE, **_META)} END AS page_title,
  CASE WHEN c.slug IS NOT NULL THEN {fill(C.PAGE_DESCRIPTION, **_META)}
       ELSE {fill(C.FALLBACK_PAGE_DESCRIPTION, **_META)} END AS page_description,
  c.keywords AS page_keywords, coalesce(c.keywords, {q(', '.join(_GENERIC['keywords']))}) AS keywords,
  coalesce(c.n_tips, {len(_GENERIC['pro_tips'])}) AS n_tips
FROM slugs s LEFT JOIN catalog c ON c.slug = s.slug"""
ORACLES["template_lookup_strict"] = f"""
WITH {SLUGS}, {CATALOG} SELECT c_custkey, slug, title, keywords FROM slugs JOIN catalog USING (slug)"""
ORACLES["uncached_requests"] = """
WITH stored AS (
  SELECT CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE -doc_id - 1 END AS key, source,
         CASE WHEN doc_id % 6 = 0 THEN text || '!' ELSE text END AS text FROM documents)
SELECT d.doc_id AS key FROM documents d
WHERE NOT EXISTS (
  SELECT 1 FROM stored c WHERE c.key = d.doc_id AND c.source = d.source AND c.text = d.text)"""


def _side(side: str, cond: str) -> str:
    return ", ".join(f"coalesce(sum(v_{k}) FILTER (WHERE {cond}), 0) AS {side}_{k}" for k in LANGS)


ORACLES["language_consistency"] = f"""
WITH votes AS (
  SELECT conv_id, role, {LANG_COLUMNS} FROM (SELECT conv_id, role, {tokens('text')} AS toks FROM conversations)),
sums AS (
  SELECT conv_id, {_side('u', "role <> 'assistant'")}, {_side('a', "role = 'assistant'")}
  FROM votes GROUP BY conv_id),
named AS (
  SELECT conv_id, {winner([(k, f'u_{k}') for k in LANGS])} AS user_lang,
         {winner([(k, f'a_{k}') for k in LANGS])} AS assistant_lang FROM sums)
SELECT *, user_lang IS NOT DISTINCT FROM assistant_lang AS consistent FROM named"""
ORACLES["ungrounded_terms"] = f"""
WITH {KEYS}
SELECT doc_id - 1 AS doc_id, term FROM cv_terms WHERE term IN (SELECT term FROM key_terms)
EXCEPT SELECT doc_id, term FROM cv_terms"""
ORACLES["apply_edits"] = """
WITH firsts AS (SELECT doc_id, text, list_extract({lines}, 1) AS line FROM documents),
step1 AS (
  SELECT doc_id, line, CASE WHEN doc_id % 4 = 0 THEN replace(text, '~' || line, '* ' || line)
                            WHEN line = '' THEN text ELSE replace(text, line, '* ' || line) END AS text
  FROM firsts)
SELECT doc_id, replace(text, '* ' || line, '- ' || line) AS revised FROM step1""".format(lines=lines("text"))

# --- aggregations ------------------------------------------------------------------------------------

ORACLES["term_document_freq"] = f"""
WITH {KEYS} SELECT term, df, (SELECT count(*) FROM documents) AS n_docs FROM dfs"""
ORACLES["technical_match"] = f"WITH {PAIRS} SELECT doc_id, item_id, technical_match FROM coverage"
ORACLES["experience_relevance"] = f"WITH {KEYS}, {RELEVANCE} SELECT * FROM relevance"
ORACLES["impact_evidence"] = f"SELECT doc_id, {IMPACT} AS impact_evidence FROM documents"
ORACLES["ats_readiness"] = f"WITH {ATS} SELECT * FROM ats"
ORACLES["match_score"] = f"WITH {SCORES} SELECT * FROM scores"
ORACLES["evidence_strength"] = f"""
WITH {EVIDENCE}
SELECT doc_id, item_id, claim, list_extract(['Missing', 'Weak', 'Medium', 'Strong'], grade + 1) AS strength
FROM (SELECT doc_id, item_id, claim,
        max(CASE WHEN line IS NULL THEN 0 WHEN regexp_matches(line, '[0-9]') THEN 3
                 WHEN len({words('line')}) >= 8 THEN 2 ELSE 1 END) AS grade
      FROM evidence GROUP BY doc_id, item_id, claim)"""
ORACLES["keyword_priority"] = f"""
WITH {JD_TERMS}
SELECT item_id, term AS keyword, tf,
  CASE WHEN tf >= 3 THEN 'High' WHEN tf >= 2 THEN 'Medium' ELSE 'Low' END AS priority FROM jd_terms"""
ORACLES["main_language"] = f"""
WITH votes AS (
  SELECT doc_id, lang, {LANG_COLUMNS} FROM (SELECT doc_id, lang, {tokens('text')} AS toks FROM documents))
SELECT doc_id, lang, {winner([(k, f'v_{k}') for k in LANGS])} AS main_lang FROM votes"""
_CATEGORIES = ("click", "error", "purchase", "signup", "view")
_CELLS = ", ".join(f"max(score) FILTER (WHERE category = '{c}') AS {c}" for c in _CATEGORIES)
ORACLES["sub_score_grid"] = f"""
WITH {CATEGORY_MEANS}
SELECT interview_id, {_CELLS},
  count(*) = 5 AND count(*) FILTER (WHERE category IN ({q_list(_CATEGORIES)})) = 5 AS complete
FROM means GROUP BY interview_id"""
ORACLES["role_counts"] = """
SELECT *, n_user >= 1 AND n_assistant >= 2 AS first_completed
FROM (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_user,
             count(*) FILTER (WHERE role = 'assistant') AS n_assistant FROM conversations GROUP BY conv_id)"""
ORACLES["question_totals"] = f"""
WITH {QA}
SELECT c.conv_id, count(qa.turn) AS n_questions
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN qa USING (conv_id) GROUP BY c.conv_id"""
ORACLES["overall_score"] = f"""
WITH {CATEGORY_MEANS}
SELECT *, {bands('overall_score', V.REPORT_LABEL_BANDS)} AS label
FROM (SELECT interview_id, {mean('sum(score)', 'count(score)')} AS overall_score FROM means GROUP BY interview_id)"""
ORACLES["provider_health"] = f"""
WITH {ATTEMPTS}
SELECT provider_rank, count(*) AS attempts, count(error) AS failures,
  {pct('count(*) - count(error)', 'count(*)')} AS success_pct,
  (SELECT count(*) FROM (SELECT request_id FROM attempts GROUP BY request_id
                         HAVING bool_and(error IS NOT NULL))) AS failed_requests
FROM attempts GROUP BY provider_rank"""

# --- interview metrics ----------------------------------------------------------------------------------

ORACLES["jd_relevance_score"] = f"WITH {RELEVANCE_TURNS} SELECT * FROM jd_relevance"
ORACLES["tech_vocab_rating"] = f"""
WITH {JD_TERMS}, {ANSWERS}, {INTERVIEWS}, {VOCAB_TURNS}
SELECT conv_id, turn, tech_share, tech_vocab_rating FROM vocab"""
ORACLES["metrics_rollup"] = f"""
WITH {RELEVANCE_TURNS}, {VOCAB_TURNS},
metrics AS (
  SELECT a.conv_id, a.turn, {confidence('a.text')} AS cs, r.jd_relevance_score AS rs, v.tech_vocab_rating AS tv
  FROM answers a JOIN jd_relevance r USING (conv_id, turn) JOIN vocab v USING (conv_id, turn)),
rolled AS (
  SELECT conv_id, count(*) AS n, arg_max(cs, turn) AS cs, arg_max(rs, turn) AS rs, arg_max(tv, turn) AS tv,
         {mean('sum(cs)', 'count(*)')} AS avg_confidence, {mean('sum(rs)', 'count(*)')} AS avg_relevance
  FROM metrics GROUP BY conv_id)
SELECT c.conv_id, coalesce(n, 0) AS n_answers, coalesce(cs, 100) AS confidence_score,
  coalesce(rs, 100) AS jd_relevance_score, coalesce(tv, 'TỐT') AS tech_vocab_rating, avg_confidence, avg_relevance
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rolled USING (conv_id)"""

# --- order-dependent walks --------------------------------------------------------------------------------

ORACLES["qa_pairs"] = f"WITH {QA} SELECT * FROM qa"
ORACLES["attach_feedback"] = """
SELECT conv_id, turn, text, feedback
FROM (SELECT *, lead(CASE WHEN role = 'assistant' THEN text END) OVER (PARTITION BY conv_id ORDER BY turn)
        AS feedback FROM conversations) WHERE role = 'user'"""
ORACLES["latest_prompt"] = f"""
WITH hinted AS (SELECT *, CASE WHEN turn % 4 <> 3 THEN 'hint ' || turn END AS hint FROM conversations),
last AS (SELECT * FROM hinted QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1),
prompts AS (
  SELECT conv_id, text AS prompt FROM hinted WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
SELECT conv_id, prompt,
  CASE WHEN role = 'assistant' AND length(hint) > 0 THEN hint ELSE {q(V.DEFAULT_HINT)} END AS hint
FROM last LEFT JOIN prompts USING (conv_id)"""
ORACLES["question_progress"] = f"""
WITH {TURNS_BEFORE} SELECT conv_id, turn, role, question_no, finishes FROM progress"""
ORACLES["first_valid_response"] = f"""
WITH {ATTEMPTS},
best AS (
  SELECT * FROM attempts WHERE error IS NULL AND length(content) > 0
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY provider_rank, attempt) = 1),
final AS (
  SELECT request_id, error FROM attempts
  QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY provider_rank DESC, attempt DESC) = 1)
SELECT f.request_id, b.content, b.provider_rank, CASE WHEN b.request_id IS NULL THEN 503 ELSE 200 END AS status,
  CASE WHEN b.request_id IS NULL THEN f.error END AS last_error
FROM final f LEFT JOIN best b USING (request_id)"""
ORACLES["cache_upsert"] = """
SELECT key, content, version FROM (
  SELECT doc_id AS key, source AS content, 1 AS version, 0 AS fresh FROM documents
  UNION ALL SELECT CASE WHEN doc_id % 4 = 0 THEN doc_id ELSE -doc_id - 1 END, lang, doc_id % 3, 1 FROM documents)
QUALIFY row_number() OVER (PARTITION BY key ORDER BY version DESC, fresh DESC) = 1"""

# --- top-k ---------------------------------------------------------------------------------------------

ORACLES["top_missing_keywords"] = f"""
WITH {MISSING}
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY tf DESC, term) AS rank
               FROM missing) WHERE rank <= 5"""
ORACLES["weakest_lines"] = f"""
WITH text_lines AS (
  SELECT doc_id, unnest(range(len({lines('text')}))) AS line_no, unnest({lines('text')}) AS line FROM documents)
SELECT doc_id, rank, line_no, line FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY regexp_matches(line, '[0-9]'),
                               len({words('line')}), line_no) AS rank
  FROM text_lines WHERE {strip('line')} <> '') WHERE rank <= 5"""
ORACLES["strengths_and_gaps"] = f"""
WITH {CATEGORY_MEANS}
SELECT interview_id, category, score, 'strength' AS side,
  row_number() OVER (PARTITION BY interview_id ORDER BY score DESC, category) AS rank FROM means QUALIFY rank <= 3
UNION ALL
SELECT interview_id, category, score, 'gap',
  row_number() OVER (PARTITION BY interview_id ORDER BY score, category) AS rank FROM means QUALIFY rank <= 3"""
ORACLES["keyword_preview"] = """
SELECT p_partkey, array_to_string(k[1:3], ', ') AS preview,
  CASE WHEN len(k) > 3 THEN '+' || (len(k) - 3) END AS more
FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [p_type]
        ELSE string_split(concat_ws(' ', p_name, p_type, p_brand), ' ') END AS k FROM part)"""
ORACLES["rank_candidates"] = f"""
WITH {SCORES}
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY match_score DESC, doc_id) AS rank,
                      doc_id, match_score FROM scores) WHERE rank <= 10"""
ORACLES["order_by_priority"] = f"""
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY priority_rank, keyword) AS position
FROM (SELECT *, CASE priority WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END AS priority_rank
      FROM ({ORACLES['keyword_priority']}))"""
ORACLES["top_topics"] = f"""
SELECT * FROM (
  SELECT conv_id, topic, count(*) AS n,
         row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, topic) AS rank
  FROM (SELECT conv_id, unnest({tokens('text')}) AS topic FROM conversations)
  WHERE length(topic) >= 3 AND topic NOT IN ({q_list(sorted({w for ws in V.STOP_WORDS.values() for w in ws}))})
  GROUP BY conv_id, topic) WHERE rank <= 5"""

# --- message lists -----------------------------------------------------------------------------------------

ORACLES["build_messages"] = f"""
SELECT DISTINCT conv_id, 0 AS position, 'system' AS role, 'Interview ' || conv_id AS content FROM conversations
UNION ALL SELECT conv_id, turn + 1, {ROLE}, text FROM conversations"""
ORACLES["append_response"] = f"""
SELECT conv_id, turn, role, text, NULL AS hint_for_user FROM conversations
UNION ALL
SELECT conv_id, max(turn) + 1, 'assistant',
  CASE WHEN conv_id % 5 = 0 THEN {q(V.APOLOGY.replace('{brand}', V.BRAND))} ELSE 'Q' || conv_id END,
  CASE WHEN conv_id % 5 <> 0 THEN 'hint' END
FROM conversations GROUP BY conv_id"""
ORACLES["seed_empty_history"] = f"""
SELECT conv_id, turn, role, text FROM conversations
UNION ALL SELECT DISTINCT -conv_id - 1, 0, 'user', {q(V.START_CUE)} FROM conversations"""

# --- column functions -----------------------------------------------------------------------------------------

_PADDED = "' ' || chr(9) || chr(160) || text || chr(8195) || ' ' || chr(10)"
ORACLES["strip_text"] = f"SELECT doc_id, {strip(_PADDED)} AS stripped FROM documents"
_BODY = "CASE WHEN doc_id % 9 = 0 THEN '  ' || chr(10) ELSE text END"
ORACLES["word_count"] = f"""
SELECT doc_id, n_words, CASE WHEN n_words = 0 THEN {q(V.EMPTY_TEXT_LABEL)} ELSE n_words || ' {V.WORD_UNIT}' END AS label
FROM (SELECT doc_id, len({words(_BODY)}) AS n_words FROM documents)"""
ORACLES["clamp"] = """
SELECT event_id, CASE WHEN event_id % 10 = 1 THEN true WHEN event_id % 10 = 0 THEN false ELSE false END AS is_nan,
  CASE WHEN event_id % 10 > 1 THEN least(greatest(value, 10), 100) END AS clamped
FROM events"""
_TRIMMED = strip("CASE WHEN id % 4 = 0 THEN 'JD ' || id ELSE text END", CLIENT_SPACE)
ORACLES["preview_text"] = f"""
SELECT kind, id, CASE WHEN length(t) > {V.PREVIEW_LENGTH} THEN left(t, {V.PREVIEW_LENGTH}) || '…'
                      ELSE {q(V.PREVIEW_LABEL)} END AS preview
FROM (SELECT kind, id, {_TRIMMED} AS t FROM ({ORACLES['load_corpus']}))"""
ORACLES["slug_to_name"] = f"""
WITH {SLUGS}
SELECT c_custkey, coalesce(nullif(replace(CASE WHEN c_custkey % 7 = 0 THEN '' ELSE slug END, '-', ' '), ''),
                           {q(V.DEFAULT_INDUSTRY)}) AS name FROM slugs"""
ORACLES["join_keywords"] = """
SELECT p_partkey, p_brand || ', ' || p_type || ', ' || p_name AS keywords FROM part"""
_NL = "chr(10)"
ORACLES["render_nested_record"] = f"""
WITH items AS (
  SELECT l_orderkey, string_agg('• part ' || l_partkey || ' x ' || l_quantity::BIGINT, {_NL}
                                ORDER BY l_linenumber, l_partkey, l_quantity) AS listed
  FROM lineitem GROUP BY l_orderkey),
roles AS (
  SELECT o_custkey, count(*) AS n, string_agg({_NL} || 'order ' || o_orderkey || ' | ' || o_orderpriority || ' | '
    || strftime(o_orderdate, '%Y-%m-%d') || {_NL} || coalesce(listed, '') || {_NL}, {_NL} ORDER BY o_orderkey) AS body
  FROM orders LEFT JOIN items ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT c_custkey, concat_ws({_NL}, c_name, c_mktsegment, 'customer ' || c_custkey, '', 'SUMMARY',
  coalesce(n, 0) || ' orders', '', 'SKILLS', c_mktsegment, c_name, '', 'EXPERIENCE', coalesce(body, ''),
  '', 'EDUCATION', 'none') AS body
FROM customer LEFT JOIN roles ON o_custkey = c_custkey"""
_CURRENT = "(item_id % 5 + 1)"
_CONTEXT = fill(P.CONTEXT_BLOCK, cv="cv", jd="jd")
_STRATEGY = (
    f"CASE WHEN {_CURRENT} = 1 THEN {q(V.STRATEGY_INTRO)} WHEN {_CURRENT} = 5 THEN {q(V.STRATEGY_FINAL)} "
    f"ELSE {q(V.STRATEGY_DEEP)} END"
)
_PROGRESS = fill(P.PROGRESS_BLOCK, current=_CURRENT, total="5", strategy=_STRATEGY)
ORACLES["build_prompts"] = f"""
WITH {top_pairs()},
texts AS (
  SELECT p.doc_id, p.item_id, d.text AS cv, b.text AS jd
  FROM top_pairs p JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))
SELECT doc_id, item_id, {fill(P.MATCH_BLOCK, cv='cv', jd='jd')} AS match_input,
  {fill(P.ANALYSIS_BLOCK, cv=strip('cv'), jd='jd')} AS analysis_input,
  {fill(P.INTERVIEW_PROMPT, context=_CONTEXT, progress=_PROGRESS)} AS interview,
  {fill(P.REPORT_PROMPT, context=_CONTEXT)} AS report
FROM texts"""
_CHANNELS = ("email", "linkedin", "zalo", "custom", "other")
_LABEL = "CASE channel " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in V.CHANNEL_LABELS.items()) + " ELSE channel END"
_RULES = "CASE channel " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in P.CHANNEL_RULES.items()) + " ELSE '' END"
ORACLES["build_writer_prompt"] = f"""
SELECT doc_id, {fill(P.WRITER_PROMPT, channel=_LABEL, tone=q(V.DEFAULT_TONE))} || {_RULES}
  || CASE WHEN channel = 'custom' AND doc_id % 2 = 0 THEN {fill(P.CUSTOM_BLOCK, custom='source')} ELSE '' END
  || {q(P.WRITER_FORMAT)} AS prompt
FROM (SELECT doc_id, source, {pick('doc_id % 5', _CHANNELS)} AS channel FROM documents)"""
ORACLES["copy_text"] = """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR source = '' THEN text
                    ELSE 'Subject: ' || source || chr(10) || chr(10) || text END AS body FROM documents"""
ORACLES["ensure_json_instruction"] = f"""
SELECT doc_id, CASE WHEN contains(upper(p), 'JSON') THEN p ELSE p || {q(V.JSON_INSTRUCTION)} END AS prompt
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' as Json' ELSE text END AS p FROM documents)"""
ORACLES["flatten_history"] = f"""
SELECT conv_id, 0 AS segment, string_agg({ROLE} || ': ' || text, chr(10) ORDER BY turn) AS history
FROM conversations GROUP BY conv_id"""
ORACLES["request_key"] = f"""
SELECT doc_id, {pick('doc_id % 5', _CHANNELS)} || ':' || {q(V.DEFAULT_TONE)} || ':'
  || sha256(sha256(text) || ':' || sha256(source)) AS key FROM documents"""

# --- structured responses -----------------------------------------------------------------------------------------

ORACLES["parse_responses"] = """
WITH raws AS (
  SELECT doc_id, doc_id % 8 AS pick, quality * 50 + toxic * 7 + doc_id % 10 AS score FROM labels),
judged AS (
  SELECT *, CASE pick WHEN 3 THEN 'int metrics.confidence_score' WHEN 4 THEN 'missing hint_for_user'
                      WHEN 6 THEN 'invalid json' WHEN 7 THEN 'enum metrics.tech_vocab_rating' END AS error FROM raws)
SELECT doc_id, error, CASE WHEN error IS NULL THEN 'q' || doc_id END AS next_question,
  CASE WHEN error IS NULL THEN CASE WHEN pick = 5 THEN 140 ELSE score END END AS confidence_score,
  CASE WHEN error IS NULL THEN score END AS jd_relevance_score,
  CASE WHEN error IS NULL THEN 'TỐT' END AS tech_vocab_rating
FROM judged"""
ORACLES["explode_experience"] = """
SELECT o_orderkey, 0 AS entry_no, 'first' AS company, 'r1' AS role, 0 AS bullet_no, o_orderstatus AS bullet
FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 0, 'first', 'r1', 1, o_orderpriority FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, 1, 'second', 'r2', NULL, NULL FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL SELECT o_orderkey, NULL, NULL, NULL, NULL, NULL FROM orders WHERE o_orderkey % 5 = 0"""
_CHILDREN = {
    "report.sub_scores": ("w", "x || '|' || length(x) || '|L'"),
    "report.key_strengths": ("w", "x"),
    "report.areas_for_improvement": ("list_filter(w, lambda t: length(t) % 2 = 0)", "x"),
    "report.top_topics_covered": ("list_filter(w, lambda t: length(t) % 2 = 1)", "x"),
    "report.turn_by_turn_analysis": ("l", "x || '|' || left(x, 9) || '|f|'"),
    "analysis.missing_keywords": ("w[1:5]", "x"),
    "analysis.suggested_edits": ("l", "'s|' || x || '|* ' || x || '|r'"),
    "analysis.cv_strengths": ("l", "x"),
    "analysis.prioritized_keywords": ("w", "x || CASE WHEN length(x) % 2 = 0 THEN '|High' ELSE '|Low' END"),
    "analysis.evidence_analysis": ("w", "x || '|Weak|'"),
}
ORACLES["explode_report"] = (
    f"WITH d AS (SELECT doc_id, list_filter({tokens('text')}, lambda t: length(t) >= 14) AS w, {lines('text')} AS l FROM documents)\n"
    + "\nUNION ALL\n".join(
        f"SELECT doc_id, {q(child)} AS child, pos, {value} AS value FROM (SELECT doc_id, unnest(range(len({of}))) AS pos, unnest({of}) AS x FROM d)"
        for child, (of, value) in _CHILDREN.items()
    )
)

# --- completion and streams ------------------------------------------------------------------------------------------

ORACLES["complete_batch"] = """
WITH sized AS (SELECT doc_id, length(text) AS n FROM documents),
ranked AS (
  SELECT *, CASE WHEN n % 3 <> 0 THEN 0 WHEN n % 2 <> 0 THEN 1 WHEN n % 5 <> 0 THEN 2 END AS provider_rank FROM sized)
SELECT doc_id AS request_id, CASE WHEN provider_rank IS NULL THEN 503 ELSE 200 END AS status, provider_rank,
  CASE WHEN provider_rank IS NULL THEN 'Empty response content' END AS last_error,
  'p' || provider_rank AS subject_line, CASE WHEN provider_rank IS NOT NULL THEN n || ' chars' END AS content
FROM ranked"""
ORACLES["stream_transcripts"] = """
WITH sessions AS (
  SELECT user_id, coalesce(' ' || (arg_max(event_type || '-' || event_id, event_id)
                                   FILTER (WHERE event_type <> 'purchase')), '') AS interim
  FROM events GROUP BY user_id),
spoken AS (
  SELECT user_id, event_id // 65536 AS segment,
         string_agg(event_type || '-' || event_id, ' ' ORDER BY event_id) AS transcript
  FROM events WHERE event_type = 'purchase' GROUP BY user_id, event_id // 65536)
SELECT user_id AS session_id, coalesce(segment, 0) AS segment, coalesce(transcript, '') AS transcript, interim
FROM sessions LEFT JOIN spoken USING (user_id)"""
ORACLES["stream_interviews"] = f"""
WITH {KEYS}, {INTERVIEWS}, {TURNS_BEFORE},
lists AS (SELECT item_id, list(term) AS key_list, count(*) AS n_key_terms FROM key_terms GROUP BY item_id),
vocabularies AS (SELECT item_id, list(term) AS vocabulary FROM jd_terms GROUP BY item_id),
scored AS (
  SELECT p.*, {confidence('text')} AS cs, {tokens('text')} AS toks, key_list, n_key_terms, vocabulary
  FROM progress p JOIN interviews USING (conv_id) LEFT JOIN lists USING (item_id) LEFT JOIN vocabularies USING (item_id)),
rated AS (
  SELECT *, coalesce({pct('len(list_intersect(toks, key_list))', 'n_key_terms')}, 0) AS rs,
    {pct('len(list_filter(toks, lambda t: coalesce(list_contains(vocabulary, t), false)))', 'len(toks)')} AS share
  FROM scored),
rolled AS (
  SELECT conv_id, max(turn) AS last_turn, count(*) AS n_messages,
    least(count(*) FILTER (WHERE answered) + 1, {TOTAL}) AS question_no, bool_or(finishes) AS finished,
    arg_max(cs, turn) FILTER (WHERE answered) AS cs, arg_max(rs, turn) FILTER (WHERE answered) AS rs,
    arg_max({rating('share')}, turn) FILTER (WHERE answered) AS tv
  FROM rated GROUP BY conv_id)
SELECT conv_id, last_turn, n_messages, question_no, finished, coalesce(cs, 100) AS confidence_score,
  coalesce(rs, 100) AS jd_relevance_score, coalesce(tv, 'TỐT') AS tech_vocab_rating
FROM rolled"""
ORACLES["stream_incremental_scoring"] = f"""
WITH {SCORES} SELECT * FROM scores"""
