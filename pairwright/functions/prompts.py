"""Prompt text per row.

The data blocks (CV, JD, progress, channel) have fixed forms.  The wording of
the system prompts is a parameter; the defaults are short and our own.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairwright.functions import values as V
from pairwright.functions.rules import question_strategy
from pairwright.functions.text import as_column, strip_text

# The forms in which a CV and a JD enter a request, and the
# channel rules of the writing assistant.
MATCH_BLOCK = "CV:\n{cv}\n\nJob Description:\n{jd}"
ANALYSIS_BLOCK = "CV của ứng viên:\n{cv}\n\nMô tả Công việc (JD):\n{jd}"
CONTEXT_BLOCK = "Job Description (JD):\n{jd}\n\nCandidate's CV:\n{cv}\n"
PROGRESS_BLOCK = (
    "You are currently asking question {current} out of {total}.\n"
    "Question strategy: {strategy}"
)
CUSTOM_BLOCK = "\nYÊU CẦU BỔ SUNG TỪ NGƯỜI DÙNG:\n{custom}\n"
CHANNEL_RULES = {
    "zalo": (
        "- Tin nhắn Zalo phải NGẮN (dưới 150 từ), thân thiện nhưng chuyên nghiệp.\n"
        "- subject_line trả về chuỗi rỗng vì Zalo không có tiêu đề.\n"
    ),
    "linkedin": (
        "- Tin nhắn LinkedIn phải ngắn gọn (dưới 200 từ), chuyên nghiệp.\n"
        "- subject_line trả về chuỗi rỗng.\n"
    ),
    "email": (
        "- Email cần có subject_line hấp dẫn và chuyên nghiệp.\n"
        "- Nội dung email đầy đủ: lời chào, giới thiệu bản thân, lý do ứng tuyển, "
        "điểm mạnh phù hợp JD, lời kết.\n"
    ),
}

# Default wording (ours; pass another template to change it).
SCORING_PROMPT = (
    "Compare the CV with the job description and answer in the language of the CV. "
    "Return JSON only, with every score between 0 and 100."
)
INTERVIEW_PROMPT = (
    "You run a one-to-one mock interview. Ask one question at a time and return JSON.\n\n"
    "[CONTEXT]\n{context}\n[INTERVIEW PROGRESS]\n{progress}"
)
REPORT_PROMPT = (
    "The interview is over. Review every question and answer and return a JSON report.\n\n"
    "[CONTEXT]\n{context}"
)
WRITER_PROMPT = (
    "Write a {channel} in the tone '{tone}', based on the CV and the job description. "
    "Use the language of the CV and claim nothing the CV does not show.\n"
)
WRITER_FORMAT = "\nReturn JSON with subject_line, content and tips (one or two)."


def fill(template: str, **parts: Column) -> Column:
    """Template with ``{name}`` slots to one concatenation; NULL parts count as empty."""
    pieces: list[Column] = []
    rest = template
    while rest:
        slots = [(rest.find("{" + k + "}"), k) for k in parts if "{" + k + "}" in rest]
        if not slots:
            pieces.append(F.lit(rest))
            break
        at, key = min(slots)
        if at:
            pieces.append(F.lit(rest[:at]))
        pieces.append(F.coalesce(parts[key].cast("string"), F.lit("")))
        rest = rest[at + len(key) + 2 :]
    return F.concat(*pieces)


def ensure_json_instruction(prompt: Column | str) -> Column:
    """Append the JSON instruction unless the prompt already speaks of JSON."""
    p = as_column(prompt)
    return F.when(~F.contains(F.upper(p), F.lit("JSON")), F.concat(p, F.lit(V.JSON_INSTRUCTION))).otherwise(p)


def match_input(cv: Column | str, jd: Column | str) -> Column:
    return fill(MATCH_BLOCK, cv=as_column(cv), jd=as_column(jd))


def analysis_input(cv: Column | str, jd: Column | str) -> Column:
    return fill(ANALYSIS_BLOCK, cv=strip_text(cv), jd=as_column(jd))


def scoring_prompt(template: str = SCORING_PROMPT) -> Column:
    return ensure_json_instruction(F.lit(template))


def interview_prompt(
    cv: Column | str, jd: Column | str, current: Column, total: Column,
    template: str = INTERVIEW_PROMPT,
) -> Column:
    context = fill(CONTEXT_BLOCK, cv=as_column(cv), jd=as_column(jd))
    progress = fill(
        PROGRESS_BLOCK, current=current, total=total, strategy=question_strategy(current, total)
    )
    return ensure_json_instruction(fill(template, context=context, progress=progress))


def report_prompt(cv: Column | str, jd: Column | str, template: str = REPORT_PROMPT) -> Column:
    context = fill(CONTEXT_BLOCK, cv=as_column(cv), jd=as_column(jd))
    return ensure_json_instruction(fill(template, context=context))


def channel_label(kind: Column | str) -> Column:
    """Channel description; an unknown channel passes through."""
    k = as_column(kind)
    labels = F.create_map(*[F.lit(x) for pair in V.CHANNEL_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, k), k)


def writer_prompt(
    kind: Column | str, tone: Column | str, custom: Column | str, template: str = WRITER_PROMPT
) -> Column:
    k, c = as_column(kind), as_column(custom)
    rules = None
    for name, text in CHANNEL_RULES.items():
        rules = F.when(k == name, text) if rules is None else rules.when(k == name, text)
    extra = F.when((k == "custom") & (F.length(c) > 0), fill(CUSTOM_BLOCK, custom=c))
    body = F.concat_ws(
        "",
        fill(template, channel=channel_label(k), tone=as_column(tone)),
        rules.otherwise(""),
        F.coalesce(extra, F.lit("")),
        F.lit(WRITER_FORMAT),
    )
    return ensure_json_instruction(body)
