"""Structured responses: validation against declared models, checks, flattening."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairwright.functions import values as V
from pairwright.functions.text import as_column

# The response models.  "str", "int" and "bool" are leaves, a tuple
# is a closed set of strings, a one-element list is a list, a dict an object.
MODELS: dict[str, dict] = {
    "match_result": {
        "match_score": "int",
        "missing_skills": ["str"],
        "tailored_cv": {
            "name": "str",
            "summary": "str",
            "experience": [{"company": "str", "role": "str", "bullet_points": ["str"]}],
            "education": "str",
            "skills": ["str"],
        },
    },
    "interview_turn": {
        "ai_feedback": "str",
        "next_question": "str",
        "hint_for_user": "str",
        "metrics": {
            "confidence_score": "int",
            "confidence_feedback": "str",
            "jd_relevance_score": "int",
            "jd_relevance_feedback": "str",
            "tech_vocab_rating": V.VOCABULARY_RATINGS,
        },
    },
    "final_report": {
        "overall_score": "int",
        "overall_feedback": "str",
        "sub_scores": [{"category": "str", "score": "int", "label": "str"}],
        "key_strengths": ["str"],
        "areas_for_improvement": ["str"],
        "top_topics_covered": ["str"],
        "ai_feedback_summary": {"positive": "str", "warning": "str", "actionable": "str"},
        "turn_by_turn_analysis": [
            {"question": "str", "user_answer": "str", "feedback": "str", "ideal_answer_snippet": "str"}
        ],
    },
    "cv_analysis": {
        "match_score": "int",
        "match_headline": "str",
        "match_summary": "str",
        "technical_match": "int",
        "experience_relevance": "int",
        "keyword_coverage": "int",
        "impact_evidence": "int",
        "tone_quality": "int",
        "ats_readiness": "int",
        "missing_keywords": ["str"],
        "suggested_edits": [
            {"section": "str", "original_text": "str", "upgraded_text": "str", "reason": "str"}
        ],
        "cv_strengths": ["str"],
        "prioritized_keywords": [{"keyword": "str", "priority": V.PRIORITIES}],
        "evidence_analysis": [
            {"claim": "str", "evidence_strength": V.EVIDENCE_STRENGTHS, "comment": "str"}
        ],
    },
    "writer": {"subject_line": "str", "content": "str", "tips": ["str"]},
}


def _child(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def _read(v: Column, spec: object, path: str) -> tuple[Column, Column]:
    """(value, error) of a variant under ``spec``.

    ``v`` is NULL when the field is missing.  The error names the first bad
    field in declared order.
    """
    missing = F.when(v.isNull(), F.lit(f"missing {path}"))
    if isinstance(spec, dict):
        parts = {k: _read(_child(v, k), s, f"{path}.{k}" if path else k) for k, s in spec.items()}
        wrong = F.when(~_is(v, "OBJECT"), F.lit(f"type {path or 'response'}"))
        error = F.coalesce(missing, wrong, *[e for _, e in parts.values()])
        return F.struct(*[c.alias(k) for k, (c, _) in parts.items()]), error
    if isinstance(spec, list):
        items = F.try_variant_get(v, "$", "array<variant>")
        value = F.transform(items, lambda x: _read(x, spec[0], f"{path}[]")[0])
        faults = F.filter(
            F.transform(items, lambda x: _read(x, spec[0], f"{path}[]")[1]), lambda e: e.isNotNull()
        )
        wrong = F.when(~_is(v, "ARRAY"), F.lit(f"type {path}"))
        return value, F.coalesce(missing, wrong, F.try_element_at(faults, F.lit(1)))
    text = F.try_variant_get(v, "$", "string")
    if spec == "int":
        # Integral numbers in any form pass: 95, "95", 95.0 and true; 95.0000001 does not.
        number = F.when(_is(v, "BOOLEAN"), (text == "true").cast("int").cast("decimal(38,18)")).otherwise(
            text.try_cast("decimal(38,18)")
        )
        whole = F.when(number == F.floor(number), number.try_cast("bigint"))
        return whole, F.coalesce(missing, F.when(whole.isNull(), F.lit(f"int {path}")))
    if spec == "bool":
        flag = text.try_cast("boolean")
        return flag, F.coalesce(missing, F.when(flag.isNull(), F.lit(f"bool {path}")))
    wrong = F.when(~_is(v, "STRING"), F.lit(f"type {path}"))
    if isinstance(spec, tuple):
        wrong = F.coalesce(wrong, F.when(~text.isin(*spec), F.lit(f"enum {path}")))
    return text, F.coalesce(missing, wrong)


def parse_responses(
    df: DataFrame, col: str, model: str | dict, parsed: str = "parsed", error: str = "error"
) -> DataFrame:
    """Validate JSON text against a declared model, row by row.

    Adds ``parsed``, a struct, and ``error``; exactly one of them is NULL.  All
    fields are required, unknown ones are ignored, and empty text is an error.
    """
    spec = MODELS[model] if isinstance(model, str) else model
    raw = F.col(col)
    # in brackets, as the parser itself takes no notice of text behind a value
    listed = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]")))
    rows = df.withColumn("__l", F.try_variant_get(listed, "$", "array<variant>"))
    rows = rows.withColumn("__v", F.when(F.size("__l") == 1, F.get("__l", F.lit(0)))).drop("__l")
    value, fault = _read(F.col("__v"), spec, "")
    text_fault = F.when(raw.isNull() | (raw == ""), F.lit("empty response")).when(
        F.col("__v").isNull(), F.lit("invalid json")
    )
    rows = rows.withColumn(error, F.coalesce(text_fault, fault))
    return rows.withColumn(parsed, F.when(F.col(error).isNull(), value)).drop("__v")


def _once(pairs: list[tuple]) -> dict:
    if len(found := dict(pairs)) < len(pairs):
        raise ValueError("a key comes twice")
    return found


def _no_constant(name: str) -> None:
    raise ValueError(name)


def fault_of(text: str | None, spec: object) -> str | None:
    """The error that :func:`parse_responses` gives for one text, for use inside a task."""
    if not text:
        return "empty response"
    try:
        value = json.loads(text, parse_float=Decimal, parse_constant=_no_constant, object_pairs_hook=_once)
    except (ValueError, RecursionError):
        return "invalid json"
    return _fault(value, spec, "")


def _number(value: object) -> Decimal | None:
    try:
        return Decimal(value.strip() if isinstance(value, str) else value)
    except (InvalidOperation, TypeError, ValueError):
        return None


def _fault(value: object, spec: object, path: str) -> str | None:
    if isinstance(spec, dict):
        if not isinstance(value, dict):
            return f"type {path or 'response'}"
        for name, inner in spec.items():
            at = f"{path}.{name}" if path else name
            if fault := (_fault(value[name], inner, at) if name in value else f"missing {at}"):
                return fault
        return None
    if isinstance(spec, list):
        if not isinstance(value, list):
            return f"type {path}"
        return next((f for x in value if (f := _fault(x, spec[0], f"{path}[]"))), None)
    if spec == "int":
        number = _number(value)
        fits = number is not None and number.is_finite() and number == number.to_integral_value() and abs(number) < 2**63
        return None if fits else f"int {path}"
    if spec == "bool":
        said = str(value).strip().lower() if isinstance(value, (bool, int, str)) else ""
        return None if said in ("true", "false", "t", "f", "yes", "no", "y", "n", "1", "0") else f"bool {path}"
    if not isinstance(value, str):
        return f"type {path}"
    return f"enum {path}" if isinstance(spec, tuple) and value not in spec else None


# --- checks that flag and never drop --------------------------------------------------


def _violations(df: DataFrame, checks: dict[str, Column], out: str = "violations") -> DataFrame:
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()]))
    return df.withColumn(out, found)


def check_enums(df: DataFrame, specs: dict[str, tuple[str, ...]]) -> DataFrame:
    """Adds ``violations``: the columns whose value is outside its declared set or NULL."""
    return _violations(
        df, {c: ~F.coalesce(F.col(c).isin(*allowed), F.lit(False)) for c, allowed in specs.items()}
    )


def enum_display(col: Column | str, shown: dict[str, str], fallback: str) -> Column:
    """Display form of an enum value; unknown values show the fallback."""
    table = F.create_map(*[F.lit(x) for pair in shown.items() for x in pair])
    return F.coalesce(F.try_element_at(table, as_column(col)), F.lit(fallback))


def check_ranges(df: DataFrame, columns: list[str], lo: int = 0, hi: int = 100) -> DataFrame:
    """Adds ``violations``: the score columns outside [lo, hi] or NULL."""
    return _violations(
        df, {c: ~F.coalesce(F.col(c).between(lo, hi), F.lit(False)) for c in columns}
    )


def check_list_sizes(
    df: DataFrame, sizes: dict[str, tuple[int, int]] | None = None
) -> DataFrame:
    """Adds ``violations``: the list columns whose size is outside its bounds or NULL."""
    specs = sizes or {k: v for k, v in V.LIST_SIZES.items() if k in df.columns}
    return _violations(
        df,
        {
            c: ~F.coalesce(F.size(F.col(c)).between(lo, hi), F.lit(False))
            for c, (lo, hi) in specs.items()
        },
    )


def default_fields(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """NULL fields to their defaults; a list default is an empty list."""
    return df.withColumns(
        {
            c: F.coalesce(
                F.col(c),
                F.array().cast(df.schema[c].dataType) if d == [] else F.lit(d).cast(df.schema[c].dataType),
            )
            for c, d in defaults.items()
        }
    )


# --- flattening ------------------------------------------------------------------------


def explode_experience(df: DataFrame, key: str, experience: Column | str = "experience") -> DataFrame:
    """One row per bullet with company, role and both positions.

    An entry without bullets keeps one row with a NULL bullet, and so does a
    record without entries.
    """
    entries = df.select(key, F.posexplode_outer(as_column(experience)).alias("entry_no", "e"))
    return entries.select(
        key, "entry_no", "e.company", "e.role",
        F.posexplode_outer("e.bullet_points").alias("bullet_no", "bullet"),
    )


def explode_list(df: DataFrame, key: str, items: Column | str, names: list[str] | None = None) -> DataFrame:
    """(key, pos, item...) of one array column; empty arrays give no rows."""
    rows = df.select(key, F.posexplode(as_column(items)).alias("pos", "item"))
    return rows.select(key, "pos", *[F.col(f"item.{n}") for n in names]) if names else rows


def explode_report(df: DataFrame, key: str, parsed: str = "parsed") -> dict[str, DataFrame]:
    """Child tables of a parsed report, one per array field."""
    fields = df.schema[parsed].dataType.fields
    out = {}
    for f in fields:
        element = getattr(f.dataType, "elementType", None)
        if element is not None:
            names = element.names if hasattr(element, "names") else None
            out[f.name] = explode_list(df, key, f"{parsed}.{f.name}", names)
    return out


CHILD = "array<struct<child:string,pos:array<int>,item:map<string,string>>>"


def _leaves(value: Column, kind: T.DataType) -> Column:
    """The fields of a list item that are neither lists nor objects, by name; ``value`` for a plain item."""
    if not isinstance(kind, T.StructType):
        return F.create_map(F.lit("value"), value.cast("string"))
    plain = [f.name for f in kind.fields if not isinstance(f.dataType, (T.ArrayType, T.StructType))]
    pairs = [x for n in plain for x in (F.lit(n), value[n].cast("string"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def _children(value: Column, kind: T.DataType, name: str) -> list[Column]:
    """Arrays of (child, pos, item) for all lists in a value, inner ones with the places of the outer."""
    if isinstance(kind, T.StructType):
        return [c for f in kind.fields for c in _children(value[f.name], f.dataType, f"{name}.{f.name}" if name else f.name)]
    if not isinstance(kind, T.ArrayType):
        return []
    element = kind.elementType

    def row(child: Column, pos: Column, item: Column) -> Column:
        return F.struct(child.alias("child"), pos.alias("pos"), item.alias("item"))

    own = F.transform(value, lambda x, i: row(F.lit(name), F.array(i), _leaves(x, element)))

    def within(n: int) -> Column:
        """The n-th list inside each item, with the item's place before its own."""

        def of_item(x: Column, i: Column) -> Column:
            return F.transform(_children(x, element, name)[n], lambda r: row(r["child"], F.concat(F.array(i), r["pos"]), r["item"]))

        return F.flatten(F.transform(value, of_item))

    nested = [within(n) for n in range(len(_children(F.lit(None).cast(element), element, name)))]
    return [own, *nested]


def explode_children(df: DataFrame, key: str, parsed: str = "parsed") -> DataFrame:
    """(key, child, pos, item): every list of a parsed response as rows of one table, in one scan.

    ``child`` names the list by its path, ``pos`` holds the places of the item in its list and in the
    lists around it, and ``item`` its fields as text.  Empty and missing lists give no rows.
    """
    none = F.array().cast(CHILD)
    found = [F.coalesce(c.cast(CHILD), none) for c in _children(F.col(parsed), df.schema[parsed].dataType, "")]
    return df.select(key, F.inline(F.concat(none, *found)))


def violation_text(col: str = "violations") -> Column:
    return F.array_join(F.sort_array(F.col(col)), ",")


