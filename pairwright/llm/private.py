"""Personal data and secrets replaced by keyed surrogates of the same kind.

Every entity gets a surrogate that its kind, its normal form and the key alone decide, so
one entity has one surrogate in all documents, however it is written.  The surrogate
keeps the format: separators and country codes of numbers, the check digit of cards,
title, gender and script of names, the name of a secret.  Number surrogates come from a
keyed permutation of their digits (a Feistel network), so they are distinct by
construction; the others are drawn from wide spaces: 60 bits for a family name, 52 more
for a given name, 64 for a mail name within its domain, an access key or a secret.  Two
of 10^8 families share one under 0.4 % of the keys, so the check over the distinct
entities of all documents ends soon: should two of them share a surrogate, all are drawn
anew under the next key.

A text is cut where entities are found and put together again with their surrogates, so
text around them stays as it is.  A person is found by a title; what the text between
entities says of the same person without one, by full name, family or given name, before
or after, gets the same surrogate.  Null texts stay null and have no entities.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.plans.scale import materialize

KEY = "surrogates"
ROUNDS = 6

# Titles that tell a person's gender, in the scripts known here.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Г-жа", "Госпожа")

# Stems of given names and syllables, of two letters each, that surrogates are made of.
STEMS = {
    ("latin", "m"): ("Alan", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Leon", "Marco", "Noel", "Oscar", "Paul", "Ralf", "Simon", "Tom"),
    ("latin", "f"): ("Alma", "Bella", "Clara", "Dora", "Emma", "Flora", "Greta", "Helen", "Irma", "Julia", "Laura", "Marta", "Nora", "Olga", "Rosa", "Vera"),
    ("cyrillic", "m"): ("Антон", "Борис", "Вадим", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Юрий"),
    ("cyrillic", "f"): ("Алла", "Вера", "Галина", "Дарья", "Ева", "Жанна", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Юлия"),
}
SYLLABLES = {
    "latin": tuple(c + v for c in "bdfghjklmnprstvz" for v in "aeio"),
    "cyrillic": tuple(c + v for c in "бвгджзклмнпрстфх" for v in "аеио"),
}
GIVEN = 8  #: syllables after the stem of a given name, 6 bits each
FAMILY = 10  #: syllables of a family name


class Names:
    """All given names of one script and gender: each stem with any ``GIVEN`` syllables."""

    def __init__(self, script: str, gender: str):
        made = "|".join(STEMS[script, gender]), "|".join(SYLLABLES[script])
        self.form = re.compile("(?:%s)(?:%s){%d}" % (*made, GIVEN))

    def __contains__(self, name: str) -> bool:
        return self.form.fullmatch(name) is not None


NAMES = {of: Names(*of) for of in STEMS}

EMAIL = r"(?<![A-Za-z0-9_.%+-])[A-Za-z0-9_.%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
SECRET = r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|token|secret|api[_-]?key)\s{0,2}[:=]\s{0,2}[\"']?[^\s\"',;]{6,}"
ACCESS = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
ADDRESS = rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)"
CARD = r"(?<![\w.+])\d(?:[ -]?\d){12,18}(?!\w)"
SOCIAL = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w.])(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5})(?!\w)"
NAME = r"(?<!\w)(?:" + "|".join(MALE + FEMALE) + r")\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?"

KINDS = {
    "email": EMAIL, "secret": SECRET, "access_key": ACCESS, "address": ADDRESS, "phone": PHONE,
    "social": SOCIAL, "card": CARD, "name": NAME,
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def entities(text: Column) -> Column:
    """The entities of a text, in order."""
    return F.regexp_extract_all(text, F.lit(ANY), F.lit(0))


def kind_of(found: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(found.rlike(rf"\A(?:{pattern})\z"), F.lit(kind)).otherwise(out)
    return out


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _person(m: Column) -> Column:
    return F.regexp_replace(m, r"^\S+ ", "")


def normal_form(kind: Column, m: Column) -> Column:
    """What two ways of writing one entity have in common."""
    value = F.regexp_replace(m, r"^[^:=]*[:=]\s*[\"']?", "")
    return (
        F.when(kind.isin("phone", "card", "social"), _digits(m))
        .when(kind == "email", F.lower(m))
        .when(kind == "secret", value)
        .when(kind == "address", F.regexp_replace(m, r"\b0+(?=\d)", ""))
        .when(kind == "name", _person(m))
        .otherwise(m)
    )


def _number(key: Column, of: Column, below: int | Column) -> Column:
    """A keyed number drawn from 48 bits."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", key, of)), 1, 12), 16, 10).cast("long")
    return F.pmod(drawn, below if isinstance(below, Column) else F.lit(below))


def _letters(key: Column, of: Column, n: int) -> Column:
    """``n`` keyed letters a-p, four bits each."""
    return F.translate(F.substring(F.sha2(F.concat_ws("|", key, of), 256), 1, n), "0123456789abcdef", "ghijklmnopabcdef")


def _permuted(key: Column, left: Column, right: Column, below: Column) -> Column:
    """A Feistel network on two numbers below a bound: a bijection of the pairs."""
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def turn(s: Column, r: Column) -> Column:
        mixed = F.pmod(s["a"] + _number(key, F.concat_ws("|", r.cast("string"), s["b"].cast("string")), below), below)
        return F.struct(s["b"].alias("a"), mixed.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _new_digits(key: Column, digits: Column) -> Column:
    """The last digits, up to 14 and an even number of them, permuted."""
    half = F.floor(F.least(F.char_length(digits), F.lit(14)) / 2).cast("int")
    kept = F.char_length(digits) - 2 * half
    below = F.pow(F.lit(10), half).cast("long")
    pair = _permuted(key, F.substr(digits, kept + 1, half), F.substr(digits, kept + half + 1, half), below)
    return F.transform(
        F.array(pair),
        lambda p: F.concat(
            F.substr(digits, F.lit(1), kept),
            F.lpad(p["a"].cast("string"), half, "0"),
            F.lpad(p["b"].cast("string"), half, "0"),
        ),
    )[0]


def _check_digit(digits: Column) -> Column:
    """Luhn's check digit for the digits before it."""
    n = F.char_length(digits)

    def share(i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.floor(2 * d / 10).cast("int") + 2 * d % 10).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), share), F.lit(0), lambda a, b: a + b)
    return F.pmod(-total, F.lit(10))


def _new_card(key: Column, digits: Column) -> Column:
    """All but the last digit permuted; a right check digit stays right, a wrong one as wrong."""
    body = F.substr(digits, F.lit(1), F.char_length(digits) - 1)
    off = F.substr(digits, F.char_length(digits)).cast("int") - _check_digit(body)
    return F.transform(
        F.array(_new_digits(key, body)),
        lambda b: F.concat(b, F.pmod(_check_digit(b) + off, F.lit(10)).cast("string")),
    )[0]


def _written_like(m: Column, digits: Column) -> Column:
    """``m`` with its digits replaced in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def put(s: Column, c: Column) -> Column:
        at = s["at"] + 1
        return F.when(
            c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, at, F.lit(1))).alias("out"), at.alias("at"))
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))

    return F.aggregate(F.split(m, ""), start, put, lambda s: s["out"])


def _new_address(key: Column, m: Column) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
    pair = _permuted(key, o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536).cast("long"))
    return F.transform(
        F.array(pair),
        lambda p: F.concat_ws(
            ".",
            *[x.cast("string") for x in (F.floor(p["a"] / 256), p["a"] % 256, F.floor(p["b"] / 256), p["b"] % 256)],
        ),
    )[0]


def _pick(key: Column, of: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (_number(key, of, len(values)) + 1).cast("int"))


def _syllables(key: Column, of: Column, n: int, table: Column) -> Column:
    """``n`` keyed syllables of a table of 64."""
    drawn = F.sha2(F.concat_ws("|", key, of), 256)

    def one(i: Column) -> Column:
        at = F.conv(F.substr(drawn, 2 * i + 1, F.lit(2)), 16, 10).cast("int") % 64
        return F.substr(table, 2 * at + 1, F.lit(2))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one), "")


def _new_name(key: Column, m: Column) -> Column:
    """Title kept; given name by gender and family name of syllables, both in the script found."""
    parts = F.split(_person(m), " ")
    family, given = F.element_at(parts, -1), F.when(F.size(parts) > 1, parts[0])
    female = m.rlike("^(?:" + "|".join(FEMALE) + r")\b")
    out = {}
    for script in ("cyrillic", "latin"):
        table = F.lit("".join(SYLLABLES[script]))
        made = _syllables(key, F.concat_ws("|", F.lit("family"), family), FAMILY, table)
        stem = F.when(female, _pick(key, given, STEMS[script, "f"])).otherwise(_pick(key, given, STEMS[script, "m"]))
        first = F.concat(stem, _syllables(key, F.concat_ws("|", F.lit("given"), given), GIVEN, table))
        title = F.regexp_extract(m, r"^\S+", 0)
        out[script] = F.concat_ws(" ", title, F.when(given.isNotNull(), first), F.initcap(made))
    return F.when(family.rlike(r"\p{IsCyrillic}"), out["cyrillic"]).otherwise(out["latin"])


def surrogate(kind: Column, m: Column, key: str) -> Column:
    """The surrogate of an entity, written as the entity is."""
    keyed = F.concat_ws("|", F.lit(key), kind)
    form = normal_form(kind, m)
    domain = F.regexp_extract(form, r"@(.*)\.[^.]*$", 1)
    mail = F.concat(
        _letters(keyed, form, 16), F.lit("@"), _letters(keyed, domain, 8), F.regexp_extract(form, r"\.[^.]*$", 0)
    )
    lead = F.regexp_extract(m, r"^[^:=]*[:=]\s*[\"']?", 0)
    length = F.greatest(F.least(F.char_length(form), F.lit(64)), F.lit(16))
    secret = F.concat(lead, F.substr(F.sha2(F.concat_ws("|", keyed, form), 256), F.lit(1), length))
    access = F.concat(F.substring(m, 1, 4), F.upper(_letters(keyed, form, 16)))
    return (
        F.when(kind == "email", mail)
        .when(kind == "secret", secret)
        .when(kind == "access_key", access)
        .when(kind == "address", _new_address(keyed, m))
        .when(kind == "card", _written_like(m, _new_card(keyed, _digits(m))))
        .when(kind.isin("phone", "social"), _written_like(m, _new_digits(keyed, _digits(m))))
        .when(kind == "name", _new_name(keyed, m))
        .otherwise(m)
    )


def distinct_entities(docs: DataFrame) -> DataFrame:
    """kind, normal form and one written form of every entity of all documents."""
    found = docs.select(F.explode(entities(F.col("text"))).alias("m")).withColumn("kind", kind_of(F.col("m")))
    return found.groupBy("kind", normal_form(F.col("kind"), F.col("m")).alias("form")).agg(F.min("m").alias("m"))


def distinct_key(docs: DataFrame, key: str = KEY) -> str:
    """The first key of a series under which no two entities share a surrogate."""
    found, turn = materialize(distinct_entities(docs), "entities"), 0
    while True:
        keyed = f"{key}-{turn}"
        made = found.select("kind", normal_form(F.col("kind"), surrogate(F.col("kind"), F.col("m"), keyed)).alias("s"))
        shared = made.groupBy("kind", "s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
        if shared.isEmpty():
            return keyed
        turn += 1


def known_names(found: Column, key: str) -> Column:
    """The names of the persons among the entities, whole and in parts, each with its surrogate.

    Longer ones come first, and whole and family names before given names."""
    person = F.array_distinct(F.filter(found, lambda m: m.rlike(rf"\A(?:{NAME})\z")))

    def parts(m: Column, new: Column) -> Column:
        def entry(rank: int, word: Column, by: Column) -> Column:
            return F.struct((-F.char_length(word)).alias("size"), F.lit(rank).alias("rank"), word.alias("word"), by.alias("new"))

        old, made = F.split(_person(m), " "), F.split(_person(new), " ")
        one = F.array(entry(0, F.element_at(old, -1), F.element_at(made, -1)))
        return F.when(
            F.size(old) > 1, F.concat(F.array(entry(0, _person(m), _person(new)), entry(1, old[0], made[0])), one)
        ).otherwise(one)

    keyed = F.concat_ws("|", F.lit(key), F.lit("name"))
    each = F.transform(person, lambda m: F.transform(F.array(_new_name(keyed, m)), lambda new: parts(m, new))[0])
    return F.array_sort(F.flatten(each))


def mention(known: Column) -> Column:
    """A pattern of the known names as whole words."""
    words = F.array_join(F.transform(known, lambda k: k["word"]), "|")
    return F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), words, F.lit(r")(?![\p{L}\p{N}_])"))


def _joined(between: Column, new: Column) -> Column:
    return F.array_join(F.zip_with(between, new, lambda b, s: F.concat(b, F.coalesce(s, F.lit("")))), "")


def _without_names(part: Column, known: Column, pattern: Column) -> Column:
    """A text between entities, with surrogates in place of the known names."""
    new = F.transform(
        F.regexp_extract_all(part, pattern, F.lit(0)),
        lambda m: F.filter(known, lambda k: k["word"] == m)[0]["new"],
    )
    return _joined(F.split(part, pattern, -1), new)


def protect(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, number of entities, and the text with surrogates, of every row."""
    keyed = distinct_key(docs, key)
    text, found, between = F.col("text"), F.col("found"), F.col("between")
    cut = docs.select("doc_id", "text", entities(text).alias("found"), F.split(text, ANY, -1).alias("between"))
    named = cut.withColumn("known", known_names(found, keyed)).withColumn("pattern", mention(F.col("known")))
    has_names = F.size("known") > 0
    mentions = F.aggregate(
        between, F.lit(0), lambda n, b: n + F.size(F.regexp_extract_all(b, F.col("pattern"), F.lit(0)))
    )
    n = F.size(found) + F.when(has_names, mentions).otherwise(0)
    new = F.transform(found, lambda m: F.transform(F.array(kind_of(m)), lambda k: surrogate(k, m, keyed))[0])
    rest = F.when(
        has_names, F.transform(between, lambda b: _without_names(b, F.col("known"), F.col("pattern")))
    ).otherwise(between)
    return named.select(
        "doc_id",
        F.greatest(F.coalesce(n, F.lit(0)), F.lit(0)).cast("long").alias("n_entities"),
        F.when(F.size(found) > 0, _joined(rest, new)).otherwise(text).alias("text"),
    )
