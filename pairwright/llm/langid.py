"""Language of a text by cross-parsing against labelled text.

For each language a suffix automaton holds every substring of some labelled text.  A
text is parsed from left to right into the longest phrases that occur there; the
language that needs the fewest phrases per character wins.  States and letters are
numbered, so the automaton of a language is one table, and numpy parses thousands of
stretches of text a step at a time.  The parse starts anew every ``STRETCH`` characters
and covers the whole text.

The sample is bounded: ``rows_per_language`` labelled rows, those with the smallest hash
of their id, and ``chars_per_language`` characters, an equal share of each row.  Rows
without a label or a letter teach nothing.  A text that is null or has no letter is
``und`` with score 0.  Where nothing could be learned, every text is ``und``.  Ties go
to the language first in order.  Repeated rows get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STRETCH = 512  #: characters after which the parse of a text starts anew
ROWS_PER_LANGUAGE = 400
CHARS_PER_LANGUAGE = 40_000
AT_ONCE = 2048  #: documents a worker parses together
UNKNOWN = "und"
HASHES = 1 << 40


def learnable(doc_id: Column) -> Column:
    """Rows to learn from; the others are held out."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


def labelled_sample(
    docs: DataFrame, rows_per_language: int, chars_per_language: int, lang: str = "lang", learn: Column | None = None
) -> dict[str, list[str]]:
    """Texts of each language: a bounded number of rows with the smallest hashes."""
    learn = learnable(F.col("doc_id")) if learn is None else learn
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("lang"), "text", F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)).alias("h"))
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per:
        return {}
    # a hash limit that lets through about twice the rows wanted, then the smallest of them
    limits, shares = [], []
    for k, n in per.items():
        limits += [F.lit(k), F.lit(int(HASHES * min(1.0, 2 * (rows_per_language + 20) / n)))]
        shares += [F.lit(k), F.lit(chars_per_language // min(rows_per_language, n) + 1)]
    near = rows.filter(F.col("h") < F.create_map(*limits)[F.col("lang")])
    near = near.select("lang", "h", _share(F.col("text"), F.create_map(*shares)[F.col("lang")], F.col("h")).alias("text"))
    got: dict[str, list[tuple[int, str]]] = {}
    for r in near.collect():
        got.setdefault(r.lang, []).append((r.h, r.text))
    return {k: [t for _, t in sorted(v)[:rows_per_language]] for k, v in sorted(got.items())}


def _share(text: Column, n: Column, h: Column) -> Column:
    """``n`` characters of a text, from a place that its hash gives."""
    at = F.pmod(h, F.greatest(F.length(text) - n, F.lit(1))).cast("int") + 1
    return F.substr(text, at, n)


class Automata:
    """Suffix automata of some languages as tables: state and letter to state, or -1."""

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.langs = sorted(texts)
        joined = {k: " ".join(v).lower() for k, v in texts.items()}
        letters = sorted({c for t in joined.values() for c in t if c.isalpha()})
        self.size = max(map(ord, letters), default=0) + 2
        self.symbols = np.full(self.size, 1, "i4")  # 1: not a letter; 0: a letter never seen
        for code in range(self.size - 1):
            self.symbols[code] = 0 if chr(code).isalpha() else 1
        for n, c in enumerate(letters):
            self.symbols[ord(c)] = n + 2
        self.symbols[-1] = 0
        self.width = len(letters) + 2
        self.tables = [self._table(self._numbers(joined[k])) for k in self.langs]

    def _numbers(self, lowered: str) -> np.ndarray:
        codes = np.frombuffer(lowered.encode("utf-32-le", "replace"), "<u4")
        return self.symbols[np.minimum(codes, self.size - 1)]

    def _table(self, text: np.ndarray) -> np.ndarray:
        """Online construction of the suffix automaton (Blumer et al.), one state a step."""
        moves, link, longest, last = [{}], [-1], [0], 0
        for c in text.tolist():
            new = len(moves)
            moves.append({})
            link.append(0)
            longest.append(longest[last] + 1)
            p = last
            while p != -1 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p != -1:
                q = moves[p][c]
                if longest[q] == longest[p] + 1:
                    link[new] = q
                else:
                    twin = len(moves)
                    moves.append(dict(moves[q]))
                    link.append(link[q])
                    longest.append(longest[p] + 1)
                    while p != -1 and moves[p].get(c) == q:
                        moves[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        table = np.full((len(moves), self.width), -1, "i4")
        for state, to in enumerate(moves):
            for c, s in to.items():
                table[state, c] = s
        table[:, 0] = -1  # letters never seen end every phrase
        return self._with_restarts(table)

    @staticmethod
    def _with_restarts(table: np.ndarray) -> np.ndarray:
        """Where a phrase ends, the next one begins with the same letter: the state after
        that, with the lowest bit set to count the phrase."""
        root = np.maximum(table[0], 0)
        return np.where(table >= 0, table << 1, (root << 1 | 1)[None, :]).astype("i4").ravel()

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of phrases (texts x languages), and of characters of each text."""
        numbers = [self._numbers(t.lower()) for t in texts]
        sizes = np.array([len(x) for x in numbers], "i8")
        stretches = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), stretches)
        starts = np.repeat(np.cumsum(sizes) - sizes, stretches)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
        starts = starts + nth * STRETCH
        length = np.minimum(STRETCH, np.repeat(sizes, stretches) - nth * STRETCH)
        order = np.argsort(-length, kind="stable")
        owner, starts, length = owner[order], starts[order], length[order]
        text = np.concatenate(numbers) if numbers else np.zeros(0, "i4")
        active = np.searchsorted(-length, -np.arange(STRETCH), side="left")  # stretches longer than t
        columns = [text[starts[:n] + t] for t, n in enumerate(active) if n]
        counts = np.zeros((len(texts), len(self.langs)))
        for k, table in enumerate(self.tables):
            state, found = np.zeros(len(owner), "i4"), np.ones(len(owner), "i4")
            for symbols in columns:
                n = len(symbols)
                got = table[state[:n] * self.width + symbols]
                found[:n] += got & 1
                state[:n] = got >> 1
            counts[:, k] = np.bincount(owner, found, len(texts))
        return counts, sizes


def classify(automata: Automata | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text.

    The score is how much shorter the winner's parse is than the runner-up's: 0 for a
    tie, near 1 where the runner-up needs many times the phrases; 1 where one language
    alone was learned.
    """
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, t in enumerate(texts) if automata and t and any(map(str.isalpha, t))]
    if not known:
        return langs, scores
    counts, _ = automata.phrases([texts[i] for i in known])
    best = counts.argmin(1)
    ranked = np.sort(counts, 1)
    gain = 1 - ranked[:, 0] / ranked[:, 1] if ranked.shape[1] > 1 else np.ones(len(known))
    for i, k, s in zip(known, best.tolist(), gain.tolist()):
        langs[i], scores[i] = automata.langs[k], s
    return langs, scores


def learn(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, chars_per_language: int = CHARS_PER_LANGUAGE) -> Automata | None:
    texts = labelled_sample(docs, rows_per_language, chars_per_language)
    return Automata(texts) if texts else None


def identify(docs: DataFrame, automata: Automata | None, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` of each row's text."""
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(automata)

    def predict(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(a, AT_ONCE)
                langs, scores = classify(shared.value, part.column(0).to_pylist())
                columns = [*part.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    rows = docs.select(F.col("text").alias("__text"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)])
    fields = [(f"c{i}", docs.schema[c].dataType.simpleString()) for i, c in enumerate(keep)]
    fields += [(f"c{len(keep)}", "string"), (f"c{len(keep) + 1}", "double")]
    found = rows.mapInArrow(predict, ", ".join(f"{n} {t}" for n, t in fields))
    return found.toDF(*keep, "lang_pred", "score")


def predict_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    found = identify(docs.select("doc_id", "text"), learn(docs), ["doc_id"])
    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """Rows whose language could be told: those with a letter in their text.

    A null text has none.  The rule is the same where no row of the corpus has a label to learn from.
    """
    automata = learn(docs)
    if automata is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, automata, docs.columns)
    return found.filter(F.col("lang_pred") != UNKNOWN).select(*docs.columns)
