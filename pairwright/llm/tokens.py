"""Token ids of whole texts, with a bounded cache of words in each Python worker.

The tokenizers library spends most of its time on words it has seen before.  A text
is therefore cut at its single spaces and line breaks, where the pre-tokenizers known
here cut as well, and the ids of each part are looked up; the library encodes the
parts not seen yet.  Any other tokenizer, and any text with other white space, is
encoded whole, so the ids are the library's in every case.
"""

from __future__ import annotations

import functools
import json
import operator
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_PARTS = 500_000  #: parts of a generation; those not used in the next one are forgotten
#: letters, then ASCII marks; the apostrophe is left out, as it starts contractions
WORD = re.compile(r"\x00?([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
SPACE = "Ġ"  #: how byte-level vocabularies write a space
FRESH = "\x00"  #: marks a part that follows a line break, not a space


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte of Latin-1 order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(256 + n) for n, b in enumerate(hidden)}


class Encoder:
    """Gives the ids of texts as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lower = bool(spec.get("normalizer"))
        self.by_parts = self._has_known_rules(spec)
        self.added = tuple(t["content"] for t in spec.get("added_tokens", ()))
        self.shown = np.arange(256, dtype="<u4")
        for byte, letter in _byte_letters().items():
            self.shown[byte] = ord(letter) if byte != 0x20 else 0x20
        self.tails = {"": b""}
        self.parts: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        if self.by_parts:
            self.words = Tokenizer(self.tokenizer.model)  # the merges alone, for ready pre-tokens
            of = self.tokenizer.get_vocab(with_added_tokens=False)
            self.letters = np.zeros(max(of.values(), default=-1) + 1, "i8")
            end = spec["model"].get("end_of_word_suffix") or ""
            self.letters[list(of.values())] = [len(t.removesuffix(end)) for t in of]
            self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")

    @staticmethod
    def _has_known_rules(spec: dict) -> bool:
        """Rules under which no token spans a space or line break between other characters."""
        normal, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        if spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
            return False
        if normal is None:
            return pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        kinds = [n["type"] for n in normal.get("normalizers", ())]
        steps = pre.get("pretokenizers", ())
        return (
            kinds == ["NFC", "Replace", "Lowercase"]
            and [s["type"] for s in steps] == ["Split", "ByteLevel"]
            and steps[0]["behavior"] == "Removed"
            and not steps[1]["use_regex"]
            and not steps[1]["add_prefix_space"]
        )

    def _whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def _letters(self, words: list[str], spaced: bool) -> list[bytes]:
        """Ids of words made of letters: one pre-token each, so the merges alone decide."""
        text = " ".join(words)
        raw = (text.lower() if self.lower else text).encode()
        shown = self.shown[np.frombuffer(raw, "u1")].tobytes().decode("utf-32-le")
        if spaced:
            shown = SPACE + shown.replace(" ", " " + SPACE)
        found = self.words.encode_batch_fast([shown], add_special_tokens=False)[0]  # without offsets
        ids = np.asarray(found.ids, "<u4")
        # a token stands for as many bytes as it has letters, so bytes tell where a word ends
        of_ids, of_words = np.cumsum(self.letters[ids]), [len(w) for w in shown.split(" ")]
        ends = np.append(0, 1 + np.searchsorted(of_ids, np.cumsum(of_words)))
        if len(ids) == 0 or of_ids[-1] != sum(of_words):  # letters that the vocabulary has not
            return [self._whole(" " + w if spaced else w) for w in words]
        held, ends = ids.tobytes(), (4 * ends).tolist()
        return [held[a:b] for a, b in zip(ends, ends[1:])]

    def _learn(self, missing: set[str]) -> None:
        """Encode parts not seen yet: words of letters together, others one by one."""
        for spaced in (False, True):
            some = [p for p in missing if (not self.lower and p[:1] != FRESH) == spaced]
            found = [(p, m[1], m[2]) for p, m in zip(some, map(WORD.fullmatch, some)) if m]
            if found:
                parts, cores, tails = zip(*found)
                for tail in set(tails).difference(self.tails):
                    self.tails[tail] = self._whole(tail)
                ids: dict[str, bytes] = dict.fromkeys(cores)  # words with several tails are encoded once
                several = list(ids)
                for a in range(0, len(several), 8192):
                    some_words = several[a : a + 8192]
                    ids.update(zip(some_words, self._letters(some_words, spaced)))
                joined = map(operator.add, map(ids.__getitem__, cores), map(self.tails.__getitem__, tails))
                self.parts.update(zip(parts, joined))
            for part in set(some).difference(self.parts):
                text = part.removeprefix(FRESH)
                self.parts[part] = self._whole(" " + text if spaced else text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """``encode`` of each text; words that several of them share are encoded once."""
        plain = [self.by_parts and self._is_plain(t) for t in texts]
        cut = iter(self._by_parts([t for t, p in zip(texts, plain) if p]))
        return [next(cut) if p else self._whole(t) for t, p in zip(texts, plain)]

    def _by_parts(self, texts: list[str]) -> list[bytes]:
        """Ids of plain texts, each distinct part looked up once and its ids copied to its places."""
        if not texts:
            return []
        if len(self.parts) > CACHED_PARTS:
            self.before, self.parts = self.parts, {}
        lists = pc.split_pattern(pa.array(map(self._marked, texts), pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        parts, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        missing = set(parts).difference(self.parts)
        again = missing.intersection(self.before)
        self.parts.update(zip(again, map(self.before.__getitem__, again)))
        self._learn(missing - again)
        found = list(map(self.parts.__getitem__, parts))
        ids, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), "i8", len(found)) // 4
        n = sizes[place]
        ends = np.cumsum(n)
        shift = (np.cumsum(sizes) - sizes)[place] - (ends - n)
        whole = ids[np.arange(ends[-1]) + np.repeat(shift, n)].tobytes()
        cuts = (4 * np.append(0, ends)[lists.offsets.to_numpy()]).tolist()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def _marked(self, text: str) -> str:
        """A plain text whose parts a space divides; each but the first and those after breaks has one before."""
        return text.replace("\n", " ") if self.lower else FRESH + text.replace("\n", f" {FRESH}\n {FRESH}")

    def _is_plain(self, text: str) -> bool:
        """Every run of white space is one space or line break, none at the ends."""
        if FRESH in text or any(t in text for t in self.added):
            return False
        if "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
            return False
        return len(text.split()) == 1 + text.count(" ") + text.count("\n")


@functools.cache
def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path)
