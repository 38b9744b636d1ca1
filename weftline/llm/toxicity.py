"""Toxicity: a noisy-channel model restores disguised words, then the restored text is scored.

Words that look disguised (signs or digits beside letters, single letters with separators, repeated letters) become a
lattice: each sign offers letters with a channel cost, repeats may vanish, separators vanish or end a word. Viterbi decoding under a
character trigram model of all texts picks the spelling. Words and word beginnings that mark toxic rows of the
sample form a lexicon (each new entry has to explain rows that earlier ones leave unexplained, so the rare words of
copied documents do not enter). A text's score joins its distinct hits, plain or restored, as 1 - product(1 - p).

Labels come from at most ``FIT_ROWS`` rows outside the held-out fold; every text is scored whole, map-only.

Defined results: null and empty texts get the score of a text without hits; a null id gives held_out null and stays;
repeated rows each give a row; with no labelled rows every score is 0; further columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heapreplace

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import drop_written, remainder, slices, texts
from weftline.llm.fitting import FIT_ROWS, labelled_sample

MODULUS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
SIGN_COST, REPEAT_COST, SEPARATOR_COST, WORD_COST = 1.0, 0.5, 0.1, 1.0
SEPARATORS = " ._*-"
MIN_SUPPORT, MIN_PURITY = 3, 0.8
PREFIXES = range(4, 9)

_LETTER = r"[^\W\d_]"
_LEET = re.escape("".join(SIGNS))
_ANY = rf"(?:{_LETTER}|[{_LEET}])"
_SPACED = re.compile(rf"(?<!\w){_ANY}([ ._*\-])(?:{_ANY}\1)+{_ANY}(?!\w)")  # i d i o t
_SIGNED = re.compile(rf"{_LETTER}[{_LEET}]|[{_LEET}]{_LETTER}")  # 1d10t
_REPEATED = re.compile(rf"({_LETTER})\1")  # iddiot
_EDGE = ".,;:?\"'*%&#<>[]{}-_=/)"
#: Signs that may as well be punctuation at the edges of a run.
_MARKS = "!$|+("
_OUTSIDE = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower case, everything but letters as one blank, a blank at either end."""
    return " " + _OUTSIDE.sub(" ", text.lower()) + " "


def disguised(text: str) -> list[str]:
    """Runs that the channel may have changed; those with marks at their edges also without these."""
    text = text.lower()
    found = [t for t in dict.fromkeys(text.split()) if _SIGNED.search(t) or _REPEATED.search(t)]
    found += [m.group() for m in _SPACED.finditer(text)]
    whole = [r.strip(_EDGE) for r in found]
    runs = dict.fromkeys([*whole, *(r.strip(_EDGE + _MARKS) for r in whole)])
    return [r for r in runs if len(r) >= 3 and (_REPEATED.search(r) if r.isalpha() else any(map(str.isalpha, r)))]


#: Alphabet of the character model: blank, a to z, any other letter. Accents do not count.
LETTERS = " abcdefghijklmnopqrstuvwxyz*"


@lru_cache(1)
def letter_codes() -> np.ndarray:
    """Place in ``LETTERS`` of every code point of lower-case text; what ``plain`` makes a blank is 0."""
    out = np.zeros(sys.maxunicode + 1, np.int64)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalnum() and not c.isdecimal():
            out[i] = max(LETTERS.find(unicodedata.normalize("NFKD", c)[0], 1) if i < 0x250 else 0, 0) or len(LETTERS) - 1
    return out


def trigrams(text: str) -> np.ndarray:
    """How often each trigram of ``LETTERS`` ends at a letter of ``text`` or behind a word; words begin with two blanks."""
    c = letter_codes()[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)]
    c = c[np.concatenate([[True], (c[1:] > 0) | (c[:-1] > 0)])]  # one blank between words
    before = c[1:-1]
    two = np.where(before > 0, c[:-2], 0) * len(LETTERS) + before
    first = c[1:2] if len(c) > 1 else c[:0]
    return np.bincount(np.concatenate([first, two * len(LETTERS) + c[2:]]), minlength=len(LETTERS) ** 3)


class Language:
    """Character trigrams with additive smoothing."""

    def __init__(self, grams: np.ndarray):
        n = len(LETTERS)
        three = np.asarray(grams, float).reshape(n, n, n)
        self.costs = (-np.log((three + 0.05) / (three.sum(2, keepdims=True) + 2.0))).ravel().tolist()
        self.code = letter_codes()

    def cost(self, context: str, letter: str) -> float:
        a, b, c = (int(self.code[ord(x)]) for x in context + letter)
        return self.costs[(a * len(LETTERS) + b) * len(LETTERS) + c]


def counted_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigrams of all texts; partitions count first and give a row per trigram of the alphabet at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(LETTERS) ** 3, np.int64)
        for batch in batches:
            for part in slices(batch):
                total += trigrams(" ".join(part.column("text").to_pylist()))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["gram", "n"])

    got = texts(docs).select("text").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(len(LETTERS) ** 3, np.int64)
    for r in got.collect():  # bounded by the alphabet
        out[r["gram"]] = r["n"]
    return out


def restore(run: str, language: Language) -> str:
    """The cheapest spelling of a run through the lattice: signs, separators and repeats against the trigrams.

    A separator vanishes or ends a word, so a spelling may hold several words. Spellings are linked letters, so that a
    long run costs no more a sign than a short one.
    """
    fresh = ("  ", "")
    states: dict = {fresh: (0.0, None)}  # (last two letters, last sign seen) -> cost, spelling
    for c in run:
        new: dict = {}

        def keep(key: tuple, cost: float, text: tuple | None, new: dict = new) -> None:
            if key not in new or cost < new[key][0]:
                new[key] = (cost, text)

        options = [(x, SIGN_COST) for x in SIGNS.get(c, "")] or ([(c, 0.0)] if c.isalpha() else [])
        for (context, last), (cost, text) in states.items():
            if not options:
                keep((context, last), cost + (SEPARATOR_COST if c in SEPARATORS else 2.0), text)
                if context != "  ":
                    keep(fresh, cost + WORD_COST + language.cost(context, " "), (text, " "))
            for letter, extra in options:
                keep((context[1] + letter, letter), cost + extra + language.cost(context, letter), (text, letter))
                if letter == last:
                    keep((context, last), cost + REPEAT_COST, text)
        states = new
    _, text = min(((cost + (language.cost(context, " ") if context != "  " else 0.0), text) for (context, _), (cost, text) in states.items()), key=lambda x: x[0])
    out = []
    while text:
        text, letter = text
        out.append(letter)
    return "".join(reversed(out))


@dataclass
class Model:
    """Entries are word beginnings (" idio") or whole words (" scum ") with the share of toxic rows among those with it."""

    entries: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    grams: np.ndarray = field(default_factory=lambda: np.zeros(len(LETTERS) ** 3, np.int64))

    def scorer(self):
        language = Language(self.grams)
        short = lru_cache(100_000)(lambda run: restore(run, language))
        spell = lambda run: short(run) if len(run) <= 64 else restore(run, language)
        found = ahocorasick.Automaton()
        for e, p in self.entries.items():
            found.add_word(e, (e, p))
        if self.entries:
            found.make_automaton()

        def score(text: str) -> float:
            miss = 1.0 - self.base
            if self.entries and text:
                whole = plain(text) + " ".join(spell(r) for r in disguised(text)) + " "
                for _, p in {e: p for _, (e, p) in found.iter(whole)}.items():
                    miss *= 1.0 - p
            return 1.0 - miss

        return score


def marks(text: str) -> set[str]:
    """Candidate entries of a text: its words and their beginnings."""
    out = set()
    for w in set(plain(text).split()):
        if len(w) >= 3:
            out.add(f" {w} ")
            out.update(f" {w[:n]}" for n in PREFIXES if n <= len(w))
    return out


def counted(sample: DataFrame, each, limit: int = 200_000) -> DataFrame:
    """For each mark that ``each(text)`` gives: toxic and other rows with it; partitions count first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            every = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), pa.array([counts[1][e] for e in every], pa.int64()), pa.array([counts[0][e] for e in every], pa.int64())], names=["mark", "n1", "n0"])
            counts[0].clear(), counts[1].clear()

        for batch in batches:
            for part in slices(batch):
                for text, label in zip(part.column("text").to_pylist(), part.column("label").to_pylist(), strict=True):
                    counts[bool(label)].update(each(text))
                if len(counts[0]) + len(counts[1]) > limit:
                    yield from out()
        yield from out()

    got = sample.select("text", "label").mapInArrow(run, "mark string, n1 long, n0 long")
    return got.groupBy("mark").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model:
    """Character model from all texts, lexicon from a bounded sample of labelled rows."""
    spark = docs.sparkSession
    sample = labelled_sample(docs, labels, "toxic", MODULUS, HELD_OUT, limit)
    try:
        totals = {bool(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
        if not totals.get(True):
            return Model()
        grams = counted_trigrams(docs)
        language = spark.sparkContext.broadcast(grams)  # bounded by the alphabet

        def seen(text: str, held: dict = {}) -> set[str]:  # noqa: B006  one model for each worker
            if "m" not in held:
                held["m"] = Language(language.value)
            return marks(" ".join([text, *(restore(r, held["m"]) for r in disguised(text))]))

        pure = counted(sample, seen).where((F.col("n1") >= MIN_SUPPORT) & (F.col("n1") >= MIN_PURITY * (F.col("n1") + F.col("n0") + 1)))
        share = {r["mark"]: r["n1"] / (r["n1"] + r["n0"] + 1) for r in pure.collect()}  # bounded by the sample

        def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    own = [sorted(seen(t) & share.keys()) for t in part.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.string()))], names=["marks"])

        rows = [set(r["marks"]) for r in sample.where("label = 1").select("text").mapInArrow(holds, "marks array<string>").collect()]  # of the sample
        chosen = lexicon(rows, share)
        unexplained = sum(not (r & chosen) for r in rows)
        return Model({e: share[e] for e in sorted(chosen)}, unexplained / (unexplained + totals.get(False, 0) + 1), grams)
    finally:
        drop_written(sample)


def lexicon(rows: list[set[str]], share: dict[str, float]) -> set[str]:
    """Greedy choice: the entry with most rows, a row counting half for each entry that already explains it."""
    weight = [1.0] * len(rows)
    where: dict[str, list[int]] = {e: [] for e in share}
    for i, r in enumerate(rows):
        for e in r:
            where[e].append(i)
    gain = {e: float(len(w)) for e, w in where.items()}
    chosen: set[str] = set()
    key = lambda e: (-round(gain[e] * share[e] ** 4, 6), len(e), e)
    heap = [key(e) for e in gain]
    heapify(heap)
    while heap:
        best = heap[0][2]
        if key(best) != heap[0]:  # gains only fall, so an old key is never too late
            heapreplace(heap, key(best))
            continue
        heappop(heap)
        if gain.pop(best) < MIN_SUPPORT - 0.5:
            break
        chosen.add(best)
        for i in where[best]:
            for e in rows[i]:
                if e in gain:
                    gain[e] -= weight[i] / 2
            weight[i] /= 2
    return chosen


def score(df: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the fit's parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value.scorer()
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(of, part.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    got = texts(df).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
