"""Quality classifier: ridge regression on random Fourier features, calibrated by isotonic regression.

Each whole text gives a vector of document statistics. Cosines of random projections approximate a Gaussian kernel
over the standardised statistics. Partitions add up the normal equations of each fold; their sums give one ridge
solution per left-out fold and one for all. Out-of-fold scores fit a monotone step function (pool adjacent
violators) that turns scores into probabilities.

The fit reads at most ``FIT_ROWS`` labelled rows outside the held-out fold (a documented bound), in ``FIT_PARTS``
partitions, so what reaches the driver is bounded. Scoring is map-only over all texts.

Defined results: null and empty texts are scored like any other (all counts 0); a null id gives held_out null and
stays; repeated rows each give a row; with no labelled rows, or one class only, every score is that class's share
(0.5 without rows); further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import drop_written, remainder, slices, texts, written
from weftline.llm.fitting import FIT_ROWS, labelled_sample

MODULUS, HELD_OUT, THRESHOLD = 3, 1, 0.5
FEATURES, BANDWIDTH, RIDGE, FOLDS, FIT_PARTS, SEED = 256, 1.0, 1e-3, 5, 16, 7
_LINE = re.compile(r"[^\n]+")
_SYMBOLS, _PUNCTUATION = [ord(c) for c in "#*$%&|<>"], [ord(c) for c in ".,;:'\"()?-"]
STATISTICS = (
    "log_words", "mean_word", "upper", "digits", "symbols", "bars", "exclaims", "punctuation", "log_lines",
    "log_words_per_line", "dup_lines", "types", "repeated_triples", "log_longest", "short_words", "not_ascii", "at_signs", "capitals",
)


def statistics(text: str) -> list[float]:
    """The vector of one text; its order is ``STATISTICS``."""
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    words = text.split()
    n, size = len(words), int(raw.sum())
    seen = size - int(raw[9:14].sum()) - int(raw[32])
    lines = [x for x in _LINE.findall(text) if not x.isspace()]
    letters = int(raw[65:91].sum() + raw[97:123].sum())
    sizes = [len(w) for w in words]
    triples = max(n - 2, 0)
    of = lambda k, m: float(k) / m if m else 0.0
    return [
        np.log1p(n), of(seen, n), of(raw[65:91].sum(), letters), of(raw[48:58].sum(), seen), of(raw[_SYMBOLS].sum(), seen),
        of(raw[124], n), of(raw[33], n), of(raw[_PUNCTUATION].sum(), seen), np.log1p(len(lines)),
        np.log1p(of(n, len(lines))), of(len(lines) - len(set(lines)), len(lines)), of(len(set(words)), n) if n else 1.0,
        of(triples - len(set(zip(words, words[1:], words[2:], strict=False))), triples), np.log1p(max(sizes, default=0)),
        of(sum(k <= 3 for k in sizes), n), of(raw[128:].sum(), seen), of(raw[64], n), of(sum(w[0].isupper() for w in words), n),
    ]


def matrix(given: list[str]) -> np.ndarray:
    return np.array([statistics(t) for t in given], float).reshape(len(given), len(STATISTICS))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    steps: np.ndarray  # raw scores, rising
    values: np.ndarray  # their calibrated probabilities

    def features(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features of statistics (and a constant)."""
        rng = np.random.default_rng(SEED)
        w = rng.normal(0, 1 / (BANDWIDTH * np.sqrt(x.shape[1])), (x.shape[1], FEATURES))
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.features(x) @ self.weights if len(self.weights) else np.zeros(len(x))
        return np.interp(raw, self.steps, self.values)


def constant(p: float) -> Model:
    k = len(STATISTICS)
    return Model(np.zeros(k), np.ones(k), np.zeros(0), np.zeros(1), np.full(1, p))


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block middles and their values."""
    order = np.argsort(raw, kind="stable")
    blocks: list[list[float]] = []  # sum of labels, rows, sum of scores
    for x, y in zip(raw[order], label[order], strict=True):
        blocks.append([float(y), 1.0, float(x)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            y2, n2, x2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + x2]
    return np.array([x / n for _, n, x in blocks]), np.array([y / n for y, n, _ in blocks])


def solve(gram: np.ndarray, right: np.ndarray, n: float) -> np.ndarray:
    ridge = RIDGE * max(n, 1) * np.eye(len(gram)) / FEATURES
    ridge[-1, -1] = 1e-9
    return np.linalg.solve(gram + ridge, right)


def fit(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> Model:
    """Ridge and calibration from a bounded sample of labelled rows."""
    sample = labelled_sample(docs, labels, "quality", MODULUS, HELD_OUT, limit)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                x = matrix(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    kinds = "doc_id long, label int, x array<double>"
    vectors = written(sample.select("doc_id", "label", "text").mapInArrow(measure, kinds).coalesce(FIT_PARTS), "statistics")
    try:
        k = range(len(STATISTICS))
        x = [F.col("x")[i] for i in k]
        total = vectors.agg(F.count("*"), F.sum("label"), *map(F.avg, x), *map(F.stddev_pop, x)).first()
        n, positive = total[0], total[1] or 0
        if not n or positive in (0, n):
            return constant(positive / n if n else 0.5)
        mean, scale = np.array(total[2 : 2 + len(k)]), np.array(total[2 + len(k) :])
        model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(0), np.zeros(1), np.zeros(1))

        def rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids = batch.column("doc_id").to_numpy()
            z = model.features(np.array(batch.column("x").to_pylist(), float).reshape(len(ids), len(STATISTICS)))
            return ids // 7 % FOLDS, z, batch.column("label").to_numpy().astype(float)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            d = FEATURES + 1
            gram = np.zeros((FOLDS, d, d + 1))
            count = np.zeros(FOLDS)
            for batch in batches:
                fold, z, y = rows(batch)
                for f in range(FOLDS):
                    own = z[fold == f]
                    gram[f] += own.T @ np.hstack([own, y[fold == f, None]])
                    count[f] += len(own)
            yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS)), pa.array(count), pa.array([g.tobytes() for g in gram], pa.binary())], names=["fold", "n", "sums"])

        gram, count = np.zeros((FOLDS, FEATURES + 1, FEATURES + 2)), np.zeros(FOLDS)
        for r in vectors.mapInArrow(sums, "fold long, n double, sums binary").collect():  # FIT_PARTS x FOLDS rows at most
            gram[r["fold"]] += np.frombuffer(r["sums"]).reshape(gram[0].shape)
            count[r["fold"]] += r["n"]
        all_g, all_n = gram.sum(0), count.sum()
        left = [solve((all_g - g)[:, :-1], (all_g - g)[:, -1], all_n - c) for g, c in zip(gram, count, strict=True)]

        def out_of_fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fold, z, y = rows(batch)
                raw = (z * np.array(left)[fold]).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(raw), pa.array(y)], names=["raw", "y"])

        pairs = vectors.mapInArrow(out_of_fold, "raw double, y double").collect()  # the sample's rows
        pairs = np.array([tuple(r) for r in pairs])
        steps, values = isotonic(pairs[:, 0], pairs[:, 1])
        return Model(model.mean, model.scale, solve(all_g[:, :-1], all_g[:, -1], all_n), steps, values)
    finally:
        drop_written(sample)
        drop_written(vectors)


def scores(column: pa.Array, model: Model) -> np.ndarray:
    """Scores of a column of texts; null counts as empty."""
    return model.score(matrix([t or "" for t in column.to_pylist()]))


def score(df: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every text."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(part.column("text"), shared.value))], names=["doc_id", "score"])

    got = texts(df).mapInArrow(run, "doc_id long, score double")
    return got.select("doc_id", (remainder(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(df: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, with all their columns, whose text scores at least ``threshold``; no shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(scores(part.column("text"), shared.value) >= threshold))

    return df.mapInArrow(run, df.schema)
