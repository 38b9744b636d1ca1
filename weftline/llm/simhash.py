"""SimHash near-duplicates: fingerprints linked by vantage-point trees, then connected components.

Fingerprints are made map-only and reduced to distinct values with their smallest id, so copies cost nothing more.
Two fingerprints at ``radius`` bits or fewer differ by one bit at most in one of ``radius // 2 + 1`` runs of their
bits. For each run, a vantage-point tree with fixed vantage points deals fingerprints to shards: on each level the
child is the Hamming distance to the vantage point. By the triangle bound a partner lies in a child whose distance
differs by no more than one, on all levels together as the change of some single bit gives; so a fingerprint is stored
in its own leaf and queried in those boundary-overlapping leaves, no pair is lost, and copies stay below one per bit
and run whatever the depth. The depth grows with the logarithm of the number of fingerprints, so that the fullest leaf
of an even tree stays at a shard's size with its queries counted. Inside a shard a further
vantage-point tree over all 64 bits prunes by the same bound, and exact distances decide.

A leaf of more than ``HOT`` shard sizes (near copies fall together) is cut into blocks, stored ones against queries,
so that no task holds more than two shards' worth. A shard joins its own pairs into stars at once (at most one row
per fingerprint and shard), so a dense group never becomes all its pairs. Alternating large-star and small-star rounds
over written tables then find the components. Joins on fingerprints, roots and centres of stars take the few keys that
hold over one in ``SPREAD`` of the rows by broadcast, so that no task gets more than that share.

Defined results: null and empty texts have fingerprint zero and link like any other; a null id never names a
component unless its group holds no other id, and its row stays; repeated rows each give a row; an empty table gives
an empty table; further columns are ignored. ``representatives`` keeps all columns and, of each component, the row of
smallest id (null last), of those the one with the smallest hash of all its columns; rows equal in all columns are
interchangeable, and different texts that share an id are judged apart.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import drop_since, drop_written, mark_written, slices, texts, written

WORDS, RADIUS, SHARD, HOT, SPREAD = 4, 4, 32_768, 2, 200
#: Copies that the fullest leaf of a tree takes, as a share of the fingerprints: this times ``NARROWS`` for each level
#: (distances to a vantage point crowd in the middle, and each level adds boundary-overlapping leaves to a query).
FULLEST, NARROWS, ONE_LEAF, LEAST_LEVELS = 0.88, 0.53, 4096, 3
#: Rows that a dropped row's key or a hot leaf may take in a broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 500_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
_HASH = xxhash.xxh64_intdigest
_BRUTE = 1 << 20


def lowered(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_LOWER)


def fingerprint(text: str, words: int = WORDS) -> int:
    """Bit by bit, whether over half of the shingles' hashes have it set; zero without words."""
    w = _WORD.findall(lowered(text))
    if not w:
        return 0
    n = max(len(w) - words + 1, 1)
    if n == 1:
        shingles = [" ".join(w)]
    else:
        shingles = map(" ".join, zip(*(w[i:] for i in range(words)), strict=False))
    h = np.fromiter((_HASH(s.encode("utf-8", "surrogatepass"), 42) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, kept: str = "doc_id long") -> DataFrame:
    """Columns to keep (with their types) and the fingerprint of ``text`` as a signed 64-bit number."""
    names = [c.split()[0] for c in kept.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = np.array([fingerprint(t) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(made.view(np.int64))], names=[*names, "fp"])

    return df.mapInArrow(run, f"{kept}, fp long")


def runs(radius: int = RADIUS) -> list[tuple[int, int]]:
    """First bit and number of bits of each run: as many runs as leave one differing bit at most in one of them."""
    parts = radius // 2 + 1
    edge = [round(64 * i / parts) for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edge, edge[1:], strict=False)]


def vantage_points(levels: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, size=(levels, 2), dtype=np.uint64) @ np.array([2, 1], np.uint64)


def leaves(fp: np.ndarray, levels: int, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint (by place): its own leaf in each run's tree, and those that a partner in this run may own.

    Returns places, leaves and whether the leaf is the fingerprint's own. A bit that differs moves the distance to each
    vantage point up or down by one, as the point agrees there or not.
    """
    place, leaf, own = [], [], []
    weight = 65 ** np.arange(levels - 1, -1, -1, dtype=np.int64)
    for t, (shift, n) in enumerate(runs(radius)):
        mask = np.uint64((1 << n) - 1)
        bits, points = (fp >> np.uint64(shift)) & mask, vantage_points(levels) & mask
        home = np.full(len(fp), t * 65**levels, np.int64)
        for v, w in zip(points, weight, strict=True):
            home += np.bitwise_count(bits ^ v).astype(np.int64) * w
        place.append(np.arange(len(fp)))
        leaf.append(home)
        own.append(np.ones(len(fp), bool))
        if radius and levels:
            at = np.arange(n, dtype=np.uint64)
            agrees = [(((bits ^ v)[:, None] >> at) & np.uint64(1)) == 0 for v in points]
            near = home[:, None] + sum(np.where(a, w, -w) for a, w in zip(agrees, weight, strict=True))
            near.sort(axis=1)
            first = np.concatenate([np.ones((len(fp), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
            row, col = np.nonzero(first)
            place.append(row)
            leaf.append(near[row, col])
            own.append(np.zeros(len(row), bool))
    return np.concatenate(place), np.concatenate(leaf), np.concatenate(own)


def near_pairs(points: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of points and queries at ``radius`` or fewer bits: a vantage-point tree over all bits, pruned by the triangle bound."""
    todo = [(np.arange(len(points)), np.arange(len(queries)), 0)]
    while todo:
        p, q, depth = todo.pop()
        if not len(p) or not len(q):
            continue
        if len(p) * len(q) <= _BRUTE or depth == 8:
            step = max(1, _BRUTE // len(p))
            for at in range(0, len(q), step):
                some = q[at : at + step]
                i, j = np.nonzero(np.bitwise_count(points[p][:, None] ^ queries[some][None, :]) <= radius)
                if len(i):
                    yield p[i], some[j]
            continue
        v = points[p[depth * 7919 % len(p)]]
        dp, dq = np.bitwise_count(points[p] ^ v), np.bitwise_count(queries[q] ^ v).astype(int)
        for r in np.unique(dp):
            todo.append((p[dp == r], q[np.abs(dq - int(r)) <= radius], depth + 1))


class Forest:
    """Union by smallest place."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins many pairs: roots hook to smaller roots until nothing changes."""
        while True:
            ra, rb = self.roots(a), self.roots(b)
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while (s := self.up[r]).tolist() != r.tolist():
            r = s
        self.up[x] = r
        return r


def levels_for(n: int, shard: int = SHARD) -> int:
    """Levels at which the fullest leaf of ``n`` fingerprints holds about ``shard`` rows, those of queries included."""
    if n <= min(shard, ONE_LEAF):
        return 0
    return min(10, max(LEAST_LEVELS, math.ceil(math.log(FULLEST * n / shard) / -math.log(NARROWS))))


def links(distinct: DataFrame, n: int, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Links between fingerprints (a, b), a star per component and shard; their closure is that of all near pairs."""
    levels = levels_for(n, shard)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fp), 1 << 13):
                some = fp[at : at + (1 << 13)]
                place, leaf, own = leaves(some, levels, radius)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(some[place].view(np.int64)), pa.array(own)], names=["leaf", "fp", "own"])

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp, stored, asks = pdf["fp"].to_numpy().view(np.uint64), pdf["stored"].to_numpy(), pdf["asks"].to_numpy()
        every, place = np.unique(fp, return_inverse=True)
        forest = Forest(len(every))
        for i, j in near_pairs(fp[stored], fp[asks], radius):
            forest.join(place[stored][i], place[asks][j])
        root = forest.roots(np.arange(len(every)))
        hit = np.flatnonzero(root != np.arange(len(every)))
        return pd.DataFrame({"a": every[root[hit]].view(np.int64), "b": every[hit].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "leaf long, fp long, own boolean")
    sizes = dealt.groupBy("leaf").count().where(F.col("count") > HOT * shard)
    hot = written(sizes.select("leaf", F.ceil(F.col("count") / shard).cast("int").alias("m")), "hot")
    n_hot = hot.count()
    yes, no = F.lit(True), F.lit(False)
    whole = dealt.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "leaf", "left_anti") if n_hot else dealt
    blocks = whole.select("leaf", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", F.col("own").alias("stored"), yes.alias("asks"))
    if n_hot:
        cut = dealt.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, "leaf").withColumn("k", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("m") - 1))
        blocks = blocks.unionByName(cut.where("own").select("leaf", F.col("k").alias("i"), every.alias("j"), "fp", yes.alias("stored"), no.alias("asks")))
        blocks = blocks.unionByName(cut.select("leaf", every.alias("i"), F.col("k").alias("j"), "fp", no.alias("stored"), yes.alias("asks")))
    return blocks.groupBy("leaf", "i", "j").applyInPandas(search, "a long, b long")


def by_key(left: DataFrame, right: DataFrame, key: str, total: int, alone: int = 0) -> DataFrame:
    """``left`` joined with ``right``, which has a row per key and in ``n`` the rows of ``left`` with it.

    Keys with over one in ``SPREAD`` of ``total`` rows are ``SPREAD`` at most and go by broadcast, unless ``total``
    is no more than what one task may hold ``alone``.
    """
    if total <= alone:
        return left.join(right, key).drop("n")
    hot = F.broadcast(right.where(F.col("n") * SPREAD > total))
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(F.col("n") * SPREAD <= total), key)
    return left.join(hot, key).unionByName(rest).drop("n")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge: alternating large-star and small-star until the stars stay the same."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    summed = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    digest = summed(now)
    n = F.count("*").alias("n")
    for _ in range(rounds):
        # large star: every greater neighbour of a node goes to the node's smallest neighbour
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), n).select("u", F.least("u", "m").alias("m"), "n")
        large = by_key(both, least, "u", 2 * digest[0], HOT * SHARD).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # written, else the plan of a round holds this one's for each use below
        large = written(large, "large")
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), n)
        small = by_key(large, least, "u", 2 * digest[0], HOT * SHARD)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = written(small.where("u <> v").distinct(), "stars")
        drop_written(large)
        drop_written(now)
        before, now, digest = digest, new, summed(new)
        if before == digest:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError("the components did not settle")


def rooted(docs: DataFrame, radius: int = RADIUS) -> tuple[DataFrame, int]:
    """For each fingerprint of a written table: its rows n, the smallest id and the fingerprint that names its component."""
    distinct = written(docs.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    star = components(links(distinct, distinct.count(), radius))
    of = distinct.join(star.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
    total = distinct.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return written(of, "rooted"), total


def near_duplicates(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id that links reach) for every row of ``df``."""
    docs = written(fingerprints(texts(df)), "fingerprints")
    mark = mark_written()
    of, total = rooted(docs, radius)
    named = of.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    copies = of.select("root", "fp", F.col("n").alias("copies"))
    classes = written(by_key(copies, named, "root", of.count()).select("fp", "component_id", F.col("copies").alias("n")), "classes")
    drop_since(mark, classes)
    return by_key(docs, classes, "fp", total).select("doc_id", "fp", "component_id")


def representatives(df: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all columns of ``df``; texts are read twice and not shuffled.

    Rows are known by file and place. Keys of dropped rows are broadcast up to ``BROADCAST_ROWS``; beyond it the join
    shuffles.
    """
    mark = mark_written()
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = written(df, "rows")
        mark = mark_written()
    meta = df.metadataColumn("_metadata")
    file, row = F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("row")
    plain = [df[c] for c, kind in df.dtypes if "map<" not in kind]
    told = df.select(df["doc_id"].cast("long").alias("doc_id"), F.coalesce(df["text"].cast("string"), F.lit("")).alias("text"), file, row, F.xxhash64(*plain).alias("hash"))
    docs = written(fingerprints(told, "doc_id long, file long, row long, hash long"), "fingerprints")
    of, total = rooted(docs, radius)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "file", "row")
    rows = by_key(docs, of.select("fp", "n", "root"), "fp", total).select("root", order.alias("at"))
    best = rows.groupBy("root").agg(F.min("at").alias("best"), F.count("*").alias("n"))
    away = written(by_key(rows, best, "root", total).where(F.col("at") != F.col("best")).select("at.file", "at.row"), "away")
    drop_since(mark, away)
    n_away = away.count()
    kept = df.select(F.struct(*[df[c] for c in df.columns]).alias("kept"), file, row)
    kept = kept.join(F.broadcast(away) if n_away <= BROADCAST_ROWS else away, ["file", "row"], "left_anti")
    return kept.select("kept.*")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
