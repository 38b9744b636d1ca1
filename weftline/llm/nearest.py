"""Nearest neighbours by multiprobe p-stable hashing.

Each table has p-stable functions floor((a.x + b) / width) over vectors brought to equal length (largest inner product
then means least distance); their number grows with the logarithm of the rows, so that a bucket holds about ``BUCKET``
rows at any size. A neighbour with inner product s to a query falls in a slot with a probability known from the normal
law, and a bucket's estimated success is the product over its slots. A query visits the perturbed buckets in falling
order of estimated success until the visited share reaches the target; how far that is (a bound on the success) is
found per query from simulated neighbours, so that every shard of the index can tell by itself which of its buckets are
visited. Products are taken with rows of visited buckets only; the tables' candidates are merged and ranked by the
exact inner product of the original vectors.

Index rows are dealt by table, leading slots (as many as make shards of ``shard`` rows) and, where a bucket is larger than a
shard, a salt; a query goes to the shards whose leading slots can still reach its bound, found by extending slot
prefixes and leaving those that cannot. Shards pass on at most k candidates per query, none below the (SPARE * k)-th
best score within the sample, as so many better ones are there to be found. A query that still ends with fewer than k
visits every bucket in a second round. The inner product s of the k-th neighbour comes from a bounded sample; every row
is indexed. The driver sees the shards' counts only; their size rises with the rows up to a bound.

Defined results: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows with a
null id; of rows that share an id the least vector counts; vectors of another length have no inner product with a query
and are searched among their own; equal scores go to the smaller id; fewer candidates give fewer rows; a query's own id
is never its candidate; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.llm.common import drop_since, drop_written, mark_written, written

K, QUERY_STEP, TABLES, WIDTH, TARGET, SAMPLE, TRIES = 20, 20, 2, 1.5, 0.97, 20_000, 256
#: Rows of a bucket on average, and of a shard at least and at most; in between a 128th of the rows.
BUCKET, SHARDS = 48, (8192, 65_536)
#: Slots that a function mostly uses at this width: the base of the number of buckets.
SLOTS = 3.2
#: Shards leave out what is below the (SPARE * k)-th score of the sample.
SPARE = 3
#: Slots beyond this many widths from the centre are joined to the last one.
EDGE = 3
SPAN = 2 * EDGE + 1
#: Rounding of sums of logs.
SLACK = 1e-9
FOUND = "query_id long, vec_id long, score double"
_GRID = np.linspace(-9, 9, 18_001)
_CDF = np.vectorize(NormalDist().cdf, otypes=[float])(_GRID)


def cdf(x: np.ndarray) -> np.ndarray:
    return np.interp(x, _GRID, _CDF)


@dataclass
class Index:
    """The hash functions and what the sample told."""

    size: int
    longest: float
    #: Inner product of a query with its k-th neighbour, both at length 1.
    inner: float
    hashes: int
    #: Leading slots that name a shard.
    first: int
    shard: int
    tables: int = TABLES
    width: float = WIDTH
    target: float = TARGET
    #: The sample's vectors and ids: the k-th best of them is below the k-th best of all.
    known: np.ndarray | None = None
    known_ids: np.ndarray | None = None

    def least(self, q: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
        """Per query a score that ``SPARE * k`` rows reach for certain; minus infinity if the sample is too small."""
        k *= SPARE
        if len(self.known_ids) <= k:
            return np.full(len(q), -np.inf)
        scores = q.astype(np.float32) @ self.known.T
        scores[own[:, None] == self.known_ids[None, :]] = -np.inf
        slack = 1e-4 * np.linalg.norm(q, axis=1) * self.longest
        return np.partition(scores, len(self.known_ids) - k, axis=1)[:, len(self.known_ids) - k] - slack

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(5)
        return rng.normal(size=(self.tables, self.size + 1, self.hashes)), rng.uniform(0, self.width, (self.tables, self.hashes))

    @cached_property
    def steps(self) -> np.ndarray:
        """What a neighbour's values have beside the query's: simulated, for all functions of a table."""
        return np.random.default_rng(6).normal(size=(TRIES, self.hashes)) * math.sqrt(1 - self.inner**2)

    def raised(self, x: np.ndarray) -> np.ndarray:
        """Stored vectors at equal length 1: scaled by the longest, with one more component."""
        x = x / self.longest
        return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))])

    def asked(self, q: np.ndarray) -> np.ndarray:
        return np.hstack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros((len(q), 1))])

    def slots(self, values: np.ndarray, t: int) -> np.ndarray:
        """Slot of each value, from 0."""
        return (np.clip(np.floor((values + self.lines[1][t]) / self.width), -EDGE, EDGE) + EDGE).astype(np.int64)

    def stored(self, x: np.ndarray, t: int) -> np.ndarray:
        return self.slots(self.raised(x) @ self.lines[0][t], t)

    def logs(self, values: np.ndarray, t: int) -> np.ndarray:
        """Log probability, per query, function and slot, that a neighbour lies there."""
        edge = (np.arange(-EDGE, EDGE) + 1.0) * self.width
        c = cdf((edge[None, None, :] - (self.inner * values + self.lines[1][t])[:, :, None]) / math.sqrt(1 - self.inner**2))
        p = np.diff(np.concatenate([np.zeros((*c.shape[:2], 1)), c, np.ones((*c.shape[:2], 1))], axis=2), axis=2)
        return np.log(np.maximum(p, 1e-12))

    def bounds(self, values: np.ndarray, logs: np.ndarray, t: int) -> np.ndarray:
        """Per query the least log success of a visited bucket, so that one table finds its share of the target."""
        share = 1 - (1 - self.target) ** (1 / self.tables)
        out = np.empty(len(values))
        line = np.arange(self.hashes)
        for i in range(len(values)):
            hit = self.slots(self.inner * values[i] + self.steps, t)
            out[i] = np.quantile(logs[i][line, hit].sum(1), 1 - share, method="lower")
        return out

    def prefixes(self, logs: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries (by place) and codes of leading slots with which some bucket reaches the bound."""
        best = np.cumsum(logs.max(2)[:, ::-1], axis=1)[:, ::-1]  # what the slots from here on can add
        best = np.concatenate([best, np.zeros((len(logs), 1))], axis=1)
        q, code, so_far = np.arange(len(logs)), np.zeros(len(logs), np.int64), np.zeros(len(logs))
        for i in range(self.first):
            reach = so_far[:, None] + logs[q, i]
            at, slot = np.nonzero(reach + best[q, i + 1][:, None] >= bound[q][:, None] - SLACK)
            q, code, so_far = q[at], code[at] * SPAN + slot, reach[at, slot]
        return q, code


def valid(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector of the rows that take part."""
    got = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    return got.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)


def vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def packed(x: np.ndarray) -> pa.Array:
    """Vectors as bytes."""
    x = np.ascontiguousarray(x, "<f8")
    ends = np.arange(len(x) + 1, dtype=np.int32) * 8 * x.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def unpacked(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<f8").reshape(len(column), -1)


def fit(rows: DataFrame, n: int, size: int, k: int = K, **settings) -> Index:
    """Longest norm and the nearness of a k-th neighbour, from a sample chosen by a hash of the id."""
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()  # SAMPLE rows at most
    longest = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]
    x = np.stack(sample["v"].to_list())
    shard = settings.pop("shard", min(max(n // 128, SHARDS[0]), SHARDS[1]))
    hashes = max(2, round(math.log(max(n / BUCKET, 1), SLOTS)))
    first = max(0, min(hashes, round(math.log(max(n / shard, 1), SLOTS))))
    index = Index(size, math.sqrt(longest), 0.0, hashes, first, shard, known=x.astype(np.float32), known_ids=sample["vec_id"].to_numpy())
    some = x[: max(1, min(200, len(x)))]
    near = np.sort(index.asked(some) @ index.raised(x).T, axis=1)[:, ::-1][:, 1:]
    rank = min(max(0, math.ceil(k * len(x) / max(n, 1)) - 1), max(0, near.shape[1] - 1))
    inner = float(np.quantile(near[:, rank], 0.25)) if near.shape[1] else 0.0
    index.inner = min(max(inner, 0.0), 0.9999)
    for name, value in settings.items():
        setattr(index, name, value)
    return index


def best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best, ties to smaller ids."""
    order = np.lexsort((ids, -score, query))
    of = query[order]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    return order[rank < k]


def visited(ix: Index, t: int, x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, bound: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries, places of rows and exact scores: the k best rows of the buckets that each query visits."""
    bucket, of = np.unique(ix.stored(x, t), axis=0, return_inverse=True)
    by_bucket = np.argsort(of.reshape(-1), kind="stable")
    x, edge = x[by_bucket], np.searchsorted(of.reshape(-1)[by_bucket], np.arange(len(bucket) + 1))
    logs = ix.logs(ix.asked(q) @ ix.lines[0][t], t)
    success = sum((logs[:, i, :][:, bucket[:, i]] for i in range(1, ix.hashes)), logs[:, 0, :][:, bucket[:, 0]])
    goes = success >= bound[:, None] - SLACK
    rough = np.full((len(q), len(x)), -np.inf)
    for b in np.flatnonzero(goes.any(0)):
        some = np.flatnonzero(goes[:, b])
        rough[some, edge[b] : edge[b + 1]] = q[some] @ x[edge[b] : edge[b + 1]].T
    rough[own[:, None] == ids[by_bucket][None, :]] = -np.inf
    hit = rough >= np.maximum(least, -1e300)[:, None]
    if len(x) > k:  # only the best of many go on
        many = np.flatnonzero(hit.sum(1) > 2 * k)
        kth = np.partition(rough[many], len(x) - k, axis=1)[:, len(x) - k]
        hit[many] &= rough[many] >= (kth - 1e-9 * np.maximum(1.0, np.abs(kth)))[:, None]
    j, r = np.nonzero(hit)
    exact = np.concatenate([np.zeros(0), *[(x[r[a : a + 8192]] * q[j[a : a + 8192]]).sum(1) for a in range(0, len(j), 8192)]])
    keep = best_of(j, ids[by_bucket][r], exact, k)
    return j[keep], by_bucket[r[keep]], exact[keep]


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_step: int = QUERY_STEP, **settings) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row whose id is divisible by ``query_step``."""
    rows = valid(df, id_col, vector_col)
    n, distinct = rows.agg(F.count("*"), F.count_distinct("vec_id")).first()
    if n > distinct:
        rows = written(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    sizes = sorted((r["size"], r["count"]) for r in rows.groupBy(F.size("v").alias("size")).count().collect())
    if not sizes:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = [_search(rows.where(F.size("v") == size) if len(sizes) > 1 else rows, m, size, k, query_step, settings) for size, m in sizes]
    if n > distinct:
        drop_written(rows)
    return reduce(DataFrame.unionByName, parts)


def _search(rows: DataFrame, n: int, size: int, k: int, query_step: int, settings: dict) -> DataFrame:
    """The search among ``n`` vectors of one length."""
    spark = rows.sparkSession
    index = fit(rows, n, size, k, **settings)
    shared = spark.sparkContext.broadcast(index)  # the sample and a few functions

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            x = vectors(batch.column("v"))
            for t in range(ix.tables):
                code = np.full(len(x), t, np.int64)
                for c in ix.stored(x, t)[:, : ix.first].T:
                    code = code * SPAN + c
                yield pa.RecordBatch.from_arrays([pa.array(code), batch.column("vec_id"), packed(x)], names=["shard", "vec_id", "v"])

    stored = rows.mapInArrow(home, "shard long, vec_id long, v binary")
    counts = sorted((r["shard"], -(-r["count"] // index.shard)) for r in stored.groupBy("shard").count().collect())
    salts = spark.sparkContext.broadcast(np.array(counts, np.int64))  # two numbers a shard

    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in home(batches):
            shard, ids = batch.column("shard").to_numpy(), batch.column("vec_id").to_numpy()
            m = salts.value[np.searchsorted(salts.value[:, 0], shard), 1]
            part = (ids.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % m
            yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(part), batch.column("vec_id"), batch.column("v")], names=["shard", "part", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch], everywhere: bool = False) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        codes, m = salts.value.T
        for batch in batches:
            whole, whole_ids = vectors(batch.column("v")), batch.column("vec_id").to_numpy()
            for at in range(0, len(whole), 256):
                raw, ids = whole[at : at + 256], whole_ids[at : at + 256]
                least = np.full(len(raw), -np.inf) if everywhere else ix.least(raw, ids, k)
                x = ix.asked(raw)
                for t in range(1 if everywhere else ix.tables):
                    values = x @ ix.lines[0][t]
                    logs = ix.logs(values, t)
                    bound = np.full(len(x), -np.inf) if everywhere else ix.bounds(values, logs, t)
                    q, code = ix.prefixes(logs, bound)
                    code += t * SPAN**ix.first
                    spot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    there = codes[spot] == code
                    q, spot = q[there], spot[there]
                    part = np.concatenate([np.zeros(0, np.int64), *[np.arange(c) for c in m[spot]]]).astype(np.int64)
                    q, shard = np.repeat(q, m[spot]), np.repeat(codes[spot], m[spot])
                    for a in range(0, len(q), 8192):
                        s = slice(a, a + 8192)
                        yield pa.RecordBatch.from_arrays(
                            [*map(pa.array, (shard[s], part[s], ids[q[s]], bound[q[s]], least[q[s]])), packed(raw[q[s]])], names=["shard", "part", "query_id", "bound", "least", "v"]
                        )

    def visit(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ix, out = shared.value, []
        if len(left) and len(right):
            x, ids = unpacked(left["v"]), left["vec_id"].to_numpy()
            step = max(16, (4 << 20) // len(x))
            for at in range(0, len(right), step):
                some = right.iloc[at : at + step]
                own = some["query_id"].to_numpy()
                j, r, score = visited(ix, int(key[0]) // SPAN**ix.first, x, ids, unpacked(some["v"]), own, some["bound"].to_numpy(), some["least"].to_numpy(), k)
                out.append(pd.DataFrame({"query_id": own[j], "vec_id": ids[r], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    dealt = rows.mapInArrow(salted, "shard long, part long, vec_id long, v binary")
    queries = rows.where(F.col("vec_id") % query_step == 0)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def answered(some: DataFrame, how) -> DataFrame:
        asked = some.mapInArrow(how, "shard long, part long, query_id long, bound double, least double, v binary")
        found = dealt.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(visit, FOUND)
        return written(ranked(found.dropDuplicates(["query_id", "vec_id"])), "nearest")

    mark = mark_written()
    got = answered(queries, probe)
    full = got.where(F.col("rank") == min(k, n - 1)).select(F.col("query_id").alias("vec_id"))
    short = queries.join(full, "vec_id", "left_anti")
    if n > 1 and not short.isEmpty():
        more = answered(short, lambda batches: probe(batches, True))
        got = written(ranked(got.join(more.select("query_id").distinct(), "query_id", "left_anti").unionByName(more)), "nearest")
        drop_since(mark, got)
    return got
