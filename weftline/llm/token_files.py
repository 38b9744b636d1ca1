"""Token ids as directly addressable codes: random access to any token without decoding a block.

Each id is split into chunks of ``WIDTH`` bits, least significant first. Level k holds the k-th chunk of every id
that has one; a continuation bitmap says which of them go on to level k+1, and a rank directory (ones before every
``RANK`` bits) gives an id's place there: ``place = directory[i // RANK] + ones before i in its block``.

A segment is one file image: header, document table, then per level its chunks, bitmap and directory. Segments are
stored as rows of a Parquet table in the shared folder, so Spark's commit protocol keeps them whole when a task is
lost or run twice, on any store. Documents are dealt to ranges of doc_id, one per ``RANGE`` bytes of input, whose
bounds come from a scan of the ids alone, so texts are tokenised and shuffled once. An id that fills several ranges by
itself (null too) is cut by the hash of its texts, and a text that does so by the rows' numbers. Each range knows its
own running position; only the totals of the ranges (one number per partition) come to the driver.

Defined results: null and empty texts hold the end id alone; null ids come before all others; rows that share an id
follow one another by the hash of their texts, then by the ids, so that only equal texts may change places; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, texts, written
from weftline.llm.word_vocab import encode_texts

MAGIC, WIDTH, RANK = b"DAC1", 8, 512
SEGMENT = 256 * 1024
#: Bytes of input (as Spark estimates them, compressed for files) for each range.
RANGE = 32 << 20
#: Bytes of text encoded at once: the more, the fewer lookups of words that many texts share.
SLICE = 8 << 20
FILES = "range int, segment int, range_start long, n_ids long, image binary"


def encode_levels(ids: np.ndarray) -> bytes:
    """The levels of one run of unsigned ids."""
    out, left = [], ids.astype(np.uint64)
    while True:
        more = left >> np.uint64(WIDTH)
        go_on = more > 0
        bits = np.packbits(go_on, bitorder="little")
        step = RANK // 8
        padded = np.concatenate([bits, np.zeros(-len(bits) % step, np.uint8)]).reshape(-1, step)
        ones = np.bitwise_count(padded).sum(axis=1, dtype=np.uint32)
        directory = (np.cumsum(ones) - ones).astype("<u4")
        chunk = (left & np.uint64((1 << WIDTH) - 1)).astype(np.uint8)
        out.append(struct.pack("<QQQ", len(chunk), len(bits), len(directory)) + chunk.tobytes() + bits.tobytes() + directory.tobytes())
        left = more[go_on]
        if not len(left):
            return struct.pack("<I", len(out)) + b"".join(out)


def encode_segment(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """A file image: ids of consecutive documents, with their doc ids and lengths."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    head = MAGIC + struct.pack("<QQ", len(doc_ids), len(ids))
    return head + known.tobytes() + names.tobytes() + np.asarray(sizes, "<u4").tobytes() + encode_levels(ids)


class Segment:
    """A file image opened for reading; nothing is decoded but what is asked for."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a token file")
        n_docs, self.n_ids = struct.unpack_from("<QQ", image, 4)
        at = 20
        known = np.frombuffer(image, np.uint8, n_docs, at)
        names = np.frombuffer(image, "<i8", n_docs, at := at + n_docs)
        self.doc_ids = [int(d) if k else None for k, d in zip(known, names, strict=True)]
        self.sizes = np.frombuffer(image, "<u4", n_docs, at := at + 8 * n_docs).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        at += 4 * n_docs
        (n_levels,) = struct.unpack_from("<I", image, at)
        at += 4
        self.levels = []
        for _ in range(n_levels):
            n, b, d = struct.unpack_from("<QQQ", image, at)
            chunk = np.frombuffer(image, np.uint8, n, at := at + 24)
            bits = np.frombuffer(image, np.uint8, b, at := at + n)
            directory = np.frombuffer(image, "<u4", d, at := at + b)
            at += 4 * d
            self.levels.append((chunk, bits, directory))

    def rank(self, bits: np.ndarray, directory: np.ndarray, i: int) -> int:
        """Ones before bit ``i``: the directory and a part of one block."""
        first = i // RANK * (RANK // 8)
        ones = int(directory[i // RANK]) + int(np.bitwise_count(bits[first : i // 8]).sum())
        return ones + (int(bits[i // 8]) & ((1 << i % 8) - 1)).bit_count()

    def token(self, i: int) -> int:
        """The id at place ``i`` of the segment."""
        value = 0
        for level, (chunk, bits, directory) in enumerate(self.levels):
            value |= int(chunk[i]) << (WIDTH * level)
            if not bits[i // 8] >> (i % 8) & 1:
                break
            i = self.rank(bits, directory, i)
        return value

    def tokens(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """The ids from ``start`` to ``stop``: one range on each level, found by rank."""
        stop = self.n_ids if stop is None else stop
        value = np.zeros(stop - start, np.uint64)
        where = np.arange(stop - start)
        for level, (chunk, bits, directory) in enumerate(self.levels):
            if start >= stop:
                break
            value[where] |= chunk[start:stop].astype(np.uint64) << np.uint64(WIDTH * level)
            first = start // 8
            go_on = np.unpackbits(bits[first : (stop + 7) // 8], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            where = where[go_on]
            start = self.rank(bits, directory, start)
            stop = start + len(where)
        return value.astype(np.int64)

    def document(self, k: int) -> np.ndarray:
        return self.tokens(int(self.starts[k]), int(self.starts[k] + self.sizes[k]))


@dataclass
class Ranges:
    """Bounds of the ranges; they rise with (doc_id, hash of the text), null ids first."""

    edges: np.ndarray
    #: For each id that fills ranges by itself the bounds of its texts' hashes; equal bounds share rows by their number.
    inside: dict[int, np.ndarray]

    @cached_property
    def hot(self) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(sorted(self.inside), np.int64)
        return ids, np.cumsum([0, *(len(self.inside[i]) for i in ids.tolist())])

    def __len__(self) -> int:
        return len(self.edges) + 1 + int(self.hot[1][-1])

    def of(self, ids: np.ndarray, hashes: np.ndarray, first_row: int) -> np.ndarray:
        wide, more = self.hot
        out = np.searchsorted(self.edges, ids) + more[np.searchsorted(wide, ids)]
        for i in np.flatnonzero(np.isin(ids, wide)):
            bounds = self.inside[int(ids[i])]
            low, high = np.searchsorted(bounds, hashes[i]), np.searchsorted(bounds, hashes[i], side="right")
            out[i] += low + (first_row + i) % max(high - low, 1)
        return out.astype(np.int32)


#: Stands for a null id: sorts before all others.
NULL = -(1 << 63)


def ranges_of(docs: DataFrame, n: int) -> Ranges:
    """About ``n`` ranges of equally many rows; bounds come from one scan of the ids, and one of the hot ids' texts."""
    if n < 2:
        return Ranges(np.zeros(0, np.int64), {})
    key = F.coalesce("doc_id", F.lit(NULL))
    quantiles = lambda c, k: F.percentile_approx(c, [i / k for i in range(1, k)], max(10_000, 10 * k))
    bounds = Counter(docs.agg(quantiles(key, n)).first()[0] or [])
    hot = {b: m + 1 for b, m in bounds.items() if m > 1}
    inside = {}
    if hot:
        most = max(hot.values())
        found = docs.where(key.isin(list(hot))).groupBy(key.alias("k")).agg(quantiles(F.xxhash64("text"), most).alias("q"))
        for r in found.collect():  # bounded by the ranges
            m = hot[r["k"]]
            inside[r["k"]] = np.array([r["q"][round(i * most / m) - 1] for i in range(1, m)], np.int64)
    return Ranges(np.array(sorted(bounds), np.int64), inside)


def tokenized(docs: DataFrame, ranges: Ranges, path: str, end_id: int) -> DataFrame:
    """range, doc_id, hash, and ids as bytes (16 bits each if the vocabulary allows)."""
    shared = docs.sparkSession.sparkContext.broadcast(ranges)  # two numbers a range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = 0
        for batch in batches:
            for part in slices(batch, SLICE):
                flat, n = encode_texts(part.column("text"), path, end_id)
                wide = 2 if not len(flat) or flat.max() < 1 << 16 else 4
                end = np.concatenate([[0], np.cumsum(n) * wide]).astype(np.int32)
                image = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(end), pa.py_buffer(flat.astype(f"<u{wide}"))])
                ids, hashes = part.column("doc_id").fill_null(NULL).to_numpy(), part.column("hash").to_numpy()
                where = shared.value.of(ids, hashes, row)
                row += len(n)
                yield pa.RecordBatch.from_arrays([pa.array(where), part.column("doc_id"), part.column("hash"), pa.array(np.full(len(n), wide, np.int32)), image], names=["range", "doc_id", "hash", "wide", "ids"])

    return docs.withColumn("hash", F.xxhash64("text")).mapInArrow(run, "range int, doc_id long, hash long, wide int, ids binary")


def write_token_files(df: DataFrame, path: str, end_id: int = 1, ranges: int | None = None, segment: int = SEGMENT, to: str | None = None) -> DataFrame:
    """Writes the ids of all texts in ascending doc_id order; returns the table of segments.

    With ``to`` the files stay there; else they lie in the shared folder until Spark ends.
    """
    spark = df.sparkSession
    docs = texts(df)
    if ranges is None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size >= 1 << 60:  # not known without reading
            size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    dealt = ranges_of(docs, ranges)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, parts, held, at, count, key = [], [], 0, 0, 0, None

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal docs, parts, held, at, count
            if docs:
                ids = np.concatenate(parts)
                image = encode_segment(docs, np.array([len(p) for p in parts]), ids)
                row = [pa.array([v], t) for v, t in ((key, pa.int32()), (count, pa.int32()), (at, pa.int64()), (len(ids), pa.int64()), (image, pa.binary()))]
                yield pa.RecordBatch.from_arrays(row, names=["range", "segment", "range_start", "n_ids", "image"])
                at, count = at + held, count + 1
            docs, parts, held = [], [], 0

        for batch in batches:
            for part in slices(batch, column="ids"):
                for r, doc, wide, raw in zip(*(part.column(c).to_pylist() for c in ("range", "doc_id", "wide", "ids")), strict=True):
                    if r != key:
                        yield from out()
                        key, at, count = r, 0, 0
                    docs.append(doc)
                    parts.append(np.frombuffer(raw, f"<u{wide}").astype(np.uint32))
                    held += len(parts[-1])
                    if held >= segment:
                        yield from out()
        yield from out()

    # a partition for each range
    coded = tokenized(docs, dealt, path, end_id).repartitionById(len(dealt), F.col("range")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "hash", "ids")
    return written(coded.select("range", "doc_id", "wide", "ids").mapInArrow(encode, FILES), "tokens", to)


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start over all files, its ids' number and crc32."""
    spark = files.sparkSession
    totals = sorted((r["range"], r["n"]) for r in files.groupBy("range").agg(F.sum("n_ids").alias("n")).collect())
    base = dict(zip((r for r, _ in totals), accumulate([0, *(n for _, n in totals)]), strict=False))
    base = spark.sparkContext.broadcast(base)  # one number per range

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, first, image in zip(*(batch.column(c).to_pylist() for c in ("range", "range_start", "image")), strict=True):
                seg = Segment(image)
                ids = seg.tokens().astype("<u4")
                crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(seg.starts, seg.sizes, strict=True)]
                cols = [seg.doc_ids, seg.starts + (first + base.value[r]), seg.sizes, crc]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("range", "range_start", "image").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
