"""Token counts by byte-pair merging on a heap and a linked list; no identifiers are made.

A pre-token's symbols stand in a doubly linked list. A heap holds the adjacent pairs by merge rank and place; the
lowest is popped, stale entries are skipped, and its two symbols become one. The count is the number of initial
symbols minus the merges. Pre-tokens repeat, so a bounded cache keeps their counts.

Defined results: null and empty texts count 0; special strings inside a text count one token each, as the library
does by default; a null id stays null; repeated rows each give a row; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from weftline.llm.common import ChunkCache, slices, texts
from weftline.llm.word_vocab import RAW, signed_pretokens, signs, spec, split

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


@cache
def merges(path: str) -> dict[tuple[str, str], int]:
    """Rank of each pair of symbols."""
    listed = spec(path)["model"]["merges"]
    return {tuple(m.split(" ")) if isinstance(m, str) else tuple(m): i for i, m in enumerate(listed)}


def merged_count(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when the lowest-ranked adjacent pair, leftmost first, is merged until none is known."""
    n = len(symbols)
    sym = list(symbols)
    after, before = [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := ranks.get((sym[i], sym[i + 1]))) is not None]
    heapq.heapify(heap)
    done = 0
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i]
        if j < 0 or sym[i] != left or sym[j] != right:
            continue
        new = left + right
        sym[i], sym[j] = new, ""
        k, h = after[j], before[i]
        after[i], after[j] = k, -1
        done += 1
        if k >= 0:
            before[k] = i
            if (r := ranks.get((new, sym[k]))) is not None:
                heapq.heappush(heap, (r, i, new, sym[k]))
        if h >= 0 and (r := ranks.get((sym[h], new))) is not None:
            heapq.heappush(heap, (r, h, sym[h], new))
    return n - done


def counter(path: str):
    """Counts of unseen pre-tokens (and raw chunks) as id lists of that length without content."""
    ranks, suffix = merges(path), spec(path)["model"]["end_of_word_suffix"]
    special = re.compile("|".join(re.escape(t["content"]) for t in spec(path)["added_tokens"]))

    def one(signed: str) -> int:
        symbols = list(signed)
        symbols[-1] += suffix
        return merged_count(symbols, ranks)

    def count(piece: str) -> int:
        if piece[0] != RAW:
            return one(signs(piece))
        parts = special.split(piece[1:])
        return len(parts) - 1 + sum(one(p) for part in parts for p in signed_pretokens(path, part))

    return lambda unseen: [count(p) for p in unseen]


class CountCache(ChunkCache):
    """Keeps a count for each pre-token instead of its ids."""

    def _add(self, names: list[str], ids: list) -> None:
        base = len(self.code)
        self.size = np.concatenate([self.size, np.array([getattr(x, "size", x) for x in ids], np.int64)])
        self.start = np.zeros(len(self.size), np.int64)
        self.seen = np.concatenate([self.seen, np.zeros(len(ids), np.int64)])
        self.signs += sum(map(len, names))
        self.code.update(zip(names, range(base, base + len(names)), strict=True))

    def _shrink(self) -> None:
        names, keep = list(self.code), np.flatnonzero(self.seen > 1)
        keep = keep[np.argsort(-self.seen[keep], kind="stable")[: self.limit // 2]]
        heavy = np.cumsum([len(names[k]) for k in keep])
        keep = keep[: np.searchsorted(heavy, self.weight // 2, side="right")]
        counts, seen = [int(self.size[k]) for k in keep], self.seen[keep] // 2
        self._reset()
        self._add([names[k] for k in keep], counts)
        self.seen = seen


@cache
def count_cache(path: str) -> CountCache:
    """One per Python worker."""
    return CountCache(split, counter(path))


def count_tokens(df: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """Bytes and tokens of every whole text, and whether it is over ``limit`` tokens."""
    kind = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                text = part.column("text")
                n = count_cache(path).counts(text.to_pylist())
                size = pc.cast(pc.binary_length(text), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], schema=kind)

    return texts(df).mapInArrow(run, SCHEMA)
