"""Packing of token sequences: Karmarkar-Karp differencing into near-equal windows.

Documents become ids by the word-end vocabulary, each closed by an end id. Within a Spark partition, blocks of
about ``block`` tokens are packed: whole windows are cut off long documents, a few of the longest remainders are
held back as filler, multiway differencing spreads the others over the smallest window count that can hold the
block (one window more whenever a window exceeds the capacity), and the filler is cut into the gaps. What does not
fill a window goes on to the next block, so a partition pads one window at most. No shuffle, bounded memory; a lost
task is simply run again.

Defined results: null text counts as empty (the end id alone is packed); a null id stays null; repeated rows are
packed each for itself; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftline.llm.common import slices, texts
from weftline.llm.word_vocab import encode_texts

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CAPACITY = 2048
BLOCK = 512 * 1024
#: Share of a block's remainders that is held back to fill gaps.
FILLER = 0.03


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Multiway differencing: items (by index) in ``k`` windows of near-equal sums.

    The two partial partitions of largest spread are merged, the fullest window of one with the emptiest of the other,
    until one is left. Items of one size are a partial partition with a window each; if they are more than ``k``, they
    wait as a group: as long as a partial partition's spread is larger, it takes them one by one into its emptiest
    window; once the group leads, each ``k`` of its items level all windows and the rest are a partial partition. Partial partitions hold their used windows only, in falling order, so that memory
    stays in proportion to the items.
    """
    size = np.asarray(sizes, np.int64)
    order = np.lexsort((np.arange(len(size)), -size))
    nxt = np.full(len(size), -1)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(size[order]) != 0])) if len(size) else np.zeros(0, np.int64)
    level: list[np.ndarray] = []
    # (- spread, turn, size of a group's items or 0, its items or the windows' sums, heads, tails)
    heap: list[tuple] = [(-int(size[order[a]]), n, int(size[order[a]]), order[a:b], None, None) for n, (a, b) in enumerate(zip(starts, np.append(starts, len(size))[1:], strict=True))]
    heapq.heapify(heap)
    turn = len(heap)

    def push(s: np.ndarray, head: np.ndarray, tail: np.ndarray) -> None:
        nonlocal turn
        turn += 1
        used = head >= 0
        s, head, tail = s[used], head[used], tail[used]
        rank = np.argsort(-s, kind="stable")
        s, head, tail = s[rank], head[rank], tail[rank]
        heapq.heappush(heap, (int((s[-1] if len(s) == k else 0) - s[0]), turn, 0, s, head, tail))

    while heap and (len(heap) > 1 or heap[0][2]):
        _, _, one, s1, h1, t1 = heapq.heappop(heap)
        if one:
            full = len(s1) // k * k
            if full:
                level.append(s1[:full].reshape(-1, k))
            if len(rest := s1[full:]):
                push(np.full(len(rest), one), rest, rest.copy())
            continue
        spread, first, one, s2, h2, t2 = heapq.heappop(heap)
        if one and len(s2) <= k:  # a window each
            s2, h2, t2 = np.full(len(s2), one), s2, s2.copy()
        elif one:
            s, head, tail = (np.concatenate([x, np.full(k - len(x), v)]) for x, v in ((s1, 0), (h1, -1), (t1, -1)))
            low, top, taken = [(int(x), j) for j, x in enumerate(s)], int(s[0]), 0
            heapq.heapify(low)
            while taken < len(s2) and top - low[0][0] >= one:
                x, j = low[0]
                item = s2[taken]
                if head[j] < 0:
                    head[j] = item
                else:
                    nxt[tail[j]] = item
                tail[j] = item
                heapq.heapreplace(low, (x + one, j))
                top, taken = max(top, x + one), taken + 1
            for x, j in low:
                s[j] = x
            push(s, head, tail)
            if taken < len(s2):
                heapq.heappush(heap, (spread, first, one, s2[taken:], None, None))
            continue
        s2, h2, t2 = s2[::-1], h2[::-1], t2[::-1]
        both = max(0, len(s1) + len(s2) - k)  # windows that are used on either side
        cut = len(s1) - both
        nxt[t1[cut:]] = h2[:both]
        push(np.concatenate([s1[:cut], s1[cut:] + s2[:both], s2[both:]]), np.concatenate([h1, h2[both:]]), np.concatenate([t1[:cut], t2]))
    out: list[list[int]] = [[] for _ in range(k)]
    for j, i in enumerate(heap[0][4] if heap else []):
        while i >= 0:
            out[j].append(int(i))
            i = nxt[i]
    for rows in level:
        for j in range(k):
            out[j] += rows[:, j].tolist()
    return out


def pack(lengths: list[int], capacity: int = CAPACITY, filler: float = FILLER) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, start, length); every token of every item lies in one piece, all windows but the last are full."""
    windows, rest = [], []
    for i, n in enumerate(lengths):
        full = n // capacity
        windows += [[(i, j * capacity, capacity)] for j in range(full)]
        if n > full * capacity:
            rest.append((i, full * capacity, n - full * capacity))
    total = sum(r[2] for r in rest)
    if not total:
        return windows
    rest.sort(key=lambda r: -r[2])
    kept = np.cumsum([r[2] for r in rest])
    first = min(len(rest), int(np.searchsorted(kept, filler * total)) + 1)
    held, rest = rest[:first], rest[first:]
    k = -(-total // capacity)
    sizes = [r[2] for r in rest]
    while True:
        parts = difference(sizes, k)
        sums = [sum(sizes[i] for i in p) for p in parts]
        if max(sums) <= capacity:
            break
        k += 1
    for j in sorted(range(k), key=lambda j: (-sums[j], j)):
        own, room = [rest[i] for i in parts[j]], capacity - sums[j]
        while room and held:
            i, start, n = held.pop()
            take = min(n, room)
            own.append((i, start, take))
            room -= take
            if take < n:
                held.append((i, start + take, n - take))
        if own:
            windows.append(own)
    return windows


class Packer:
    """Packs the documents of one partition block by block."""

    def __init__(self, capacity: int, block: int, first: int):
        self.capacity, self.block, self.sequence = capacity, block, first
        self.items: list[tuple] = []  # doc_id, start, ids of what is left, doc_tokens
        self.held = 0

    def add(self, doc_id, ids: np.ndarray) -> None:
        self.items.append((doc_id, 0, ids, len(ids)))
        self.held += len(ids)

    def rows(self, last: bool) -> Iterator[tuple]:
        if not last and self.held < self.block or not self.items:
            return
        items, self.items, self.held = self.items, [], 0
        for window in pack([len(x[2]) for x in items], self.capacity):
            if not last and sum(p[2] for p in window) < self.capacity:
                for i, start, n in window:
                    doc, at, ids, of = items[i]
                    self.items.append((doc, at + start, ids[start : start + n], of))
                    self.held += n
                continue
            offset = 0
            for i, start, n in window:
                doc, at, ids, of = items[i]
                crc = zlib.crc32(np.ascontiguousarray(ids[start : start + n], "<u4"))
                yield doc, at + start, n, crc, of, self.sequence, offset
                offset += n
            self.sequence += 1


def pack_documents(df: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """One row per piece; ``sequence_id`` is unique over all partitions, ``offset`` gapless within a sequence."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kind = pa.schema([(n, pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(capacity, block, TaskContext.get().partitionId() << 33)

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            rows = packer.rows(last)
            while some := list(islice(rows, 65_536)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], schema=kind)

        for batch in batches:
            for part in slices(batch):
                flat, n = encode_texts(part.column("text"), path, end_id)
                for doc, ids in zip(part.column("doc_id").to_pylist(), np.split(flat, np.cumsum(n)[:-1]), strict=True):
                    packer.add(doc, ids)
                yield from out(False)
        yield from out(True)

    return texts(df).mapInArrow(run, SCHEMA)
