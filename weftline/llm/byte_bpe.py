"""Byte-level BPE by DuckDB recursive queries per partition.

Texts fall into the pattern's matches in Python; distinct matches become rows (word, place, token) of a DuckDB
table. A recursive query joins neighbouring rows with the merge table (left, right, rank), contracts each word's
leftmost pair of minimum rank and repeats until no word has a known pair. Words over ``LONG`` bytes contract all
non-overlapping occurrences of their minimum pair in one round, which gives the same tokens where no merge with the
new token ranks lower (checked per rank; else the leftmost alone goes). An ordered aggregation over the ids joined
with the vocabulary decodes.

Words over ``WHOLE`` bytes are contracted as pieces of ``PIECE`` bytes that overlap by half, all in one query, so that
rounds do not grow with the word. Two neighbours are joined at a token which both have in their overlap; those
without one become one larger piece, until all are joined. This is exact where ranks never fall while any token of
the vocabulary is made by itself (checked once; else the word stays whole): merges then run rank by rank, so that a
row of tokens whose neighbours all stand side by side in the contraction of some stretch is that of the whole.

Rounds are few because words and pieces are short; the cache of distinct chunks is bounded by entries and bytes and
lives in the Python worker.

Defined results: null and empty texts have no ids and decode to no bytes; special strings are ordinary text; a null
id stays null; repeated rows each give a row; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftline.llm.common import ChunkCache, gather, group_sums, slices, texts

LONG, WHOLE, PIECE = 64, 256, 64
#: Characters with the Unicode property White_Space, as the pattern's ``\s`` reads them.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_COARSE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

CONTRACT = """
with recursive step(done, w, p, t, nx) as (
  select false, w, p, t, nx from sym
  union all
  (with hit as (
     select a.w, min(m.m * 4294967296 + a.p) as h, arg_min(b.nx, m.m * 4294967296 + a.p) as nn,
            arg_min(b.p, m.m * 4294967296 + a.p) as q
     from step a join step b on a.nx = b.p join merges m on m.k = ((a.t << 17) | b.t)
     where not a.done and not b.done group by a.w)
   select h.w is null, s.w, s.p, case when s.p = (h.h & 4294967295) then h.h >> 32 else s.t end,
          case when s.p = (h.h & 4294967295) then h.nn else s.nx end
   from step s left join hit h on s.w = h.w where not s.done and s.p is distinct from h.q)
)
select p, t from step where done
"""
CONTRACT_LONG = """
with recursive step(done, w, p, t) as (
  select false, w, p, t from sym
  union all
  (with pair as (
     select s.w, s.p, s.t, m.m, min(m.m) over (partition by s.w) as b
     from (select w, p, t, lead(t) over (partition by w order by p) as n from step where not done) s
     left join merges m on m.k = ((s.t << 17) | s.n)),
   hit as (
     select pair.*, coalesce(pair.m = b, false) as h, u.m is not null as one,
            row_number() over (partition by w order by p) as r from pair left join unsafe u on u.m = b),
   runs as (
     select *, max(case when not h then r else 0 end) over (partition by w order by p rows unbounded preceding) as gap,
            sum(h::int) over (partition by w order by p rows unbounded preceding) as nth from hit),
   taken as (select *, h and case when one then nth = 1 else (r - gap) % 2 = 1 end as take from runs),
   left_over as (select *, lag(take, 1, false) over (partition by w order by p) as gone from taken)
   select b is null, w, p, case when take then b else t end from left_over where not gone)
)
select p, t from step where done
"""
# string_agg depends on the order of its input, which the engine keeps
DECODE = "select string_agg(s, '') as s from (select i.d, v.s from ids i join vocab v on v.t = i.t order by i.p) group by d order by d"


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """One vocabulary in one in-memory DuckDB database."""

    def __init__(self, path: str, pattern: str):
        self.known = known = ranks(path)
        self.fine = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]"))
        self.byte = np.array([known[bytes([b])] for b in range(256)], np.int64)
        rows, unsafe = [], set()
        for token, rank in known.items():
            for i in range(1, len(token)):
                a, b = known.get(token[:i]), known.get(token[i:])
                if a is not None and b is not None:
                    rows.append(((a << 17) | b, rank))
                    unsafe.update(x for x in (a, b) if x >= rank)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "300MB", "temp_directory": ""})
        k, m = zip(*rows, strict=True)
        self._table("merges", k=pa.array(k, pa.int64()), m=pa.array(m, pa.int64()))
        self._table("unsafe", m=pa.array(sorted(unsafe), pa.int64()))
        self._table("vocab", t=pa.array(known.values(), pa.int64()), s=pa.array([t.decode("latin-1") for t in known]))
        self.cache = ChunkCache(_COARSE.findall, self.resolve, 300_000)

    def _table(self, name: str, **cols) -> None:
        self.con.register("given", pa.table(cols))
        self.con.execute(f"create table {name} as select * from given")
        self.con.unregister("given")

    @cached_property
    def regular(self) -> bool:
        """Whether the ranks of successive merges never fall while a token is made from its bytes alone."""
        for token in self.known:
            parts, last = [bytes([b]) for b in token], -1
            while len(parts) > 1:
                rank, i = min((self.known.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == 1 << 30:
                    break
                if rank < last:
                    return False
                parts[i : i + 2], last = [parts[i] + parts[i + 1]], rank
        return True

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, by the recursive query, and how many each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        apart = np.flatnonzero(size > WHOLE).tolist()
        if not apart or not self.regular:
            flat, _, count = self.contracted(words)
            return flat, count
        short = np.flatnonzero(size <= WHOLE)
        flat, _, n = self.contracted([words[i] for i in short])
        parts, count = [flat], np.zeros(len(words), np.int64)
        first = np.zeros(len(words), np.int64)
        count[short], first[short], done = n, np.cumsum(n) - n, len(flat)
        for i in apart:
            ids = self.pieced(words[i])
            parts.append(ids)
            count[i], first[i], done = len(ids), done, done + len(ids)
        return gather(np.concatenate(parts), first, count), count

    def contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words in a row, the byte at which each begins in its word, and how many each word has."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        first, count, parts, places, done = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], [], 0
        by_size = np.argsort(size, kind="stable")  # words of a block take about as many rounds
        edge = np.searchsorted(size[by_size], LONG, side="right")
        for query, some in ((CONTRACT, by_size[:edge]), (CONTRACT_LONG, by_size[edge:])):
            for at in range(0, len(some), 20_000):
                block = some[at : at + 20_000]
                raw = np.frombuffer(b"".join([words[i] for i in block]), np.uint8)
                place, word = np.arange(len(raw)), np.repeat(np.arange(len(block)), size[block])
                nx = place + 1
                nx[np.cumsum(size[block]) - 1] = -1
                self.con.register("sym", pa.table({"w": word, "p": place, "t": self.byte[raw], "nx": nx}))
                got = self.con.sql(query).to_arrow_table()
                p, t = got.column("p").to_numpy(), got.column("t").to_numpy()
                order = np.argsort(p)  # places run on over the words
                parts.append(t[order].astype(np.int32))
                p = p[order]
                places.append((p - (np.cumsum(size[block]) - size[block])[word[p]]).astype(np.int32))
                count[block] = n = np.bincount(word[p], minlength=len(block))
                first[block] = done + np.cumsum(n) - n
                done += len(t)
        flat, begin = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (parts, places))
        return gather(flat, first, count), gather(begin, first, count), count

    def pieced(self, word: bytes) -> np.ndarray:
        """Ids of one long word from overlapping pieces."""
        half = PIECE // 2
        spans = [(a, min(a + PIECE, len(word))) for a in range(0, len(word) - half, half)]
        made: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        while True:
            todo = [s for s in spans if s not in made]
            flat, begin, n = self.contracted([word[a:b] for a, b in todo])
            for span, ids, at in zip(todo, np.split(flat, np.cumsum(n)[:-1]), np.split(begin, np.cumsum(n)[:-1]), strict=True):
                made[span] = ids, at.astype(np.int64) + span[0]
            ends, out, joined = [], [], [spans[0]]
            for left, right in zip(spans, spans[1:], strict=False):
                tokens = lambda s: zip(made[s][1].tolist(), [*made[s][1][1:].tolist(), s[1]], strict=True)
                mine = {t for t in tokens(left) if t[0] >= right[0]}
                shared = next((t for t in tokens(right) if t in mine), None)
                if shared is None:
                    joined[-1] = joined[-1][0], right[1]
                else:
                    joined.append(right)
                    ends.append(shared[1])
            if len(joined) == len(spans):
                break
            spans = joined
        for span, a, b in zip(spans, [0, *ends], [*ends, len(word)], strict=True):
            ids, at = made[span]
            out.append(ids[(at >= a) & (at < b)])
        return np.concatenate(out)

    def resolve(self, unseen: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of coarse chunks (an optional blank and what stands up to the next white space), match by match."""
        split = [self.fine.findall(c) for c in unseen]
        every = list(chain.from_iterable(split))
        words = {w: i for i, w in enumerate(dict.fromkeys(every))}
        flat, n = self.contract([w.encode("utf-8") for w in words])
        code = np.fromiter(map(words.__getitem__, every), np.int64, len(every))
        pieces = np.fromiter(map(len, split), np.int64, len(split))
        return gather(flat, (np.cumsum(n) - n)[code], n[code]), group_sums(n[code], pieces)

    def encode(self, given: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row, and how many each text has."""
        return self.cache.ids(given)

    def decode(self, flat: np.ndarray, n: np.ndarray) -> list[bytes]:
        """Bytes of each text, by an ordered aggregation over its ids."""
        doc = np.repeat(np.arange(len(n), dtype=np.int32), n)
        self.con.register("ids", pa.table({"d": doc, "p": np.arange(len(flat), dtype=np.int32), "t": flat.astype(np.int64)}))
        got = iter(self.con.sql(DECODE).to_arrow_table().column("s").to_pylist())
        return [next(got).encode("latin-1") if k else b"" for k in n]


@cache
def codec(path: str, pattern: str) -> Codec:
    """One per Python worker."""
    return Codec(path, pattern)


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, the ids of the whole text and the bytes that these ids decode to."""
    kind = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                c = codec(path, pattern)
                flat, n = c.encode(part.column("text").to_pylist())
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(flat, pa.int32())), pa.array(c.decode(flat, n), pa.binary())], schema=kind
                )

    return texts(df).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
