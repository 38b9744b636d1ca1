"""Helpers shared by the language-model operators: folders, inputs, Arrow output and the chunk cache."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word rule ``[^\x20\x09-\x0D]+``.
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``; a temporary one where that is unset and Spark is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_MADE: list[DataFrame] = []


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts lineage and survives lost executors.

    The table goes when ``drop_written`` or ``drop_since`` names it, at the latest when Spark ends; one at a ``path`` of
    the caller's stays.
    """
    spark = df.sparkSession
    to = path or f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(to)
    out = spark.read.schema(df.schema).parquet(to)
    out._weftline_path = to
    if path is None:
        fs, at = _file_system(spark, to)
        fs.deleteOnExit(at)
        _MADE.append(out)
    return out


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop_written(df: DataFrame) -> None:
    """Delete the files behind a ``written`` table that no later step reads."""
    fs, at = _file_system(df.sparkSession, df._weftline_path)
    fs.delete(at, True)
    _MADE[:] = [x for x in _MADE if x is not df]


def mark_written() -> int:
    """A place in the list of tables for ``drop_since``."""
    return len(_MADE)


def drop_since(mark: int, but: DataFrame) -> None:
    """Delete the tables written since ``mark``, except ``but``, which must not depend on them."""
    for df in _MADE[mark:]:
        if df is not but:
            drop_written(df)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only id (long) and text (null becomes empty), so further columns of any name cannot clash."""
    return df.select(df[id_col].cast("long").alias("doc_id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the fold of the learned operators."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


def slices(batch: pa.RecordBatch, limit: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each slice holds at most about ``limit`` bytes of text (one row at least)."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(size):
        if i > start and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)


_CHUNK = re.compile(r"[^ \t\n\r]+")


def chunks(text: str) -> list[str]:
    """Runs between blank, tab, line feed and carriage return: no pre-token of the word vocabulary spans one."""
    return _CHUNK.findall(text)


class ChunkCache:
    """Ids of distinct chunks, kept across the batches of one Python worker under a fixed bound.

    ``resolve`` maps unseen chunks to lists of ids, or to all ids in a row and how many each chunk has. Past ``limit``
    entries or ``weight`` signs and ids, those seen only once go and the commonest stay up to half of either bound, so
    that the memory does not grow with the input; between two prunings one slice of texts is added at most. ``pieces``
    splits all texts at once: distinct chunks, the place of each chunk among them, and how many each text has.
    """

    def __init__(self, split: Callable[[str], list[str]], resolve: Callable[[list[str]], Iterable], limit: int = 300_000, weight: int = 32 << 20, pieces: Callable | None = None):
        self.split, self.resolve, self.limit, self.weight, self.pieces = split, resolve, limit, weight, pieces
        self._reset()

    def _reset(self) -> None:
        self.code: dict[str, int] = {}
        self.signs = 0
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size, self.seen = (np.zeros(0, np.int64) for _ in range(3))

    def _shrink(self) -> None:
        names = list(self.code)
        keep = np.flatnonzero(self.seen > 1)
        keep = keep[np.argsort(-self.seen[keep], kind="stable")[: self.limit // 2]]
        heavy = np.cumsum([len(names[k]) for k in keep]) + np.cumsum(self.size[keep])
        keep = keep[: np.searchsorted(heavy, self.weight // 2, side="right")]
        ids = gather(self.flat, self.start[keep], self.size[keep]), self.size[keep]
        names, seen = [names[k] for k in keep], self.seen[keep] // 2
        self._reset()
        self._add(names, ids)
        self.seen = seen

    def _add(self, names: list[str], ids) -> None:
        if not isinstance(ids, tuple):
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            ids = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), sizes
        row, sizes = ids
        more = len(row)
        while self.used + more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.int32)])
        self.flat[self.used : self.used + more] = row
        self.start = np.concatenate([self.start, self.used + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.seen = np.concatenate([self.seen, np.zeros(len(sizes), np.int64)])
        self.signs += sum(map(len, names))
        base = len(self.code)
        self.code.update(zip(names, range(base, base + len(names)), strict=True))
        self.used += more

    def codes(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The chunk codes of all texts in a row, and how many each text has."""
        if len(self.code) > self.limit or self.signs + self.used > self.weight:
            self._shrink()
        if self.pieces:
            names, at, n = self.pieces(texts)
            code = np.fromiter(map(self.code.get, names, repeat(-1)), np.int64, len(names))
            missing = np.flatnonzero(code < 0)
            if len(missing):
                code[missing] = np.arange(len(self.code), len(self.code) + len(missing))
                self._add(unseen := [names[i] for i in missing.tolist()], self.resolve(unseen))
            self.seen[code] += np.bincount(at, minlength=len(names))
            return code[at], n
        parts = [self.split(t) for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        every = list(chain.from_iterable(parts))
        unseen = set(every)
        unseen.difference_update(self.code)
        if unseen:
            self._add(names := list(unseen), self.resolve(names))
        code = np.fromiter(map(self.code.__getitem__, every), np.int64, len(every))
        self.seen += np.bincount(code, minlength=len(self.seen))
        return code, n

    def counts(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        code, n = self.codes(texts)
        return group_sums(self.size[code], n)

    def ids(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts in a row, and how many each text has."""
        code, n = self.codes(texts)
        size = self.size[code]
        return gather(self.flat, self.start[code], size), group_sums(size, n)


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` from each start, one after the other."""
    end = np.cumsum(size)
    n = int(end[-1]) if len(end) else 0
    place = np.int32 if max(n, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((start - (end - size)).astype(place), size)
    at += np.arange(n, dtype=place)
    return flat[at]


def group_sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of ``n`` values; empty groups give 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(n)
    return total[end] - total[end - n]
