"""The word-end vocabulary (lower case, white space dropped): plain pre-tokens by their bytes, others and all ids by the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from weftline.llm.common import ChunkCache, chunks

# Fixed values of the vocabulary file's pre-tokenizer.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_LATIN = re.compile(rf"{CONTRACTIONS}|[a-zß-öø-ÿĀ-ſ]+|[0-9]|[^ \t\n\ra-z0-9ß-öø-ÿĀ-ſ]+")
_ODD = re.compile(r"[^ \t\n\r!-~À-ÖØ-öø-įĲ-ſ]|<\|")
#: Marks a chunk that the library has to see as it is; no simple pre-token holds this sign.
RAW = "\x00"
#: Kinds of bytes: white space, letters (both bytes of those beyond ASCII), digits, other visible signs, and those of odd chunks only.
BLANK, LETTER, DIGIT, OTHER, STRANGE = range(5)
#: Unseen pre-tokens per call of the library.
LOT = 1_024


@cache
def byte_signs() -> list[str]:
    """The printable sign that byte-level vocabularies write for each byte."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def signs(piece: str) -> str:
    if piece.isascii() and piece.isprintable() and " " not in piece:
        return piece
    return "".join(byte_signs()[b] for b in piece.encode("utf-8"))


def is_simple(text: str) -> bool:
    """Only visible ASCII, Latin letters and plain white space: normalisation changes nothing but the case."""
    return _ODD.search(text) is None


def split(text: str) -> list[str]:
    """Normalised pre-tokens; chunks out of the ordinary stay whole behind ``RAW``."""
    if is_simple(text):
        return _LATIN.findall(text.lower())
    out: list[str] = []
    for c in chunks(text):
        if is_simple(c):
            out += _LATIN.findall(c.lower())
        else:
            out.append(RAW + c)
    return out


@cache
def byte_tables() -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Kind and lower case of each byte; of the letters of two bytes (first byte C3 to C5), whether they are odd, and their lower case."""
    kind = np.full(256, STRANGE, np.uint8)
    kind[0x21:0x7F] = OTHER
    kind[list(b" \t\n\r")] = BLANK
    kind[list(b"0123456789")] = DIGIT
    kind[0x41:0x5B] = kind[0x61:0x7B] = kind[0x80:0xC0] = kind[0xC3:0xC6] = LETTER
    letters = [chr(c) for c in range(0xC0, 0x180)]
    odd = np.array([not is_simple(c) for c in letters])
    lower = np.array([list((c if o else c.lower()).encode()) for c, o in zip(letters, odd, strict=True)], np.uint8)
    return kind.tobytes(), bytes(range(256)).lower(), odd, lower


@cache
def odd_pairs() -> list[str]:
    """What makes a chunk odd though each of its bytes is plain."""
    return ["<|", *(chr(0xC0 + i) for i in np.flatnonzero(byte_tables()[2]))]


def whole_chunks(raw: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kinds and text in lower case, but chunks that hold an odd sign stay whole, as they are written."""
    _, lowered, odd, pairs = byte_tables()
    kind, text = kind.copy(), np.frombuffer(bytearray(raw.tobytes().translate(lowered)), np.uint8)
    lead = np.flatnonzero((raw >= 0xC3) & (kind == LETTER))
    pair = (raw[lead].astype(np.int64) - 0xC3 << 6) + (raw[lead + 1] & 0x3F)
    text[lead], text[lead + 1] = pairs[pair, 0], pairs[pair, 1]
    bar = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
    strange = np.concatenate([np.flatnonzero(kind == STRANGE), lead[odd[pair]], bar])
    blank = np.flatnonzero(kind == BLANK)
    last = np.unique(np.searchsorted(blank, strange))
    step = np.zeros(len(raw), np.int8)
    step[np.where(last > 0, blank[last - 1] + 1, 0)] = 1
    step[blank[last]] = -1
    whole = np.cumsum(step, dtype=np.int8).view(bool)
    kind[whole], text[whole] = STRANGE, raw[whole]
    return kind, text


def piece_starts(raw: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the pieces begin."""
    start = kind == DIGIT
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    start &= kind != BLANK
    quote = np.flatnonzero(raw == ord("'"))
    quote = quote[start[quote] & (kind[quote + 1] == LETTER)]
    one, two = raw[quote + 1] | 0x20, raw[quote + 2] | 0x20  # lower case, as only letters can match
    tail = np.where(np.isin(one, list(b"stmd")), 1, 0) + 2 * (np.isin(one, list(b"rv")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    quote, tail = quote[tail > 0], tail[tail > 0]
    start[quote + 1] = False
    after = quote + 1 + tail
    start[after[kind[after] == LETTER]] = True
    return np.flatnonzero(start)


def distinct(starts: np.ndarray, kind: np.ndarray, data: bytes | np.ndarray) -> pa.DictionaryArray:
    """The pieces that begin at ``starts``, from their bytes without white space."""
    blanks = np.cumsum(kind == BLANK, dtype=np.int32)
    ends = np.append(starts - blanks[starts], len(data)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data)).dictionary_encode()


def joined(strings: pa.StringArray) -> pa.StringScalar:
    """All strings with a line feed between them."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(strings)], pa.int32()), strings), "\n")[0]


def pieces(texts: list[str] | pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """``split`` of many texts at once, by their bytes: the distinct pieces, the place of each piece among them, and how many each text has."""
    given = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    if not len(given):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a line feed after each text and one more: no piece spans two texts, and two bytes follow every sign
    written = joined(given).as_buffer().to_pybytes() + b"\n\n"
    raw = np.frombuffer(written, np.uint8)
    kinds, lowered, _, _ = byte_tables()
    signs = written.translate(kinds)
    kind = np.frombuffer(signs, np.uint8)
    strange = STRANGE in signs
    if not strange:
        starts = piece_starts(raw, kind)
        found = distinct(starts, kind, written.translate(lowered, b" \t\n\r"))
        names = joined(found.dictionary).as_py()
        strange = any(x in names for x in odd_pairs())  # one piece holds both bytes
    if strange:
        kind, text = whole_chunks(raw, kind)
        starts = piece_starts(raw, kind)
        found = distinct(starts, kind, text[kind != BLANK])
        names = joined(found.dictionary).as_py()
    elif (low := names.lower()) != names:  # letters of two bytes
        again = pa.array(low.split("\n"), pa.string()).dictionary_encode()
        names, found = joined(again.dictionary).as_py(), pa.DictionaryArray.from_arrays(again.indices.take(found.indices), again.dictionary)
    names = names.split("\n") if len(found.dictionary) else []
    if strange:
        names = [p if is_simple(p) else RAW + p for p in names]
    first = np.cumsum(np.append(0, pc.binary_length(given).to_numpy().astype(np.int64) + 1))
    return names, found.indices.to_numpy(), np.diff(np.searchsorted(starts, first))


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def signed_pretokens(path: str, chunk: str) -> list[str]:
    """Pre-tokens, in byte signs, of one chunk that holds no special string, by the library's own Unicode tables."""
    whole = tokenizer(path)
    return [p for p, _ in whole.pre_tokenizer.pre_tokenize_str(whole.normalizer.normalize_str(chunk))]


@cache
def spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def resolver(path: str):
    """Ids of unseen pre-tokens by the library's merges; the whole library for raw chunks."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work; a worker has one core
    whole = tokenizer(path)
    merges = Tokenizer(whole.model)  # the model alone
    merges.pre_tokenizer = Split("\n", "removed")
    sign = np.array([ord(s) for s in byte_signs()], "<u2")
    sign[ord("\n")] = ord("\n")  # no pre-token holds one
    mark = spec(path)["model"]["end_of_word_suffix"]
    vocab = whole.get_vocab()
    closes = np.zeros(max(vocab.values()) + 1, bool)
    closes[[i for t, i in vocab.items() if t.endswith(mark)]] = True

    def simple(unseen: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lots = ["\n".join(unseen[i : i + LOT]).encode() for i in range(0, len(unseen), LOT)]
        signed = [sign[np.frombuffer(lot, np.uint8)].tobytes().decode("utf-16-le") for lot in lots]
        ids = np.concatenate([np.array(e.ids, np.int32) for lot in signed for e in merges.encode_batch_fast([lot], add_special_tokens=False)])
        last = np.flatnonzero(closes[ids])  # a word's last id, and no other, has the mark of its end
        if len(last) != len(unseen):
            raise ValueError(f"{path}: {len(last)} ends of words for {len(unseen)} words")
        return ids, np.diff(last, prepend=-1)

    def resolve(unseen: list[str]) -> tuple[np.ndarray, np.ndarray] | list:
        raw = [i for i, p in enumerate(unseen) if p[0] == RAW]
        if not raw:
            return simple(unseen)
        out: list = [[]] * len(unseen)
        if plain := [i for i, p in enumerate(unseen) if p[0] != RAW]:
            ids, sizes = simple([unseen[i] for i in plain])
            for i, row in zip(plain, np.split(ids, np.cumsum(sizes)[:-1]), strict=True):
                out[i] = row.tolist()
        for i in raw:
            out[i] = whole.encode(unseen[i][1:], add_special_tokens=False).ids
        return out

    return resolve


@cache
def id_cache(path: str) -> ChunkCache:
    """One per Python worker."""
    return ChunkCache(split, resolver(path), pieces=pieces)


def encode_texts(texts: list[str] | pa.Array, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, each text closed by ``end_id`` if given, and how many each has."""
    flat, n = id_cache(path).ids(texts)
    if end_id is None:
        return flat, n
    out = np.full(len(flat) + len(n), end_id, np.int32)
    mark = np.ones(len(out), bool)
    mark[np.cumsum(n + 1) - 1] = False
    out[mark] = flat
    return out, n + 1
