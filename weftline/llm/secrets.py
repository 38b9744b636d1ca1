"""Secret scans: three fixed kinds, and strings of high sliding-window entropy.

The fixed kinds (assign, access, hex) are found by pattern and kept as they are. Candidate strings are runs of key
signs; each belongs to a character class (hex, base36, base64). A window slides over the candidate with counts kept
up to date sign by sign, so that its Shannon entropy changes by two terms a step; a candidate whose highest window
entropy reaches its class's bound becomes a span, unless the allow list (words, paths, identifiers, runs of one sign,
UUIDs, placeholders) suppresses it. Of a candidate that fixed spans overlap, the parts beside them are scored.

Defined results: null and empty texts have no spans; offsets are code points, end exclusive; a null id stays null;
repeated rows each give a row; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import slices, texts

# The patterns of the base kinds and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Signs that join a part of a candidate to the fixed span beside it.
JOINERS = "-_/"
#: Least window entropy in bits by class; a window of 20 signs has log2(20) = 4.32 at most.
CLASSES = ((re.compile(r"[0-9a-fA-F]+\Z"), 3.0), (re.compile(r"[A-Z0-9]+\Z|[a-z0-9]+\Z"), 3.5), (re.compile(r"[A-Za-z0-9+/_=-]+\Z"), 3.8))
ALLOWED = re.compile(
    r"[A-Za-z]+\Z|[0-9]+\Z|[A-Za-z]+(?:[-_/=+][A-Za-z]*)+\Z|(?:[A-Za-z]{2,}[0-9]{0,4}[-_/=+]+)+[A-Za-z0-9]{0,12}\Z"
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z|.*(?:EXAMPLE|example|xxxx|XXXX|0000)"
)
_TERM = [0.0, *(k * math.log2(k) for k in range(1, WINDOW + 1))]


def window_entropy(text: str, window: int = WINDOW) -> float:
    """Highest Shannon entropy (bits a sign) of any window, by counts kept up to date."""
    window = min(window, len(text))
    counts: dict[str, int] = {}
    spread = best = 0.0  # sum of count * log2(count)
    for i, c in enumerate(text):
        k = counts.get(c, 0)
        counts[c] = k + 1
        spread += _TERM[k + 1] - _TERM[k]
        if i >= window:
            gone = text[i - window]
            k = counts[gone]
            counts[gone] = k - 1
            spread += _TERM[k - 1] - _TERM[k]
        if i >= window - 1:
            best = max(best, math.log2(window) - spread / window)
    return best


def is_secret(text: str) -> bool:
    """Whether a candidate passes its class's bound and the allow list."""
    if ALLOWED.match(text) or len(set(text)) < 8:
        return False
    bound = next(b for pattern, b in CLASSES if pattern.match(text))
    return window_entropy(text) >= bound


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds, sorted."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    low = text.lower()
    if any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    return sorted(out)


def entropy_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of high entropy; of one that fixed spans overlap, the parts beside them, each scored by itself."""
    out, i, at = [], 0, 0  # base is sorted by start; fixed spans so far end at ``at``
    for m in CANDIDATE.finditer(text):
        begin, end = m.span()
        parts = []
        while i < len(base) and base[i][0] < end:
            parts.append((max(begin, at), base[i][0]))
            at = max(at, base[i][2])
            i += 1
        parts.append((max(begin, at), end))
        for a, b in parts:
            if b - a < WINDOW:
                continue
            a += a > begin and text[a] in JOINERS
            b -= b < end and text[b - 1] in JOINERS
            if b - a >= WINDOW and is_secret(text[a:b]):
                out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_secrets(df: DataFrame) -> DataFrame:
    """doc_id, base and all: the fixed kinds' spans and every span, as kind:start:end joined by commas."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                base = [(t, base_spans(t)) for t in part.column("text").to_pylist()]
                every = [joined(b + entropy_spans(t, b)) for t, b in base]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([joined(b) for _, b in base], pa.string()), pa.array(every, pa.string())], names=["doc_id", "base", "spans"])

    return texts(df).mapInArrow(run, "doc_id long, base string, spans string")


def digest(found: DataFrame) -> DataFrame:
    """Counts by kind, the base spans' SHA-256 and all spans."""
    listed = F.split(F.col("base"), ",")
    count = lambda kind: F.size(F.filter(listed, lambda s: s.startswith(f"{kind}:"))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2("base", 256).alias("base_sha256"), "spans")


def redact(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by ``mark``."""
    base = base_spans(text)
    out, at = [], 0
    for a, _, b in sorted(base + entropy_spans(text, base)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redacted(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``df`` with all their columns, secrets in ``text`` replaced; null texts stay null; no shuffle."""
    at = df.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                new = [t if t is None else redact(t, mark) for t in part.column(at).to_pylist()]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.column(at).type))

    return df.mapInArrow(run, df.schema)
