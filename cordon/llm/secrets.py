"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

A candidate is a run of 20 or more characters of letters, digits and +/_-=. Its character class
(hex, digits and letters of one or both cases, or base64) sets the alphabet and the threshold. A window moves over the
candidate; the counts of its characters, and with them the sum of c*log2(c), change by one character
in and one out. Windows above the threshold join to spans of kind `entropy`. Candidates that an
allow-list pattern fits (UUIDs, runs of the alphabet or of digits, plain words, file paths) are suppressed; the fixed
patterns are never.

Null texts count as empty; empty texts, texts of any length, repeated rows and empty tables are
treated alike; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Strings that look random but are not secret.
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[A-Za-z]+([-_/+=][A-Za-z]+)*"),
    re.compile(r"[0-9]+([-_/+=][0-9]+)*"),
    re.compile(r"(?i).*(abcdefghij|0123456789|example|placeholder).*"),
    re.compile(r"[A-Za-z]*(/[A-Za-z0-9_-]{1,15}){2,}/?"),
)
WINDOW = 20
#: Bits a character: (class, least entropy of a window).
CLASSES = ((re.compile(r"[0-9a-fA-F]+"), 3.2), (re.compile(r"[0-9a-zA-Z]+"), 3.8), (re.compile(r"[\s\S]+"), 3.9))
_TERM = [0.0, 0.0, *(c * math.log2(c) for c in range(2, 4096))]


def hot_windows(s: str, window: int, least: float) -> Iterator[tuple[int, int]]:
    """Joined windows of s with an entropy of at least `least` bits a character."""
    counts: dict[str, int] = {}
    total, begin, end = 0.0, -1, -1
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += _TERM[c + 1] - _TERM[c]
        counts[ch] = c + 1
        if i >= window:
            out = s[i - window]
            c = counts[out]
            total += _TERM[c - 1] - _TERM[c]
            counts[out] = c - 1
        if i >= window - 1 and math.log2(window) - total / window >= least - 1e-9:
            if begin >= 0 and i - window + 1 > end:
                yield begin, end
                begin = -1
            if begin < 0:
                begin = i - window + 1
            end = i + 1
    if begin >= 0:
        yield begin, end


def scan(text: str, window: int = WINDOW, allow: tuple = ALLOW) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans, sorted."""
    spans = []
    low = text.lower()
    if any(n in low for n in NAMES):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if any(a.fullmatch(s) for a in allow):
            continue
        least = next(x for kind, x in CLASSES if kind.fullmatch(s))
        spans += [(m.start() + a, 3, m.start() + b) for a, b in hot_windows(s, window, least)]
    return sorted(spans)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "_key {key}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def secret_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: _key, counts by kind, base_sha256, spans (kind:start:end by start, then kind; code points)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("_text"):
                spans = scan(t.as_py() or "")
                base = [x for x in spans if x[1] < 3]
                rows.append((*(sum(x[1] == k for x in spans) for k in range(4)), hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column("_key"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["_key", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, SCHEMA.format(key=rows.schema["_key"].dataType.simpleString()))
