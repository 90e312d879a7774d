"""Secret scans: base patterns plus sliding-window entropy over candidate strings.

A candidate is a run of at least ``window`` characters of ``[A-Za-z0-9+/_=-]``. Its character class is
hex if it holds only hex digits, else mixed. A window slides over it; adding one character and taking
one away updates the counts and with them the Shannon entropy. Windows whose entropy reaches the class's
threshold and that hold letters and digits are merged into spans; where the letters don't read as words (slugs, paths, camel case),
digits aren't asked for. The allow-list suppresses candidates that are no secrets though they look
random: UUIDs, digests announced as such and sample keys. Base spans are cut out of added spans; what they leave stays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import arrow_map, utf8

Span = tuple[str, int, int]
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_mixed")
BASE = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WINDOW = 20
#: Bits per character that a window must reach, by class.
THRESHOLDS = {"entropy_hex": 3.1, "entropy_mixed": 3.85}
#: Words in camel case have this many letters on average at least; random letters of both cases have about 2.7.
WORD = 3.5
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
ALLOWED = re.compile(
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|EXAMPLE|^(sha(1|256|384|512)|md5)-", re.A
)
ALLOWED_BEFORE = re.compile(r"(?:sha-?(?:1|256|384|512)|md5|commit|checksum|digest|integrity)[\"']?\s*[:=]?\s*[\"']?$", re.A | re.I)

_CLASS = np.zeros(256, bool)
_CLASS[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True
_TERM = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]


def wordy(s: str) -> bool:
    """Whether the letters of ``s`` read as words: no mixed case, or words in camel case of ``WORD`` letters on average."""
    letters = sum(map(str.isalpha, s))
    return s.lower() == s or s.upper() == s or letters >= WORD * len(CAMEL.findall(s))


def window_spans(s: str, window: int = WINDOW, plain: bool = False) -> list[Span]:
    """Spans within the candidate ``s`` whose windows reach the threshold and hold letters and digits; ``plain``: letters will do."""
    kind = "entropy_hex" if re.fullmatch(r"[0-9a-fA-F]+", s) else "entropy_mixed"
    most = log2(window) * window - THRESHOLDS[kind] * window
    counts: dict[str, int] = {}
    total, digits, letters = 0.0, 0, 0
    out: list[Span] = []
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += _TERM[n + 1] - _TERM[n]
        digits += c.isdigit()
        letters += c.isalpha()
        if i >= window:
            o = s[i - window]
            n = counts[o]
            counts[o] = n - 1
            total += _TERM[n - 1] - _TERM[n]
            digits -= o.isdigit()
            letters -= o.isalpha()
        if i >= window - 1 and (digits or plain) and letters and total <= most + 1e-9:
            lo = i - window + 1
            if out and lo <= out[-1][2]:
                out[-1] = (kind, out[-1][1], i + 1)
            else:
                out.append((kind, lo, i + 1))
    return out


def union(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the ranges that ``spans`` cover, in order and apart."""
    starts, stops = [], []
    for _, a, b in sorted(spans, key=lambda x: x[1]):
        if stops and a <= stops[-1]:
            stops[-1] = max(stops[-1], b)
        else:
            starts.append(a)
            stops.append(b)
    return starts, stops


def outside(lo: int, hi: int, starts: list[int], stops: list[int]) -> list[tuple[int, int]]:
    """What the ranges leave of the one from ``lo`` to ``hi``."""
    out, k = [], bisect_right(stops, lo)
    while k < len(starts) and starts[k] < hi:
        if lo < starts[k]:
            out.append((lo, starts[k]))
        lo, k = stops[k], k + 1
    return [*out, (lo, hi)] if lo < hi else out


def scan(text: str, runs: list[tuple[int, int]]) -> list[Span]:
    """All spans of ``text``, by start and then kind; ``runs``: its candidates as code point ranges."""
    low = text.lower()
    base: list[Span] = []
    if "token" in low or "secret" in low or "passw" in low or "api" in low:
        base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    added: list[Span] = []
    for lo, hi in runs:
        s = text[lo:hi]
        base += [("access", lo + m.start(), lo + m.end()) for m in ACCESS.finditer(s) if len(m[0]) >= 20]
        base += [("hex", lo + m.start(), lo + m.end()) for m in HEX.finditer(s) if len(m[0]) >= 24]
        if ALLOWED.search(s) or ALLOWED_BEFORE.search(text[max(0, lo - 24) : lo]):
            continue
        added += [(k, lo + a, lo + b) for k, a, b in window_spans(s, plain=not wordy(s))]
    covered = union(base)
    added = [(k, *part) for k, a, b in added for part in outside(a, b, *covered)]
    return sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def batch_runs(texts: list[bytes], least: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For each text its candidate runs as code point ranges; all texts are searched at once."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    ok = np.concatenate(([False], _CLASS[data], [False]))
    edge = np.flatnonzero(ok[1:] != ok[:-1])
    lo, hi = edge[::2], edge[1::2]
    long = hi - lo >= least
    lo, hi = lo[long], hi[long]
    first = np.cumsum([0, *(len(t) + 1 for t in texts)])
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    own = np.searchsorted(first, lo, "right") - 1
    for k, a, n in zip(own.tolist(), (lead[lo] - lead[first[own]]).tolist(), (hi - lo).tolist()):
        out[k].append((a, a + n))
    return out


def scan_batch(texts: list[bytes]) -> list[list[Span]]:
    return [scan(t.decode(), r) for t, r in zip(texts, batch_runs(texts))]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) for each row; code points, end exclusive.

    Null and empty texts have no spans; a null doc_id stays null; repeated rows come out as often as
    they came in; an empty table gives none; further columns are not read. Overlapping spans of different
    base kinds all stay; equal starts are ordered by kind.
    """
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in scan_batch(utf8(b.column(1)))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(found, struct)], ["doc_id", "spans"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(slim, run, "doc_id long, spans array<struct<kind string, start long, end long>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans and the list of all."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact_text(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for _, lo, hi in sorted(spans, key=lambda s: s[1:]):
        if lo >= at:
            out += [text[at:lo], mark]
        at = max(at, hi)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", mark: str = "<secret>") -> DataFrame:
    """``docs`` with each secret replaced by ``mark`` and ``length_col``, if present, brought up to date.

    Rows without secrets are unchanged, a null text included; repeated rows come out as often as they came in; an empty table gives none.
    """
    names, at = docs.columns, docs.columns.index(text_col)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column(at).to_pylist()
        out = [t if not s else redact_text(t, s, mark) for t, s in zip(texts, scan_batch(utf8(b.column(at))))]
        cols = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(b.columns)]
        return pa.RecordBatch.from_arrays(cols, names)

    clean = arrow_map(docs, run, docs.schema)
    if length_col in docs.columns:
        clean = clean.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return clean
