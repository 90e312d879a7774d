"""BPE encoding and decoding of whole texts with a public tokenizer, by tree concatenation.

A text of more than ``leaf`` characters is halved until its parts are no longer than that. The parts of all texts of a batch
are encoded together. Going up the tree, a window around each join is encoded again
and grows until it holds, left and right of the join, two tokens running that both encodings have with equal places
and ids. What lies left of the first is kept from the left half, what lies right of the second from the right half. If the window
has grown over both halves, its encoding is the result.

The tokens of this tree are the tokenizer's own pre-tokens, whose ids come from the model and stay in a worker's bounded cache. Where a pre-token begins
depends on the text before it only through the end of the one before, so two scans that share an end agree from there on. A
pre-token that is itself longer than ``leaf`` (a base64 blob, a text in a script without spaces) is a tree of its own: the tokenizers
library encodes its parts, and each level's windows, in parallel batches, and the tokens are those of the vocabulary. Byte pair encoding is local there: a sequence of tokens is the encoding of its text just if each
two neighbours are, and every pair of neighbours in the spliced sequence occurs in an encoding.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import arrow_map, collector_paused

#: Pieces kept by one worker, fewer where texts are kept with them; the cache starts anew beyond that.
CACHE = 450_000
#: Characters of the parts that a text's tree, and that a long pre-token's tree ends in.
PART, LEAF = 8192, 2048


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(file: str, threads: int = 1):
    """The tokenizer in ``file``, whose batches run on ``threads`` threads of this worker; padding and truncation are off."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(file)
    t.no_padding()
    t.no_truncation()
    return t


# ---------------------------------------------------------------- tree concatenation

#: (start, end, value) of the tokens of a part, in order.
Tokens = list[tuple]
#: Encodes parts of texts, given as (text, start, end), each as a text of its own.
Parts = Callable[[list[tuple[str, int, int]]], list[Tokens]]


def by_library(tok) -> Parts:
    """Parts to the vocabulary's tokens, in one batch of the library."""

    def encode(parts: list[tuple[str, int, int]]) -> list[Tokens]:
        made = tok.encode_batch([t[a:b] for t, a, b in parts], add_special_tokens=False)
        return [[(x + a, y + a, i) for (x, y), i in zip(e.offsets, e.ids)] for e, (_, a, _) in zip(made, parts)]

    return encode


def _meet(old: Tokens, new: Tokens, lo: int, hi: int, first: bool) -> tuple[int, int] | None:
    """Indexes in both of a token within [lo, hi] that starts two equal tokens running, the first or last such."""
    at = {x[0]: k for k, x in reversed(list(enumerate(new)))}
    from_, to = bisect_left(old, lo, key=_START), bisect_right(old, hi, key=_START)
    ks = range(from_, min(to, len(old) - 1))
    for k in ks if first else reversed(ks):
        if old[k + 1][1] > hi:
            if first:
                return None
            continue
        j = at.get(old[k][0])
        while j is not None and j + 1 < len(new) and new[j][0] == old[k][0]:
            if new[j] == old[k] and new[j + 1] == old[k + 1]:
                return k, j
            j += 1
    return None


_START = itemgetter(0)


def _spliced(left: Tokens, right: Tokens, new: Tokens, a: int, b: int, lo: int, mid: int, hi: int) -> Tokens | None:
    """Left half, window and right half as one, or None if the window from a to b must grow."""
    if a == lo and b == hi:
        return new
    # Tokens at the window's own edges are as doubtful as those at the join: look between the two.
    x = (0, 0) if a == lo else _meet(left, new, a + (mid - a) // 4, mid - (mid - a) // 4, True)
    y = (len(right), len(new)) if b == hi else _meet(right, new, mid + (b - mid) // 4, b - (b - mid) // 4, False)
    return left[: x[0]] + new[x[1] : y[1]] + right[y[0] :] if x and y else None


class Tree:
    """The parts of one text and their encodings, on the way up."""

    def __init__(self, text: str, leaf: int) -> None:
        bounds = [0, len(text)]
        while bounds[1] - bounds[0] > leaf:
            bounds = sorted({*bounds, *((a + b) // 2 for a, b in zip(bounds, bounds[1:]))})
        self.text, self.spans, self.parts = text, list(zip(bounds, bounds[1:])), []


def tree_encode_batch(encode: Parts, texts: list[str], leaf: int, window: int = 128) -> list[Tokens]:
    """Tokens of each text by tree concatenation; the parts of all texts are one batch, and so are the windows of a level."""
    trees = [Tree(t, leaf) for t in texts]
    made = iter(encode([(t.text, *s) for t in trees for s in t.spans]))
    for t in trees:
        t.parts = [next(made) for _ in t.spans]
    while any(len(t.parts) > 1 for t in trees):
        waiting = [(t, k, window) for t in trees for k in range(0, len(t.parts) - 1, 2)]
        done: dict[tuple[int, int], Tokens] = {}
        while waiting:
            spans = []
            for t, k, w in waiting:
                mid = t.spans[k][1]
                spans.append((t.text, max(t.spans[k][0], mid - w), min(t.spans[k + 1][1], mid + w)))
            again = []
            for (t, k, w), (_, a, b), new in zip(waiting, spans, encode(spans)):
                (lo, mid), hi = t.spans[k], t.spans[k + 1][1]
                whole = _spliced(t.parts[k], t.parts[k + 1], new, a, b, lo, mid, hi)
                if whole is None:
                    again.append((t, k, 2 * w))
                else:
                    done[id(t), k] = whole
            waiting = again
        for t in trees:
            n = len(t.parts)
            t.parts = [done.get((id(t), k), t.parts[k]) for k in range(0, n, 2)]
            t.spans = [(t.spans[k][0], t.spans[min(k + 1, n - 1)][1]) for k in range(0, n, 2)]
    return [t.parts[0] for t in trees]


def tree_encode(tok, text: str, leaf: int = LEAF, window: int = 128) -> list[int]:
    """Ids of ``text`` by tree concatenation of the vocabulary's tokens."""
    return [t[2] for t in tree_encode_batch(by_library(tok), [text], leaf, window)[0]]


# ---------------------------------------------------------------- cached pieces


def byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


LETTERS = byte_letters()


#: Letters and numbers of Latin-1, and its white space.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_SHORT = "'(?:s|t|re|ve|m|ll|d)"
#: The tokenizers' own pre-token patterns for texts within Latin-1; what can't match at the same place is put in the order of frequency.
SPACED = re.compile(rf" ?[{_L}]+|{_SHORT}| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
DROPPED = re.compile(rf"[{_L}]+|{_SHORT}|[{_N}]|[^{_S}{_L}{_N}]+")


class Pieces(dict):
    """Cache from a piece of text to ``value(ids)``, by whole encodings."""

    def __init__(self, tok, value, size: int = CACHE, leaf: int = LEAF) -> None:
        self.tok, self.value, self.size, self.leaf = tok, value, size, leaf

    def ids(self, piece: str) -> list[int]:
        return tree_encode(self.tok, piece, self.leaf) if len(piece) > self.leaf else self.tok.encode(piece, add_special_tokens=False).ids

    def __missing__(self, piece: str):
        out = self.value(self.ids(piece))
        if len(piece) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[piece] = out
        return out

    def values(self, pieces: list[str]) -> Iterable:
        """Values of short pieces, encoded in one parallel batch."""
        return (self.value(e.ids) for e in self.tok.encode_batch(pieces, add_special_tokens=False))

    def fill(self, pieces: Iterable[str]) -> None:
        """Encode what is missing of ``pieces`` together."""
        every = {p for p in pieces if len(p) <= 64}
        missing = [p for p in every if p not in self]
        if len(self) + len(missing) > self.size:
            self.clear()
            missing = list(every)
        self.update(zip(missing, self.values(missing)))

    def by_pieces(self, pattern: re.Pattern) -> Parts:
        """Parts to the pieces of ``pattern``."""

        def encode(parts: list[tuple[str, int, int]]) -> list[Tokens]:
            cut = [[(a + m.start(), a + m.end(), m[0]) for m in pattern.finditer(t[a:b])] for t, a, b in parts]
            self.fill(p for part in cut for _, _, p in part)
            return [[(a, b, self[p]) for a, b, p in part] for part in cut]

        return encode


class Pretokens(Pieces):
    """The same for pre-tokens within Latin-1 that no normaliser changes any more: the model itself encodes them."""

    def ids(self, piece: str) -> list[int]:
        if len(piece) > self.leaf:
            return tree_encode(self.tok, piece, self.leaf)
        if piece.isascii() and piece.removeprefix(" ").isalnum():
            return [t.id for t in self.tok.model.tokenize(piece.replace(" ", LETTERS[32]))]
        return [t.id for t in self.tok.model.tokenize(piece.encode().decode("latin-1").translate(LETTERS))]

    def values(self, pieces: list[str]) -> Iterable:
        """Values of short pieces; the model alone costs less than the library's batches do."""
        return (self.value(self.ids(p)) for p in pieces)


class Encoder:
    """Encodes texts by cached pieces; ``spaced``: whether the tokenizer keeps white space, or drops it and lower-cases."""

    def __init__(self, file: str, kind: str, spaced: bool, threads: int = 1) -> None:
        tok = load(file, threads)
        value = KINDS[kind](tok)
        size = CACHE if kind == "packed" else CACHE // 3
        self.pre, self.whole, self.spaced = Pretokens(tok, value, size), Pieces(tok, value, size // 8), spaced

    def rule(self, text: str) -> tuple[str, re.Pattern, Pieces]:
        """The text to cut, its pieces' pattern and their cache."""
        if "<|" not in text:  # where special tokens' strings begin
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                pass
            else:
                return (text, SPACED, self.pre) if self.spaced else (text.lower(), DROPPED, self.pre)
        return text, PARTS if self.spaced else WORDS, self.whole

    def __call__(self, text: str) -> list:
        """Values of the text's pieces in order."""
        text, pattern, cache = self.rule(text)
        return [cache[p] for p in pattern.findall(text)]

    def batch(self, texts: list[str], leaf: int = PART) -> list[list]:
        """The same for many texts: short ones and the parts of long ones are looked up and encoded together."""
        ruled = [self.rule(t) for t in texts]
        out: list[list] = [[] for _ in texts]
        for cache in (self.pre, self.whole):
            own = [k for k, r in enumerate(ruled) if r[2] is cache]
            short = [(k, ruled[k][1].findall(ruled[k][0])) for k in own if len(ruled[k][0]) <= leaf]
            cache.fill(p for _, pieces in short for p in pieces)
            for k, pieces in short:
                out[k] = [cache[p] for p in pieces]
            long = [k for k in own if len(ruled[k][0]) > leaf]
            for k, tokens in zip(long, tree_encode_batch(cache.by_pieces(ruled[long[0]][1]), [ruled[k][0] for k in long], leaf) if long else ()):
                out[k] = [t[2] for t in tokens]
        return out


#: Where a text may be cut for tokenizers that drop white space: between ASCII white space.
WORDS = re.compile(r"[^ \t-\r]+")
#: For tokenizers that hang one space before a word: before a single space that stands between what is no white space of any kind.
#: What Python takes for white space includes all that the tokenizers take for it.
PARTS = re.compile(r"(?:\s+\S*|\S+)(?:(?: \s+|[^\S ]\s*| \Z)\S*)*")


FEW = [struct.Struct(f"<{n}I") for n in range(24)]
#: What is kept of a piece's ids, by kind. Decoding puts a space between tokens, so decoded pieces join by one too.
KINDS = {
    "ids": lambda tok: lambda x: x,
    "text": lambda tok: lambda x: (x, tok.decode(x, skip_special_tokens=False)),
    "hash": lambda tok: lambda x: (len(x), " ".join(map(str, x)), tok.decode(x, skip_special_tokens=False)),
    "packed": lambda tok: lambda x: (FEW[len(x)] if len(x) < len(FEW) else struct.Struct(f"<{len(x)}I")).pack(*x),
}
_ENCODERS: dict = {}


def worker_encoder(file: str, kind: str, spaced: bool, threads: int = 1) -> Encoder:
    """The encoder of this Python worker, which outlives a task."""
    key = (file, kind, spaced, threads)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(file, kind, spaced, threads)
    return _ENCODERS[key]


# ---------------------------------------------------------------- operator


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, threads: int = 2) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for each row, for tokenizers that drop white space.

    ``tokenizer`` is a file of the tokenizers library. With ``ids=False`` the two are given as
    (n_tokens, ids_sha256, decoded_sha256) instead, so that the texts need not leave the worker. Batches of the library
    run on ``threads`` threads of a task.
    Null and empty texts have no ids and decode to the empty string; a null doc_id stays null;
    repeated rows come out as often as they came in; further columns are not read.
    """
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        with collector_paused():
            rows = worker_encoder(tokenizer, "text" if ids else "hash", False, threads).batch([t or "" for t in b.column(1).to_pylist()])
        decoded = [" ".join(x[-1] for x in r if x[0]) for r in rows]
        if ids:
            cols = [pa.array([[i for x in r for i in x[0]] for r in rows], pa.list_(pa.int32())), pa.array(decoded)]
            return pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "ids", "decoded"])
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        cols = [
            pa.array([sum(x[0] for x in r) for r in rows], pa.int64()),
            pa.array([sha(" ".join(x[1] for x in r if x[0])) for r in rows]),
            pa.array([sha(d) for d in decoded]),
        ]
        return pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    out = "ids array<int>, decoded string" if ids else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, f"doc_id long, {out}")
