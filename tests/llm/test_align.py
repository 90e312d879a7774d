import base64
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from strataq.llm import align, bpe

A, B = bpe.path("byte_bpe_50k.json"), bpe.path("piece_bpe_32k.model")
ODD = ["a", "b ", " ", "  ", "\n", "'", "s", "'ll", "é", "1", "23", "!", "\xa0", " ", "<s>", "<unk>", "▁", "the", " The", "\x1c", "\x85", "字", "ﬁ", "́", "​", "𝒳", "\t", "<|endoftext|>", ".", "http://x", "<0x41>", "word word", "\x00"]


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    raw = {int(i): base64.b64decode(t) for t, i in map(bytes.split, open(bpe.path("byte_bpe_50k.tiktoken"), "rb"))} | {50256: b"<|endoftext|>"}

    def tokens(text):
        """[(id, start, end)] of A and of B, or two empty lists."""
        if not text:
            return [], []
        of_a = [(i, raw[i]) for i in a.encode(f" {text}", add_special_tokens=False).ids]
        of_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = f" {text}".encode()
        if b"".join(x for _, x in of_a) != whole or b"".join(x for _, x in of_b) != whole:
            return [], []
        out = []
        for side in (of_a, of_b):
            at, placed = 0, []
            for i, x in side:
                placed.append((i, at, at + len(x)))
                at += len(x)
            out.append(placed)
        return out

    return tokens


def brute(rows, tokens):
    found = [(d, *tokens(t)) for d, t in rows]
    links = [[(i, j) for i, s, e in a for j, x, y in b if s < y and x < e] if len(a) < 400 else swept(a, b) for _, a, b in found]
    count = Counter(p for each in links for p in each)
    most = Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = []
    for (d, a, b), each in zip(found, links):
        groups, left_a, left_b = [], list(a), list(b)
        for end in sorted({e for *_, e in a} & {e for *_, e in b}):
            mine = [[str(i) for i, _, e in side if e <= end] for side in (left_a, left_b)]
            left_a, left_b = ([x for x in side if x[2] > end] for side in (left_a, left_b))
            groups.append("|".join(map(",".join, mine)))
        told = ";".join(groups)
        sha = hashlib.sha256(told.encode()).hexdigest() if a else ""
        out.append((d, len(a), len(b), len(groups), len(each), sum(count[p] == most[p[1]] for p in each), sum(count[p] for p in each), sha))
    return sorted(out, key=repr)


def swept(a, b):
    out, k = [], 0
    for i, s, e in a:
        while b[k][2] <= s:
            k += 1
        m = k
        while m < len(b) and b[m][1] < e:
            out.append((i, b[m][0]))
            m += 1
    return out


def measured(df):
    return sorted((tuple(r) for r in align.measure(df, A, B, shards=5).collect()), key=repr)


def test_measures(spark, docs_of, odd_rows, plain):
    r = random.Random(7)
    rows = [*odd_rows[:5], *odd_rows[6:], *((100 + k, "".join(r.choice(ODD) for _ in range(r.randrange(30))), "x") for k in range(400))]
    rows += [(900 + k, " ".join(r.choice(["of", "the", "Straße", "token", "x1y2", "don't"]) for _ in range(k)), "y") for k in range(60)]
    rows.append((2000, "long " * 150 + "z" * 300, "y"))
    short = [(d, t if t is None or len(t) < 5000 else t[:700], s) for d, t, s in rows]
    assert measured(docs_of(short)) == brute([(d, t) for d, t, _ in short], plain)


def test_long_text_and_empty_table(spark, docs_of):
    text = "lorem ipsum dolor sit amet, " * 20_000
    ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, open(bpe.path("byte_bpe_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    (row,) = measured(docs_of([(1, text, "a")]))
    assert row[1] == len(own.encode_ordinary(f" {text}")) and row[2] == len(SentencePieceProcessor(model_file=B).encode(text))
    assert measured(docs_of([])) == []


def test_pieces_encode_as_whole_texts(plain):
    both, r = align.pair(A, B), random.Random(3)
    cut = 0
    for _ in range(4000):
        text = "".join(r.choice(ODD) for _ in range(r.randrange(1, 16)))
        pieces = both.pieces(text)
        assert " " + " ".join(pieces) == f" {text}"
        a, b = plain(text)
        assert both.documents([text, "", text]).counts[:, :2].tolist() == [[len(a), len(b)], [0, 0], [len(a), len(b)]], text
        cut += len(pieces) > 1
    assert cut > 500


def test_groups_and_links(spark, docs_of, plain):
    rows = [(1, "hello world", "a"), (2, "x▁y", "a"), (3, None, "a"), (4, "unbelievable 字", "a")]
    got = {r.doc_id: r for r in align.groups(docs_of(rows), A, B).collect()}
    a, b = plain("unbelievable 字")
    sides = [[p.split("|") for p in got[4].groups.split(";")]]
    assert [i for g in sides[0] for i in g[0].split(",")] == [str(i) for i, *_ in a] and [i for g in sides[0] for i in g[1].split(",")] == [str(i) for i, *_ in b]
    assert got[2].groups == got[3].groups == "" and got[2].n_links == 0
    table = align.links(docs_of(rows), A, B).collect()
    assert sum(r.n for r in table) == sum(r.n_links for r in got.values()) and len({(r.a, r.b) for r in table}) == len(table)
    for r in table:
        assert r.best == (r.n == max(x.n for x in table if x.b == r.b))


def test_sums_merge_as_they_come():
    s, want, r = align.Sums(), Counter(), np.random.default_rng(0)
    for _ in range(50):
        keys = np.unique(r.integers(0, 50_000, 9000))
        totals = r.integers(1, 9, len(keys))
        want.update(dict(zip(keys.tolist(), totals.tolist())))
        s.add(keys.tobytes(), totals.tobytes())
    s.merge()
    assert dict(zip(s.keys.tolist(), s.totals.tolist())) == dict(want)
