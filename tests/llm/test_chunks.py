import random
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.llm import chunks


def brute_gear(data):
    h, out = 0, []
    for b in data:
        h = (h << 1) + int(chunks.GEAR[b]) & 0xFFFFFFFF
        out.append(h)
    return out


def test_gear_equals_rolling():
    data = bytes(random.Random(1).randrange(256) for _ in range(300))
    assert chunks.gear(np.frombuffer(data, np.uint8)).tolist() == brute_gear(data)


def brute_ends(data, reach=chunks.REACH):
    h, n = brute_gear(data), len(data)
    e = {n}
    for i in range(n):
        if all(h[i] > x for x in h[max(0, i - reach) : i]) and all(h[i] >= x for x in h[i + 1 : i + 1 + reach]):
            p = i + 1
            while p < n and data[p] & 0xC0 == 0x80:
                p += 1
            e.add(p)
    return sorted(e)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("abcdefgh éß日\n"), min_size=30, max_size=300))
def test_ends_equal_plain_definition(text):
    data = text.encode()
    assert chunks.ends(data) == brute_ends(data)
    parts = [data[a:b].decode() for a, b in zip([0, *chunks.ends(data)], chunks.ends(data))]
    assert "".join(parts) == text


def test_long_runs_are_cut():
    e = chunks.ends(b"a" * 5000)
    assert e[-1] == 5000 and max(np.diff([0, *e])) <= chunks.MOST
    assert chunks.ends("é".encode() * 3000)[-1] == 6000 and all(x % 2 == 0 for x in chunks.ends("é".encode() * 3000))


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwé") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_passages_are_found_despite_shifts(docs_of, odd_rows):
    rnd = random.Random(7)
    rows, want, clean = list(odd_rows), [], []
    for i in range(60):
        p = prose(rnd, 55)
        for k in range(3):
            before = prose(rnd, rnd.randint(0, 60))
            rows.append((100 + 10 * i + k, f"{before} {p} {prose(rnd, rnd.randint(5, 50))}".strip(), "a"))
            want.append((100 + 10 * i + k, rows[-1][1].index(p), len(p), k))
    for i in range(100):
        clean.append(5000 + i)
        rows.append((5000 + i, prose(rnd, 200), "b"))
    out = defaultdict(list)
    for r in chunks.repeats(docs_of(rows)).collect():
        out[r.doc_id].append(r)
    for d, at, n, k in want:
        (r,) = out[d]
        hit = sum(max(0, min(p.end, at + n) - max(p.start, at)) for p in r.repeated)
        assert hit >= 0.4 * n, (d, hit, n)
        over = sum(p.end - p.start for p in r.repeated) - hit
        assert over <= 12
        assert bool(r.removed) == (k > 0)  # the first stays
    assert not any(r.repeated for d in clean for r in out[d])
    same = {d: out[d][0] for d in (3, 4)}
    assert not same[3].removed and all(r.n_chars == 0 for r in out[1] + out[2])
    assert len(out[3]) == 2 and chunks.repeats(docs_of(rows).limit(0)).count() == 0
    assert [(p.start, p.end) for p in out[6][0].removed] == [(0, out[6][0].n_chars)] and out[5][0].n_chars == len(odd_rows[6][1])


def brute_repeats(rows, least_words=12, least_chars=120):
    """Passages of each distinct (doc_id, text) from a dictionary of chunk strings."""
    docs = sorted({(d is not None, d or 0, t or "") for d, t, _ in rows})
    places = defaultdict(list)
    cut = {}
    for doc in docs:
        data = doc[2].encode()
        e = brute_ends(data) if data else []
        e = chunks.ends(data) if any(b - a > chunks.MOST for a, b in zip([0, *e], e)) else e
        cut[doc] = [data[a:b] for a, b in zip([0, *e], e)]
        at = 0
        for c in cut[doc]:
            places[c].append((doc, at))
            at += len(c.decode())
    out = {}
    for doc, parts in cut.items():
        runs = {0: [], 1: []}
        at = before = 0
        for c in parts:
            begun = sum(1 for k, b in enumerate(c) if b not in b" \t\n\x0b\x0c\r" and (before == 0 if k == 0 and at == 0 else doc[2].encode()[before + k - 1] in b" \t\n\x0b\x0c\r"))
            n = len(c.decode())
            for kind in (0, 1):
                if len(places[c]) > 1 and (kind == 0 or places[c][0] != (doc, at)):
                    if runs[kind] and runs[kind][-1][1] == at:
                        s, _, w = runs[kind][-1]
                        runs[kind][-1] = (s, at + n, w + begun)
                    else:
                        runs[kind].append((at, at + n, begun))
            at, before = at + n, before + len(c)
        out[doc] = [[r for r in runs[k] if r[2] >= least_words or r[1] - r[0] >= least_chars] for k in (0, 1)]
    return out


def test_repeats_equal_brute_force(docs_of, odd_rows):
    rnd = random.Random(11)
    shared = [prose(rnd, rnd.choice([8, 15, 40, 90])) for _ in range(12)]
    rows = list(odd_rows)
    for i in range(120):
        parts = [x for _ in range(rnd.randint(1, 6)) for x in (rnd.choice(shared), prose(rnd, rnd.randint(0, 30)))]
        rows.append((i if i % 40 else None, " ".join(parts), "a"))
    rows += [rows[-1], (500, " ".join(f"{shared[k % 12]} {prose(rnd, 9)}" for k in range(900)), "a")]  # one text with many separate passages
    want = brute_repeats(rows)
    got = chunks.repeats(docs_of(rows, extra=("kind", "run", "d1", "first", "start", "row_key"))).collect()
    by_id = defaultdict(list)
    for d, t, _ in rows:
        by_id[d].append(want[d is not None, d or 0, t or ""])
    assert len(got) == len(rows)
    for d, lists in by_id.items():
        have = [[[tuple(p) for p in x] for x in (r.repeated, r.removed)] for r in got if r.doc_id == d]
        assert sorted(map(str, have)) == sorted(map(str, lists)), d
