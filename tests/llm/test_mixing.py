import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from strataq.llm import mixing


def brute_targets(size, weights=(5, 2, 1)):
    """Shares by weight; what is above its cap is set to it, and the excess shared by weight among the rest, again and again."""
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    rest, left, out = set(order), 1.5 * sum(size.values()), {}
    while rest:
        total = sum(w[s] for s in rest)
        over = {s for s in rest if left * w[s] / total > 2 * size[s]}
        if not over:
            return out | {s: left * w[s] / total for s in rest}
        for s in over:
            out[s] = 2.0 * size[s]
        left -= sum(out[s] for s in over)
        rest -= over
    return out


def brute_seats(votes, n):
    seats = Counter()
    for _ in range(n):
        best = max(sorted(votes), key=lambda p: votes[p] / (2 * seats[p] + 1))
        seats[best] += 1
    return seats


def corpus():
    rnd = random.Random(6)
    rows = []
    for i in range(300):
        s = rnd.choice(["a"] * 6 + ["b", "c", "é", "z", None])
        rows.append((i, " ".join(f"w{i}x{k}" for k in range(rnd.choice([0, 1, 5, 30, 200]))), s))
    rows += [(None, "no id but words", "a"), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (900, None, "b"), (901, "  \n", "q")]
    return rows


def test_targets_and_takes(docs_of):
    rows = corpus()
    size = defaultdict(int)
    for _, t, s in rows:
        size[s] += len((t or "").split())
    want = brute_targets(size)
    for kw in ({}, {"shard_tokens": 500, "most_block": 16}):
        got = mixing.mix(docs_of(rows), **kw).collect()
        again = mixing.mix(docs_of(rows), **kw).collect()
        assert Counter(map(tuple, got)) == Counter(map(tuple, again))
        assert Counter(r.doc_id for r in got) == Counter(d for d, _, _ in rows)
        assert all(0 <= r.taken <= 2 * r.size for r in got)
        by_target = defaultdict(lambda: [0, 0])
        for r in got:
            by_target[round(r.target, 6), r.source_size][0] += r.taken
        for s, n in size.items():
            took = by_target[round(want[s], 6), n][0]
            assert abs(took - want[s]) <= max(20, 0.02 * want[s]), (s, took, want[s])


def test_documents_are_what_was_taken(docs_of):
    rows = corpus()
    m = mixing.Mix(docs_of(rows), shard_tokens=500)
    taken = Counter()
    for r in m.take().collect():
        taken[r.doc_id] += r.taken
    out = m.documents().collect()
    got = Counter()
    texts = defaultdict(list)
    for d, t, _ in rows:
        texts[d].append(t or "")
    for r in out:
        got[r.doc_id] += len(r.text.split())
        assert any(set(r.text.split()) <= set(t.split()) for t in texts[r.doc_id])
    assert got == Counter({d: n for d, n in taken.items() if n})
    assert out[0].asDict().keys() == set(docs_of(rows).columns)


def test_empty_and_wordless(docs_of):
    assert mixing.mix(docs_of([(1, "x", "a")]).limit(0)).count() == 0
    r = mixing.mix(docs_of([(1, "", "a"), (2, None, None)])).collect()
    assert sorted((x.doc_id, x.size, x.target, x.taken) for x in r) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_sainte_lague_equals_seat_by_seat(spark):
    rnd = random.Random(1)
    groups = {g: ({p: rnd.choice([0, 1, rnd.randint(1, 50), rnd.randint(1, 5000)]) for p in range(rnd.randint(1, 12))}, rnd.choice([0, 1, 7, 100, 333])) for g in range(40)}
    rows = [(g, p, v, n) for g, (votes, n) in groups.items() for p, v in votes.items()]
    df = spark.createDataFrame(rows, "g long, p long, votes long, house long")
    got = {(r.g, r.p): r.seats for r in mixing.sainte_lague(df, ["g"], "p", "votes", "house").collect()}
    for g, (votes, n) in groups.items():
        some = {p: v for p, v in votes.items() if v}
        want = brute_seats(some, n) if some else {}
        assert {p: got[g, p] for p in votes} == {p: want.get(p, 0) for p in votes}, (g, votes, n)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=8))
def test_brute_targets_are_within_caps(sizes):
    t = brute_targets(dict(enumerate(map(int, sizes))) and {chr(97 + k): n for k, n in enumerate(sizes)})
    assert abs(sum(t.values()) - 1.5 * sum(sizes)) < 1e-6 and all(t[chr(97 + k)] <= 2 * n + 1e-9 for k, n in enumerate(sizes))


def test_small_sources_beside_a_large_one(docs_of):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(1000)), "large") for i in range(300)]
    small = {"s1": 3, "s2": 40, "s3": 130, None: 9}
    rows += [(1000 + k, " ".join(f"v{k}x{j}" for j in range(n)), s) for k, (s, n) in enumerate(small.items())]
    for block in (64, 512):
        got = {r.doc_id: r for r in mixing.mix(docs_of(rows), most_block=block, blocks_a_source=1).collect()}
        for k in range(len(small)):
            r = got[1000 + k]
            assert r.target == 2 * r.size and abs(r.taken - r.target) <= 0.02 * r.target, r  # small ones are at their cap


def test_other_caps(docs_of):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(50)), s) for s in ("a", "b") for i in range(40)]
    for cap, share in ((3.0, 2.5), (1.5, 1.4)):
        m = mixing.Mix(docs_of(rows), cap=cap, share=share, most_block=10)
        taken, total = m.take().collect(), sum(len(r.text.split()) for r in m.documents().collect())
        assert total == sum(r.taken for r in taken) and abs(total - share * 4000) <= 40
        by = defaultdict(int)
        for r in taken:
            by[round(r.target)] += r.taken
        assert all(abs(n - t) <= 25 for t, n in by.items())


def test_shards_in_groups(docs_of):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20)), "a") for i in range(400)]
    m = mixing.Mix(docs_of(rows), shard_tokens=100, shards_a_group=7, most_block=10, share=0.7)
    assert abs(sum(r.taken for r in m.take().collect()) - 0.7 * 8000) <= 0.02 * 5600
    assert m.quotas.selectExpr("max(abs(quota - 0.7 * blocks))").first()[0] <= 4
