import random

import numpy as np

from strataq.llm import lm


def sentences(rnd, n):
    """Words in a fixed grammar, so that neighbours tell a word."""
    out = []
    for _ in range(n):
        out += [rnd.choice(["the", "a"]), rnd.choice(["red", "big", "old"]), rnd.choice(["dog", "cat", "bird"]), rnd.choice(["eats", "sees"]), "and", "then"]
    return out


def test_training_beats_shuffled_text(docs_of, odd_rows):
    rnd = random.Random(1)
    rows = [(1000 + i, " ".join(sentences(rnd, 60)), "a") for i in range(300)]
    model = lm.fit(lm.numbered(docs_of(rows + odd_rows)), rate=0.02, batch=512)
    probe = []
    for i in range(40):
        w = sentences(rnd, 40)
        s = list(w)
        rnd.shuffle(s)
        probe += [(2 * i, " ".join(w), "a"), (2 * i + 1, " ".join(s), "a")]
    got = {r.doc_id: r.mean_score for r in model.score(lm.numbered(docs_of(probe))).collect()}
    assert sum(got[2 * i] > got[2 * i + 1] + 0.5 for i in range(40)) >= 39
    odd = model.score(lm.numbered(docs_of(odd_rows))).collect()
    assert len(odd) == len(odd_rows)
    assert [(r.n_words, r.score, r.mean_score, r.mean_apart) for r in odd if r.doc_id in (1, 2, 7)] == [(0, 0.0, None, None)] * 3


def test_query_equals_brute_force(docs_of, odd_rows):
    """Numbers, counts, shards, training and scores again, one document and one window at a time."""
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 60))), "a") for i in range(60)] + odd_rows[:5]
    table = lm.numbered(docs_of(rows), shard_bytes=2000)
    kw = {"own": 4, "batch": 64, "pool": 300}
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.score, r.mean_score, r.mean_apart, r.n_alone) for r in lm.fit(table, **kw).score(table).collect())
    known = lm.Numbers()
    words = {k: [known[w] for w in (t or "").encode().lower().split()] for k, (_, t, _) in enumerate(rows)}
    n = np.zeros(lm.NUMBERS, np.int64)
    for ws in words.values():
        for w in ws:
            n[w] += 1
    top = sorted(np.flatnonzero(n), key=lambda w: (-n[w], w))[:4]
    cls = {int(w): 1 + top.index(w) if w in top else 5 + (int(w) >> lm.WORD) for w in np.flatnonzero(n)}
    params = lm.start(5 + 32, 24, 0)
    of = lm.Classes(n, 4).of
    assert all(of[w] == c for w, c in cls.items())
    shards = [(r.shard, np.frombuffer(r.ids, "<u4")) for r in sorted(table.collect(), key=lambda r: (r.shard, r.order))]
    assert len({s for s, _ in shards}) > 1
    for turn in range(2):
        made = list(lm.train(iter(shards), of, params, turn, 2, 64, 300, 0.01, 0))
        params = lm.shaped(sum(p.astype(float) * s for s, p in made) / sum(s for s, _ in made), params)
    want = []
    for k, (d, _, _) in enumerate(rows):
        ws, total, apart = words[k], 0.0, 0.0
        for i, w in enumerate(ws):
            ctx = [cls[ws[i + j]] if 0 <= i + j < len(ws) else 0 for j in lm.PLACES]
            h = np.tanh(params["b"] + sum(params["e"][p][c] for p, c in enumerate(ctx)))
            z = (h @ params["u"] + params["c"]).astype(float)
            base = z[cls[w]] - np.log(np.exp(z).sum())
            same = [v for v in cls if cls[v] == cls[w]]
            down = sum(int(n[v]) for v in same) + lm.ALPHA * len(same)
            total += base + np.log((n[w] + lm.ALPHA) / down)
            apart += base + np.log((n[w] - ws.count(w) + lm.ALPHA) / down)
        m = max(1, len(ws))
        alone = sum(n[w] == ws.count(w) for w in ws)
        want.append((d is not None, d or 0, len(ws), total, total / m if ws else None, apart / m if ws else None, alone))
    for g, w in zip(got, sorted(want, key=lambda x: x[:4])):
        assert g[:3] == w[:3] and all(abs((a or 0) - (b or 0)) < 2e-3 for a, b in zip(g[3:], w[3:])), (g, w)


def test_scores_do_not_depend_on_partitions(docs_of):
    rnd = random.Random(3)
    docs = docs_of([(i, " ".join(sentences(rnd, 20)), "a") for i in range(300)])
    scores = []
    for n in (2, 8):
        table = lm.numbered(docs.repartition(n), shard_bytes=9000)
        assert table.select("shard").distinct().count() > 2
        scores.append({r.doc_id: r.score for r in lm.fit(table, batch=256, pool=2000).score(table.repartition(n)).collect()})
    assert all(abs(s - scores[1][d]) <= 1e-5 * abs(s) for d, s in scores[0].items())


def test_documents_that_occur_twice_stand_out(docs_of):
    rnd = random.Random(4)
    text = lambda i: " ".join(w if rnd.random() < 0.9 else f"{w}{rnd.getrandbits(40):x}" for w in sentences(rnd, 25))
    rows = [(i, text(i), "a") for i in range(400)]
    rows += [(1000 + i, rows[i][1], "b") for i in range(40)]
    table = lm.numbered(docs_of(rows))
    rows = lm.fit(table).score(table).collect()
    assert all((r.n_alone == 0) == (r.doc_id < 40 or r.doc_id >= 1000) for r in rows)
    got = {r.doc_id: r.mean_apart for r in rows}
    bar = sorted(got[i] for i in range(40, 400))[-36]  # one false alarm in ten
    assert sum(got[i] > bar for i in range(40)) >= 30


def test_gradients():
    rnd = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lm.start(7, 3, 0).items()}
    ctx, want = rnd.integers(0, 7, (4, 50)), rnd.integers(0, 7, 50)

    def loss(q):
        _, z = lm.forward(q, ctx)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(50), want]))

    before = loss(p)
    adam = lm.Adam({k: v.copy() for k, v in p.items()}, 0.02)
    for _ in range(30):
        adam.step(ctx, want)
    assert loss(adam.p) < before - 0.1


def test_empty(docs_of, odd_rows):
    none = lm.numbered(docs_of(odd_rows).limit(0))
    assert lm.fit(none).score(none).count() == 0


def test_every_window_is_trained_on_once(docs_of):
    for rounds in range(1, 5):
        assert (sum(lm.turns(50, r, rounds).astype(int) for r in range(rounds)) == 1).all()
    seen = []

    class Recorder(lm.Adam):
        def step(self, ctx, want):
            seen.extend(want.tolist())

    of = np.arange(1, 100).astype(np.int16)
    adam, lm.Adam = lm.Adam, Recorder
    try:
        for turn in range(2):
            assert sum(n for n, _ in lm.train(iter([(0, np.arange(30, dtype="<u4")), (1, np.arange(30, 99, dtype="<u4"))]), of, lm.start(100, 3, 0), turn, 2, 8, 20, 0.1, 0)) in (49, 50)
    finally:
        lm.Adam = adam
    assert sorted(seen) == list(range(1, 100))
