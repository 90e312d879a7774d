import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from strataq.llm import simhash


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, budget=3):
    up = list(range(len(ids)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= budget:
                up[root(i)] = root(j)
    best = {}
    for i, d in enumerate(ids):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return [best.get(root(i)) for i in range(len(ids))]


def check(docs, rows, **kw):
    fps = [brute_fingerprint(t) for _, t, _ in rows]
    want = Counter((d, f"{f:016x}", c) for (d, _, _), f, c in zip(rows, fps, brute_components([r[0] for r in rows], fps)))
    assert Counter(map(tuple, simhash.near_duplicates(docs, **kw).collect())) == want


def test_odd_rows(docs_of, odd_rows):
    check(docs_of(odd_rows), odd_rows)
    assert simhash.near_duplicates(docs_of(odd_rows).limit(0)).count() == 0


@pytest.mark.parametrize("max_node", [50_000, 6])
def test_against_brute_force(docs_of, max_node):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([3, 40, 400]))]
        for _ in range(rnd.choice([1, 1, 2, 5])):
            w = list(base)
            for _ in range(rnd.choice([0, 1, 2])):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            rows.append((len(rows) + 10, " ".join(w), "s"))
    check(docs_of(rows), rows, max_node=max_node)


@pytest.mark.parametrize("max_node", [1000, 16])
def test_dense_cluster_keeps_its_links(spark, max_node):
    rnd = np.random.default_rng(3)
    base = int(rnd.integers(1 << 62))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rnd.integers(0, 64, (120, 2))} | {int(x) for x in rnd.integers(0, 1 << 62, 50)})
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    comp = {r.node: r.root for r in simhash.components(simhash.links(df, 3, max_node)).collect()}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = [comp.get(s, s) for s in signed]
    want = brute_components(list(range(len(fps))), fps)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_keep_one(docs_of, odd_rows):
    kept = simhash.keep_one(docs_of(odd_rows)).select("doc_id").collect()
    assert Counter(r.doc_id for r in kept) == Counter([1, None, 3, 5, 8, 9])


def test_chain_of_links_is_one_component(spark):
    fps = [(1 << i) - 1 for i in range(0, 60, 3)]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    c = simhash.components(simhash.links(df, 3))
    assert c.agg(F.countDistinct("root")).first()[0] == 1 and c.count() == len(fps) - 1


@pytest.mark.parametrize("share", [10_000, 40])
def test_components_by_forests_of_tasks(spark, monkeypatch, share):
    """What a task's edges connect is joined there: edges of one task need no rounds, those of more tasks fewer, and both give the same."""
    cuts, own = [], simhash.cut
    monkeypatch.setattr(simhash, "cut", lambda df: cuts.append(1) or own(df))
    rnd = random.Random(6)
    edges = [(k, k + 1) for k in range(100, 260)] + [(9, 9), (7, 5), (5, 7), (-3, 400)] + [(1000 + rnd.randrange(150), 1000 + rnd.randrange(150)) for _ in range(60)]
    up = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = sorted((up[a], up[b]))
        up = {n: x if r == y else r for n, r in up.items()}
    df = spark.createDataFrame(edges, "u long, v long")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")  # else so few edges come to one task
    got = simhash.components(df, share=share).collect()
    spark.conf.unset(name)
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == {n: r for n, r in up.items() if n != r}
    assert len(cuts) == 2 if share > len(edges) else len(cuts) > 2
    assert simhash.components(df.where("u = v")).collect() == []


@pytest.mark.parametrize("max_node", [50_000, 40])
def test_similar_documents(docs_of, max_node):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    rows, want = [], {}
    for g in range(40):
        base = [rnd.choice(words) for _ in range(300)]
        for c in range(3):
            w = list(base)
            for _ in range(c * 2):  # at most 4 * 5 of 296 shingles differ: similarity 0.87
                w[rnd.randrange(len(w))] = rnd.choice(words)
            want[len(rows)] = g
            rows.append((len(rows), " ".join(w), "s"))
        half = base[:150] + [rnd.choice(words) for _ in range(150)]  # similarity of about a third
        want[1000 + g] = 1000 + g
        rows.append((1000 + g, " ".join(half), "s"))
    order = {d: i for i, (d, _, _) in enumerate(rows)}
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(docs_of(rows), max_node=max_node).select("doc_id", "component_id").collect()}
    first = {}
    for d, _, _ in rows:
        first.setdefault(want[d] if d >= 1000 else ("g", order[d] // 4), d)
    assert got == {d: first[want[d] if d >= 1000 else ("g", order[d] // 4)] for d, _, _ in rows}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_whole_tables_equal_brute_force(spark, sf):
    """Components by the exact similarity of all pairs that share a shingle: none missed, none joined below 0.8."""
    folder = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(folder):
        pytest.skip("needs the driver's tables")
    docs = spark.read.parquet(folder)
    sets, ids = {}, {}
    for r in docs.select("doc_id", "text").collect():
        key = tuple(simhash.shingles_of((r.text or "").encode().lower().split(), 5).tolist())
        sets.setdefault(key, len(sets))
        ids.setdefault(sets[key], []).append(r.doc_id)
    held = defaultdict(list)
    for key, k in sets.items():
        for h in key:
            held[h].append(k)
    common = Counter()
    for ks in held.values():
        for i, x in enumerate(ks):
            for y in ks[i + 1 :]:
                common[x, y] += 1
    size, up = [len(k) for k in sets], list(range(len(sets)))

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for (x, y), n in common.items():
        if 10 * n >= 8 * (size[x] + size[y] - n):
            up[root(x)] = root(y)
    least = {}
    for k, own in ids.items():
        least[root(k)] = min([*own, least.get(root(k), own[0])])
    want = {d: least[root(k)] for k, own in ids.items() for d in own}
    assert {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()} == want


def pair_at(rnd, inside, n):
    """Two texts of n five-word shingles each, of which ``inside`` are common."""
    word = lambda: f"w{rnd.randrange(10**9)}"
    a = [word() for _ in range(n + 4)]
    return " ".join(a), " ".join(a[: inside + 4] + [word() for _ in range(n - inside)])


@pytest.mark.parametrize("inside, n", [(140, 170), (60, 70), (79, 90), (80, 90), (68, 74)])  # similarity 0.7, 0.75, 0.782, 0.8, 0.85
def test_similarity_is_exact(docs_of, inside, n):
    rnd = random.Random(inside)
    rows = [(2 * k + c, t, "s") for k in range(300) for c, t in enumerate(pair_at(rnd, inside, n))]
    linked = simhash.similar_documents(docs_of(rows)).where("doc_id <> component_id").collect()
    assert all(r.doc_id == r.component_id + 1 for r in linked)
    assert len(linked) == (300 if 10 * inside >= 8 * (2 * n - inside) else 0)


def test_blocks_find_the_same(docs_of):
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(124)]
    rows = []
    for i in range(60):
        w = list(base)
        for at in range(rnd.choice([0, 20]), 120, rnd.choice([30, 40, 60])):
            w[at] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w), "s"))
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t, _ in rows]
    up = list(range(60))
    for i in range(60):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]) and up[i] != up[j]:
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    for max_node in (50_000, 7):
        got = simhash.similar_documents(docs_of(rows), max_node=max_node).collect()
        assert {r.doc_id: r.component_id for r in got} == dict(enumerate(up))
    assert 1 < len(set(up)) < 60


def test_keep_one_by_row(docs_of):
    one, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one, "s"), (2, one, "s"), (2, other, "s"), (2, other, "t"), (None, other, "s"), (None, "no id", "s"), (None, "no id", "s")]
    kept = simhash.keep_one(docs_of(rows)).select("doc_id", "text").collect()
    assert Counter(map(tuple, kept)) == Counter([(1, one), (2, other), (None, "no id")])


def test_pipeline_walks_the_tries(docs_of, monkeypatch):
    """The pipeline's candidates come from the self-join of the tries, its result from the exact check of them."""
    walked, own = [], simhash.trie_links
    monkeypatch.setattr(simhash, "trie_links", lambda *a, **k: walked.append(a[1]) or own(*a, **k))
    a = [f"a{i}" for i in range(60)]
    rows = [(1, " ".join(a), "s"), (2, " ".join([*a[:-1], "z"]), "s"), (3, " ".join(f"b{i}" for i in range(60)), "s")]
    kept = corpus_pipeline.near_dedup(None, docs_of(rows), "")
    assert {r.doc_id for r in kept.collect()} == {1, 3} and walked == [simhash.SIMILAR]


@pytest.mark.parametrize("max_node", [200_000, 64])
def test_walk_finds_pairs_at_the_limit(spark, max_node):
    """Of 400 pairs of 0.8 all are candidates, whether tries are walked whole or by pairs of nodes; sets that have nothing in common are none."""
    rnd, sets = np.random.default_rng(5), []
    for _ in range(400):
        x = rnd.integers(0, 1 << 64, 110, np.uint64)
        sets += [x[:99], np.concatenate([x[:88], x[99:]])]  # 88 of 110 in common
    rows = [(k, simhash.fingerprints_of(s).tolist()) for k, s in enumerate(sets)]
    same = [(900 + k, [simhash.fingerprints_of(sets[0])[0].item(), *rnd.integers(-(1 << 63), 1 << 63, simhash.WORDS - 1).tolist()]) for k in range(70)]  # one trie of many
    df = spark.createDataFrame(rows + same, "node long, fps array<long>")
    found = {tuple(sorted(r)) for r in simhash.similar_links(df, max_node).collect()}
    assert found == {(2 * k, 2 * k + 1) for k in range(400)}
