import numpy as np
import pytest

from strataq.llm import mtree

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k, every):
    usable = {(i, tuple(np.floor(64 * np.array(v)).astype(object).astype(int).tolist())) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    by_id = {}
    for i, v in usable:
        if i % every == 0:
            by_id.setdefault(i, []).append(v)
    out = set()
    for i, own in by_id.items():
        found = [(-sum(a * b for a, b in zip(q, v)), j) for q in own for j, v in usable if (j, v) != (i, q) and len(v) == len(q)]
        out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(sorted(found)[:k])}
    return out


def searched(spark, rows, k=20, every=20, **more):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS score", "1 AS tree", "2 AS n")
    got = mtree.search(df, df.where(f"vec_id % {every} = 0"), k, **more).collect()
    assert len(got) == len({(r[0], r[1]) for r in got})
    return {tuple(r) for r in got}


def clustered(n, d, seed, spread=0.1, centres=12):
    r = np.random.default_rng(seed)
    c = r.standard_normal((centres, d))
    return [(int(i), (c[i % centres] * (1 + i % 3) + spread * r.standard_normal(d)).tolist()) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"pivots": 5, "tree_size": 100, "queries_a_task": 7}])
def test_all_products(spark, sizes):
    rows = clustered(3000, 16, 1)
    assert searched(spark, rows, **sizes) == brute(rows, 20, 20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(900)] + [(i, [0.1 * (i % 7), -0.3, 0.2]) for i in range(900, 1000)]
    rows += [(1000, None), (None, same), (1020, []), (1040, [0.0, 0.0, 0.0]), (1060, [nan, 1.0, 1.0]), (1080, [1.0, None, 1.0]), (1100, [inf, 0.0, 0.0])]
    rows += [(1120, [1.0, 2.0]), (1121, [3.0, 4.0]), (1140, [1.0] * 5), (0, same), (40, [9.0, 9.0, 9.0]), (1160, [-1e3, 5e2, 1e-9])]
    assert searched(spark, rows) == brute(rows, 20, 20)
    assert searched(spark, [], 3) == set() and searched(spark, [(0, None), (1, same)], 3) == set() and searched(spark, [(0, same)], 3) == set()


def test_products_of_any_size(spark):
    rows = [(i, [float(10**7 + i), -float(i), 3.0]) for i in range(60)]
    assert searched(spark, rows, 4) == brute(rows, 4, 20)
    r = np.random.default_rng(8)
    rows = [(i, (1e6 + r.integers(-3, 4, 5) / 64).tolist()) for i in range(600)]  # nearly equal: distances are small beside the norms
    assert searched(spark, rows, 4, pivots=3, tree_size=150) == brute(rows, 4, 20)
    with pytest.raises(ValueError):
        searched(spark, [(0, [1e30, 1.0]), (1, [1e30, 2.0])], 4)


def test_bounds_spare_distances():
    rows = clustered(20_000, 12, 3, 0.02, 60)
    x = np.floor(64 * np.array([v for _, v in rows]))
    facts = mtree.Facts(float(np.abs(x).max()), float((x * x).sum(1).max()), 12)
    vecs = [v.astype(facts.kind).tobytes() for v in x]
    tree = mtree.Tree(facts)
    for _, page, leaf, dim, *binary in mtree.Builder(facts, 0, 12, vecs, [[i] for i in range(len(vecs))]).pages:
        tree.pages[page] = mtree.Page(facts, leaf, dim, *binary)
    asked = mtree.Asked(facts, vecs[:40], 12, 10, [None] * 40)
    tree.search(asked)
    for q, best in zip(x, asked.best):
        want = sorted(zip((-(x @ q)).astype(int).tolist(), range(len(x))))[:10]
        assert [b[:2] for b in best] == want
    assert tree.computed < 0.5 * 40 * len(x)  # most are never met, and of those on visited pages the stored distances spare some
    assert tree.spared > 0


def test_every_vector_is_in_the_tree_once():
    r = np.random.default_rng(5)
    x = np.unique(r.integers(-40, 40, (3000, 4)), axis=0).astype(float)
    facts = mtree.Facts(40.0, float((x * x).sum(1).max()), 4)
    pages = mtree.Builder(facts, 0, 4, [v.astype(facts.kind).tobytes() for v in x], [[i] for i in range(len(x))]).pages
    ids = np.concatenate([np.frombuffer(p[8], "<i8") for p in pages])
    assert sorted(ids.tolist()) == list(range(len(x)))
