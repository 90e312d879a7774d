import random

from strataq.operators import graph, pages


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in parent}


def test_components(spark):
    rnd = random.Random(3)
    chain = [(k, k + 1) for k in range(1000, 1200)]
    star = [(5000, k) for k in range(4000, 4100)] + [(4000, 3999)]
    few = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(140)]
    edges = [*chain, *star, *few, (9, 9), (7000, 7000), (4050, 4050), *few[:20]]
    rnd.shuffle(edges)
    df = spark.createDataFrame([*edges, (None, 4), (5, None)], "a long, b long")
    got = [tuple(r) for r in graph.components(df).collect()]
    assert dict(got) == brute(edges) and len(got) == len(dict(got))
    assert graph.components(df.limit(0)).collect() == []


def test_stories(spark):
    rows = [
        (1, "One two three four five six"), (2, "zero ONE  two\nthree four nine"), (3, "zero one x y z zero one"), (4, None), (5, ""), (6, "nine eight seven six five"),
        (7, "a nine eight seven six"), (7, "other words of that page"), (8, "all of: menu home about us"), (9, "menu home about us here"), (10, "x menu home about us"), (None, "menu home about us"), (11, "short"),
    ]
    df = spark.createDataFrame(rows, "page_id long, text string")
    stories = lambda **k: {r.page_id: r.story for r in pages.stories(df, 4, **k).collect()}
    assert stories() == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 8, 11: 11}
    assert stories(most=2) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 11}


def test_edges_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(frames):
        for pdf in frames:
            seen.add(len(pdf))
            yield pdf

    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 5), (7, 8)], "a long, b long").mapInPandas(told, "a long, b long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 7: 7, 8: 7} and seen.value == 4
