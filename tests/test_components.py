"""Disjoint sets against a plain union-find."""

import random

from winnowry.operators import components as G


def brute(n, edges):
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    return {i: find(i) for e in edges for i in e if e[0] != e[1]}


def test_connected_equals_union_find(spark):
    r = random.Random(1)
    zigzag = [*range(0, 40, 2), *range(1, 40, 2)]
    r.shuffle(zigzag)
    edges = list(zip(zigzag, zigzag[1:], strict=False))  # one path in no order
    edges += [(40 + i, 41 + i) for i in range(30)] + [(100, 100 + i) for i in range(1, 30)]  # a sorted path, a star
    edges += [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(45)]
    df = spark.createDataFrame([*edges, (edges[0][1], edges[0][0]), (7, 7), (500, 500), (None, 3), (3, None)], "a long, b long")
    got = dict(map(tuple, G.connected(df).collect()))
    assert got == brute(300, edges)
    assert G.connected(df.where("a = 500")).count() == 0 and G.connected(df.where("false")).count() == 0


def test_families_share_any_key(spark):
    rows = [(5, "x", 1), (3, "x", None), (9, None, 1), (8, "q", 2), (2, None, None), (7, None, 3), (6, "z", 3), (None, "x", 3), (1, "1", 9), (4, "2", 1)]
    df = spark.createDataFrame(rows, "item long, one string, two long")
    got = sorted(map(tuple, G.families(df, "item", ["one", "two"]).collect()))
    assert got == [(3, 3, 4), (4, 3, 4), (5, 3, 4), (6, 6, 2), (7, 6, 2), (9, 3, 4)]


def test_families_of_one_hot_key(spark):
    df = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE CAST(id AS STRING) END AS k")
    got = G.families(df, "id", ["k"])
    assert got.count() == 1667 and got.where("family <> 0 OR size <> 1667").count() == 0


def test_chain_ends(spark):
    steps = spark.createDataFrame([(i, i - 1) for i in range(1, 50)] + [(100, 70)], "item long, next long")
    got = dict(map(tuple, G.chain_ends(steps).collect()))
    assert got == {i: 0 for i in range(1, 50)} | {100: 70}
