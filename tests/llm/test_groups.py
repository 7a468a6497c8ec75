import random

import pytest
from pyspark.sql import functions as F

from kolonnade.llm.groups import connected, link_groups

SIDE = "struct<tab:string,col:string>"


def union_find(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    groups = {}
    for x in list(up):
        groups.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in groups.values()}


def graphs():
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(400)]
    ring = [(2000 + i, 2000 + (i + 1) % 97) for i in range(97)]
    clique = [(3000 + i, 3000 + j) for i in range(12) for j in range(i)]
    noise = [(rng.randrange(4000, 4150), rng.randrange(4000, 4150)) for _ in range(120)]
    tree = [(5000 + i, 5000 + (i - 1) // 3) for i in range(1, 200)]
    return {"chain": chain, "star": star, "ring": ring, "clique": clique, "all": chain + star + ring + clique + noise + tree + chain[:40] + [(b, a) for a, b in star[:30]]}


@pytest.mark.parametrize("name", ["chain", "ring", "clique", "all"])
def test_components(spark, name):
    pairs = graphs()[name]
    got = connected(spark.createDataFrame(pairs, "u long, v long")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["id"])
    assert {frozenset(g) for g in groups.values()} == union_find([p for p in pairs if p[0] != p[1]])
    assert len(got) == len({r["id"] for r in got})


def edges(spark, rows):
    return spark.createDataFrame([(d, a, b, "x") for d, a, b in rows], f"db_id string, col1 {SIDE}, col2 {SIDE}, u string")


def test_link_groups_and_dirt(spark):
    got = link_groups(
        edges(
            spark,
            [
                ("d", ("T", "b "), ("t", "a")), ("d", ("t", "a"), (" T", "B")), ("d", ("t", "B"), ("s", "z")), ("d", ("q", "self"), ("q", "self")),
                ("e", ("t", "a"), ("t", "c")), ("d", None, ("t", "n")), ("d", ("t", None), ("t", "n")), ("d", ("t", "  "), ("t", "n")), (None, ("t", "x"), ("t", "y")), ("d", ("t", "x.y"), ("é", "ß")),
            ],
        )
    )
    assert sorted(map(tuple, got.collect())) == [
        ("d", "q.self", "q.self"), ("d", "s.z", "s.z"), ("d", "t.a", "s.z"), ("d", "t.b", "s.z"), ("d", "t.x.y", "t.x.y"), ("d", "é.ß", "t.x.y"), ("e", "t.a", "t.a"), ("e", "t.c", "t.a"),
    ]


def test_empty(spark):
    assert link_groups(edges(spark, [])).count() == 0
    assert connected(spark.createDataFrame([], "u long, v long")).count() == 0
    assert connected(spark.createDataFrame([(1, 1), (None, 2)], "u long, v long")).count() == 0


def test_long_chain_takes_few_rounds(spark, monkeypatch):
    import kolonnade.llm.groups as g

    cuts = []
    monkeypatch.setattr(g, "cut", lambda df, real=g.cut: cuts.append(1) or real(df))
    got = connected(spark.range(3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")))
    assert got.select("root").distinct().count() == 1 and len(cuts) < 80
