import random

from kolonnade.llm import setjoin
from kolonnade.llm.setjoin import MISSING, normal_value, similar_domains

SHAPE = "domain_id long, normalized_values array<string>, representatives map<string,string>, sid string, path long"


def brute(rows, threshold=0.6, least=5):
    sets = {}
    for i, a, m in rows:
        values = a if a is not None else list(m) if m is not None else None
        if i is None or values is None:
            continue
        s = frozenset(normal_value(v) for v in values if v is not None) - set(MISSING)
        if len(s) >= least:
            sets.setdefault(i, set()).add(s)
    flat = [(i, s) for i, many in sets.items() for s in many]
    return {(i, j) for i, a in flat for j, b in flat if i < j and len(a & b) >= threshold * len(a | b) - 1e-9}


def run(spark, rows, **more):
    return set(map(tuple, similar_domains(spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE), **more).collect()))


def data(n, seed):
    rng = random.Random(seed)
    out = []
    for g in range(n // 6):
        base = [f"v{g}-{k}" for k in range(rng.randrange(5, 40))] + rng.sample(["hot", "west", "low", "N/A", "unknown"], 2)
        for k in range(6):
            keep = [v for v in base if rng.random() < rng.choice([0.7, 0.85, 1.0])]
            out.append((g * 6 + k, keep + [f"own{g}{k}{x}" for x in range(rng.randrange(4))], None))
    return out


def test_all_pairs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LEAF", 16)
    rows = data(900, 2)
    want, got = brute(rows), run(spark, rows)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 300


def test_nodes_that_stay_large_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LEAF", 8)
    monkeypatch.setattr(setjoin, "LEVELS", 2)
    monkeypatch.setattr(setjoin, "BLOCK", 16)
    core = [f"c{k}" for k in range(30)]
    rows = [(i, core + [f"own{i}"], None) for i in range(80)]
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 80 * 79 // 2


def test_recall_of_nested_sets_on_the_last_level(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "LEAF", 1)
    rows = [(2 * g + k, [f"v{g}-{x}" for x in range(n)], None) for g in range(1500) for k, n in enumerate((30, 50))]
    got = run(spark, rows)
    assert got <= {(2 * g, 2 * g + 1) for g in range(1500)} and len(got) >= 0.995 * 1500


def test_dirt_copies_and_fallback(spark):
    a = ["Straße", "a  b", "c", "d", "e", "f"]
    rows = [
        (1, a, None), (1, a, None), (2, ["STRASSE", "A b", "ｃ", "D", "e ", "f", None, "N/A", "f"], None), (3, None, {v: "x" for v in a}), (4, None, None), (5, [], None), (6, ["a", "b", "c", "d"], None),
        (None, a, None), (7, ["c", "d", "e", "zz", "yy", "f"], None), (8, [None, "null"], {"p": "q"}),
    ]
    assert run(spark, rows) == brute(rows) == {(1, 2), (1, 3), (2, 3)}


def test_long_values_and_empty_table(spark):
    big = ["x" * 200_000 + str(k) for k in range(5)]
    assert run(spark, [(1, big, None), (2, big, None)]) == {(1, 2)}
    assert run(spark, []) == set()


def test_classes_count_the_links_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "BLOCK", 16)
    rows = data(240, 5) + [(1000 + i, [f"same{k}" for k in range(9)], None) for i in range(70)] + [(2000, [f"same{k}" for k in range(8)], None)]
    pairs = run(spark, rows)
    assert {p for p in pairs if p[0] >= 1000} == {(i, j) for i in range(1000, 1070) for j in [*range(i + 1, 1070), 2000]}
    links = {}
    for i, j in pairs:
        links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
    got = {r["domain_id"]: (r["class_id"], r["n_links"]) for r in setjoin.domain_classes(spark.createDataFrame([(*r, "x", 1) for r in rows], SHAPE)).collect()}
    assert got[1069] == (1000, 70) and got[2000] == (2000, 70)
    assert {i: n for i, (_, n) in got.items() if n} == links
