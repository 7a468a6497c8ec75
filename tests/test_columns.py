"""Catalog, profiles, names and values on small tables with everything dirty."""

import difflib
import unicodedata

import pytest
from pyspark.sql import functions as F

from kolonnade.functions import text
from kolonnade.operators import lexical, profile, values
from kolonnade.sources import catalog as cat

U = "ref string, v string"
BIG = "x" * 100_000


def u(spark, rows):
    return spark.createDataFrame(rows, U)


def test_counts_lengths_and_samples(spark):
    rows = [("t.a", v) for v in ["b", "b", None, " c  d ", "", BIG, "c d", "z" * 121]] + [("t.n", None)] * 3
    got = {r["ref"]: r for r in profile.counts(u(spark, rows)).collect()}
    assert (got["t.a"]["row_count"], got["t.a"]["non_null_count"], got["t.a"]["distinct_count"]) == (8, 7, 6)
    assert (got["t.n"]["distinct_count"], got["t.n"]["distinct_ratio"], got["t.n"]["null_fraction"]) == (0, 0.0, 1.0)
    lengths = {r["ref"]: tuple(r)[1:] for r in profile.lengths(u(spark, [("t.x", "a"), ("t.x", "bb"), ("t.x", "cccc"), ("t.x", "d" * 10), ("t.n", None)])).collect()}
    assert lengths == {"t.x": (1.3, 3.0, 8.2), "t.n": (None, None, None)}
    assert [r["value"] for r in profile.samples(u(spark, rows)).orderBy("pos").collect()] == ["c d", "b"]
    assert profile.counts(u(spark, [])).count() == profile.samples(u(spark, [])).count() == 0


@pytest.mark.parametrize(
    "name,kind,vals,mode",
    [
        ("flag", "text", ["Yes", " no", "YES "], "BOOLEAN_LIKE"), ("paid", "text", ["a", "b"], "CODE_OR_IDENTIFIER"), ("keyboard", "text", ["a"], "CODE_OR_IDENTIFIER"), ("made", "timestamp", ["x"], "DATE_LIKE"), ("update_note", "text", ["x"], "DATE_LIKE"),
        ("price", "real", ["1.5", "2.5"], "NUMERIC_MEASURE"), ("colour", "text", ["r", "g"], "LOW_CARD_DOMAIN"), ("title", "text", [f"t{i}" for i in range(30)], "CODE_OR_IDENTIFIER"), ("title", "text", [f"t{i % 15}" for i in range(30)], "LABEL_TEXT"),
        ("blob", "binary", ["x"], "OTHER"), ("zero", "integer", ["0", "0"], "BOOLEAN_LIKE"), ("none", "text", [None], "LABEL_TEXT"),
    ],
)
def test_value_modes(spark, name, kind, vals, mode):
    cols = spark.createDataFrame([(f"t.{name}", name, kind)], "ref string, col string, data_type string")
    assert profile.modes(u(spark, [(f"t.{name}", v) for v in vals]), cols).first()["value_mode"] == mode


def test_budget(spark):
    rows = [("t.a", c * n) for c, n in zip("abcd", (40, 40, 30, 5))] + [("t.b", "z" * 101)]
    assert [tuple(r) for r in profile.example_budget(u(spark, rows)).collect()] == [("t.a", 2, "a" * 40 + " | " + "b" * 40)]


def test_catalog(spark):
    k = cat.Constraints(primary={"p": ["id"], "c": ["a", "b"]}, foreign={"c.a": "p", "c.b": "p.x.y", "c.z": "c"}, unique=["c.u"])
    tables = {"p": spark.createDataFrame([], "id long, `x.y` string"), "c": spark.createDataFrame([], "a long, b string, u double, z timestamp")}
    rows = {r["ref"]: r for r in cat.catalog(tables, k).collect()}
    assert rows["c.a"]["fk_ref"] == "p.id" and rows["c.b"]["fk_ref"] == "p.x.y" and rows["c.z"]["fk_ref"] is None
    assert rows["c.a"]["primary_key"] and not rows["c.a"]["uniq"] and rows["p.id"]["uniq"] and rows["c.u"]["data_type"] == "real"
    assert cat.unpivot("p", tables["p"], ["id", "x.y"]).count() == 0
    ddl = {r["tab"]: r["ddl"] for r in cat.ddl(cat.catalog(tables, k)).collect()}
    assert 'PRIMARY KEY ("a", "b")' in ddl["c"] and 'REFERENCES "p" ("x.y")' in ddl["c"] and '"u" real UNIQUE' in ddl["c"]
    left, right = cat.split_ref(F.lit(" t . a.b "))
    assert tuple(spark.range(1).select(left, right).first()) == ("t", "a.b")


@pytest.mark.parametrize("name,want", [("phone1", ["phone", "1"]), ("ISBN13Code", ["isbn", "13", "code"]), ("customerID", ["customer", "id"]), ("größe x", ["gr", "e", "x"]), ("", []), ("__", [])])
def test_tokens(spark, name, want):
    assert spark.range(1).select(text.tokens(F.lit(name)).alias("t")).first()["t"] == want


def python_profile(col):
    import re

    s = re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", col or "")
    tokens = [t.lower() for t in re.findall(r"[A-Za-z]+|[0-9]+", s)]
    surface = " ".join(tokens)
    return set(tokens), surface, {surface[i : i + 3] for i in range(len(surface) - 2)} or ({surface} if surface else set())


def test_lexical_blocking_loses_no_pair(spark):
    import itertools
    import random

    r = random.Random(1)
    names = sorted({"".join(r.choice(["cust", "Name", "code", "order", "Date", "_", "1", "2", "ship", "to"]) for _ in range(r.randrange(1, 5))) for _ in range(120)})
    cols = spark.createDataFrame([("d", f"t{i % 7}.{n}", f"t{i % 7}", n, "l") for i, n in enumerate(names)] + [("d", None, "t", None, "")], "db_id string, ref string, tab string, col string, l string")
    got = {(x["l"], x["r"]) for x in lexical.candidates(cols).collect()}
    want = set()
    refs = {f"t{i % 7}.{n}": python_profile(n) for i, n in enumerate(names)}
    import re

    for a, b in itertools.combinations(sorted(refs), 2):
        (ta, sa, ga), (tb, sb, gb) = refs[a], refs[b]
        i = ta & tb
        jac, ov = (len(i) / len(ta | tb) if ta | tb else 0), (len(i) / min(len(ta), len(tb)) if ta and tb else 0)
        dice = 2 * len(ga & gb) / (len(ga) + len(gb)) if ga or gb else 0
        slot = [re.fullmatch(r"(.+) (\d+)", s) for s in (sa, sb)]
        if all(slot) and slot[0][1] == slot[1][1] and slot[0][2] != slot[1][2] or any(len(t) >= 3 for t in i) and (ov >= 0.5 or jac >= 0.3) or max(len(sa), len(sb)) >= 5 and round(dice, 6) >= 0.6:
            want.add((a, b))
    assert got == want and len(want) > 100


def test_edit_similarity_is_that_of_difflib(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("a" * 300, "a" * 299 + "b"), (None, "x")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(text.sequence_ratio("a", "b")).collect()]
    assert got == [None if a is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_patterns(spark):
    cases = {"": "empty", "6d1ca00c-340e-977b-ab61-0625a35bb528": "uuid_like", "2031-01-02 03:04": "date_like", "-12": "integer_like", "1.": "decimal_like", ".5": "decimal_like", "abc": "short_text", "a" * 33: "long_text", "a-1": "alnum_code_like", "a b": "other_text", "ä " * 50: "long_text"}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.pattern(F.col("v")).alias("p")).collect()
    assert {r["v"]: r["p"] for r in rows} == cases


def test_unicode_domains(spark):
    rows = [("a.x", "Straße"), ("a.x", "ＡＢ c"), ("a.x", None), ("a.x", "N/A"), ("b.y", "STRASSE"), ("b.y", "ab C")]
    got = {tuple(r) for r in values.domains(u(spark, rows)).collect()}
    want = {(r, " ".join(unicodedata.normalize("NFKC", v).strip().casefold().split())) for r, v in rows if v and v != "N/A"}
    assert got == want
    assert [(r["l"], r["r"], r["n_shared"]) for r in values.overlaps(values.domains(u(spark, rows))).collect()] == [("a.x", "b.y", 2)]
    assert values.overlaps(values.domains(u(spark, []))).count() == 0
    assert {(r["v"], r["original"]) for r in values.representatives(u(spark, [("a.x", " Straße"), ("a.x", "STRASSE")])).collect()} == {("strasse", "STRASSE")}


def test_collision_modes(spark):
    ids, more = [str(i) for i in range(40)], [str(i) for i in range(20, 60)]
    rows = [("t.k_id", v) for v in ids] + [("s.k_id", v) for v in more] + [("t.c", v) for v in ("red", "green")] + [("s.c", v) for v in ("Red", "GREEN ")] + [("t.b", v) for v in ("yes", "no")] + [("s.b", v) for v in ("yes", "no")]
    cols = spark.createDataFrame([(r, r.split(".")[1], r.split(".")[0], "text", False, False, None) for r in sorted({x for x, _ in rows})], "ref string, col string, tab string, data_type string, primary_key boolean, uniq boolean, fk_ref string")
    data = u(spark, rows)
    got = [(r["l"], r["r"], r["mode"], r["n_shared"]) for r in values.collisions(values.domains(data), cols, profile.modes(data, cols)).collect()]
    assert sorted(got) == [("s.c", "t.c", "LOW_CARD_DOMAIN", 2), ("s.k_id", "t.k_id", "CODE_OR_IDENTIFIER", 20)]


def test_endpoint_samples_take_values_once(spark, monkeypatch):
    import hashlib

    cols = {f"t.c{i:02}": [str(x) for x in range(0, 1500 + 100 * i, 1 + i % 3)] for i in range(8)} | {"t.few": ["7", "zz", "y"]}
    domain = spark.createDataFrame([(c, v) for c, vs in cols.items() for v in vs], U)
    pairs = [(a, b) for a in cols for b in cols if a < b]

    def wanted(a, b, l, r):
        rest = sorted((hashlib.sha256(f"d|{l}|{r}|{a}|endpoint|{v}".encode()).hexdigest(), v) for v in set(cols[a]) - set(cols[b]))
        return [((a, b), " | ".join(v for _, v in rest[:5]))] if rest else []

    want = dict(x for l, r in pairs for x in wanted(l, r, l, r) + wanted(r, l, l, r))
    many = spark.createDataFrame(pairs, "l string, r string")
    frame = values.endpoint_samples(domain, many, "d")
    assert {(r["ref"], r["other"]): r["samples"] for r in frame.collect()} == want
    # No join of the values of every side.
    assert "LeftAnti" not in frame._jdf.queryExecution().toString()
    # Where too few pass the bound the sides are taken whole.
    monkeypatch.setattr(values, "ENOUGH", 0.2)
    assert {(r["ref"], r["other"]): r["samples"] for r in values.endpoint_samples(domain, many, "d").collect()} == want
