"""Ledger, search, SQL texts, results, files and streams on small inputs."""

import datetime as dt
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kolonnade.operators import compare, ledger, retrieval, search, sqlanalysis, telemetry, vectors
from kolonnade.session import scratch
from kolonnade.sources import files
from kolonnade.streaming import streams

L = "ingest_seq long, batch_id string, candidate_id string, status string, parsed_payload struct<candidate_id:string,col1:struct<tab:string,col:string>,col2:struct<tab:string,col:string>,reason_summary:string,decision:string,ambiguity_trigger_context:string,confidence:double>, pair_key array<string>, error_class string, error string, seq string, candidate string"


def payload(decision, confidence=0.5, trigger=None, reason="r", cid="a"):
    return (cid, ("t", "x"), ("t", "y"), reason, decision, trigger, confidence)


def rows(spark, items):
    return spark.createDataFrame([(s, b, c, st, p, ["t.x", "t.y"], ec, e, "s", "c") for s, b, c, st, p, ec, e in items], L)


def test_ledger(spark):
    led = rows(
        spark,
        [
            (1, "r-1", " A", "OK", payload("ADD_EDGE", trigger="x"), None, None), (2, "r-1", "a", "ERROR", None, "timeout", None), (3, "r-2", "b", "ERROR", None, None, "HTTP Error 500"), (4, "r-2", "c", "ERROR", None, "parse", None),
            (5, "r-3", "b", "ERROR", None, "API_HTTP", None), (6, "r-4", "b", "ERROR", None, "http", None), (6, "r-4", "b", "ERROR", None, "http", None), (7, None, None, None, None, None, None), (8, "r-5", "d", "OK", payload(None), None, None),
        ],
    )
    last = {r["candidate"]: (r["n_rows"], r["seq"], r["status"]) for r in ledger.latest(led, False).collect()}
    assert last == {"a": (2, 2, "ERROR"), "b": (4, 6, "ERROR"), "c": (1, 4, "ERROR"), "d": (1, 8, "OK")}
    names = lambda df: sorted(r[0] for r in df.collect())
    assert names(ledger.skipped(led, "ok_only")) == ["a", "d"] and names(ledger.skipped(led, "any_record")) == ["a", "b", "c", "d"] and names(ledger.skipped(led, "primary_sweep")) == ["a", "c", "d"]
    with pytest.raises(ValueError):
        ledger.skipped(led, "else")
    streak = {r["batch_id"]: r["streak"] for r in ledger.error_streaks(led).collect()}
    assert streak == {"r-1": 0, "r-2": 0, "r-3": 1, "r-4": 2, "r-5": 0}
    queue = spark.createDataFrame([("a",), ("b",), ("d",), ("e",)], "candidate string")
    assert {r["candidate"]: r["outcome"] for r in ledger.compiled(queue, led).collect()} == {"a": "accepted", "b": "unresolved:no_terminal_decision", "d": "unresolved:invalid_terminal_payload", "e": "unresolved:no_terminal_decision"}
    assert ledger.latest(rows(spark, []), True).count() == 0


@pytest.mark.parametrize(
    "p,words",
    [
        (payload("ADD_EDGE", trigger="x"), ""), (payload("REJECT"), ""), (None, "missing payload"), (payload("MAYBE"), "invalid decision"), (payload("REJECT", trigger="x"), "REJECT requires"), (payload("ADD_EDGE"), "ADD_EDGE requires"),
        (payload("REJECT", 1.2), "confidence"), (payload("REJECT", None), "confidence"), (payload("REJECT", reason=" "), "reason_summary"), (payload("REJECT", cid="z"), "candidate_id mismatch"),
    ],
)
def test_validation(spark, p, words):
    errors = ledger.validation(rows(spark, [(1, "b", "A ", "OK", p, None, None)])).first()["errors"]
    assert errors == words if not words else errors.startswith(words)


@pytest.mark.parametrize("content,want", [('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ('so {"a": {"b": 2}} end', '{"a": {"b": 2}}'), ("{broken", None), ("no", None), ("", None)])
def test_json_object(spark, content, want):
    assert spark.range(1).select(ledger.json_object(F.lit(content)).alias("x")).first()["x"] == want


def test_search(spark):
    vals = spark.createDataFrame([("t.a", v) for v in ("red widget", "red gadget", "blue", "", None, "RED")] + [("s.b", "red widget")], "ref string, v string")
    probes = spark.createDataFrame([("red widget",), ("re",)], "probe string")
    got = [tuple(r)[:3] for r in search.search_exact(probes, vals.where("v is not null").distinct()).orderBy("probe", "rank").collect()]
    assert got[0] == ("red widget", "s.b", "red widget") and got[1] == ("red widget", "t.a", "red widget")
    approx = {tuple(r)[:3] for r in search.search_minhash(probes, vals.where("v is not null").distinct()).collect()}
    assert {x for x in got if x[0] == "red widget"} <= approx | set(got)
    lit = spark.createDataFrame([("t.a", "red"), ("t.a", "blue"), ("no.c", "x")], "ref string, literal string")
    assert {tuple(r)[1:] for r in search.literal_existence(lit, vals).collect()} == {("red", False), ("blue", True), ("x", None)}
    assert [r["v"] for r in search.substring_candidates(lit, vals).where("literal = 'red'").orderBy("rank").collect()] == ["RED", "red gadget", "red widget"]
    clean = {r["x"]: r["y"] for r in spark.createDataFrame([("'ab'",), ('"a"',), (" x y ",), ("z" * 101,)], "x string").select("x", search.clean_literal(F.col("x")).alias("y")).collect()}
    assert clean == {"'ab'": "ab", '"a"': None, " x y ": "x y", "z" * 101: None}


def test_vector_search(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    data += [(100, data[0][1]), (101, None), (102, [0.0] * 8), (103, [1.0] * 4), (None, [1.0] * 8)]
    every = vectors.usable(spark.createDataFrame(data, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got = {(r["q"], r["rank"]): r["c"] for r in vectors.search(every.where("id % 10 = 0"), every, 3, block=2).collect()}
    ids, m = zip(*[(i, v) for i, v in data if i is not None and v and len(v) == 8 and any(v)])
    m = np.array(m) / np.linalg.norm(m, axis=1, keepdims=True)
    for n, i in enumerate(ids):
        if i % 10 == 0:
            s = np.round(m @ m[n], 6)
            order = [j for j in np.lexsort((ids, -s)) if j != n][:3]
            assert [ids[j] for j in order] == [got[i, k] for k in (1, 2, 3)]
    assert vectors.search(every.limit(0), every, 3).count() == 0 if every.limit(0).count() else True
    calls = vectors.fill(spark.createDataFrame([("a", "x"), ("b", "yy")], "column_id string, text string"), lambda ts: [[float(len(t))] for t in ts])
    assert {r["column_id"]: r["embedding"] for r in calls.collect()} == {"a": [1.0], "b": [2.0]}


def test_sql_anchors(spark):
    cols = {"orders": ["id", "Status"], "customer": ["id", "name"]}
    a = sqlanalysis.anchors(spark, "SELECT c.name FROM customer c JOIN orders ON c.id = orders.id WHERE status = \"F\" AND name LIKE '%ann%' AND c.id IN (SELECT id FROM orders WHERE Status BETWEEN 'a' AND 'b'); -- x", cols)
    assert a.tables == ["customer", "orders"] and set(a.columns) >= {"customer.name", "orders.Status", "customer.id"}
    assert {(r, t) for r, _, t in a.literals} >= {("orders.Status", "F"), ("customer.name", "ann"), ("orders.Status", "a"), ("orders.Status", "b")}
    assert sqlanalysis.valid(spark, "SELECT 1") and not sqlanalysis.valid(spark, "SELECT a FROM (")


def test_compare(spark):
    sql = spark.sql
    same = compare.equal_results
    assert same(sql("SELECT 1 a, 'x' b"), sql("SELECT 'x' q, 1.0 p")) and not same(sql("SELECT 1 a, 2 b"), sql("SELECT 1 a, 3 b"))
    assert same(sql("SELECT * FROM VALUES (1, 1), (1, 2), (2, 1) t(a, b)"), sql("SELECT * FROM VALUES (1, 1), (2, 1), (1, 2), (1, 2) t(a, b)"))
    assert not same(sql("SELECT 1 a"), sql("SELECT 1 a, 2 b")) and same(sql("SELECT 1 a"), sql("SELECT 2 b, 1 a"), superset=True)
    assert same(sql("SELECT 1 a WHERE false"), sql("SELECT 1 a, 2 b WHERE false")) and same(sql("SELECT true a"), sql("SELECT 1 a")) and not same(sql("SELECT CAST(NULL AS INT) a"), sql("SELECT 0 a"))
    assert not same(sql("SELECT CAST('12345678901234567890123' AS decimal(38,0)) a"), sql("SELECT CAST('12345678901234567890124' AS decimal(38,0)) a"))
    assert not same(sql("SELECT 1e-10D a"), sql("SELECT 2e-10D a")) and same(sql("SELECT 0.10 a"), sql("SELECT 0.1D a")) and same(sql("SELECT -0.0D a"), sql("SELECT 0 a")) and same(sql("SELECT 100 a"), sql("SELECT 100.00 a"))
    assert compare.loop_equal("select a", sql("SELECT 1 a, 2 b"), sql("SELECT 2 a, 1 b")) and not compare.loop_equal("select a", sql("SELECT 1 a"), sql("SELECT * FROM VALUES (1), (1) t(a)"))
    two = "SELECT * FROM VALUES {} t(a) "
    assert not compare.loop_equal("SELECT a ORDER BY a", sql(two.format("(1), (2)") + "ORDER BY a"), sql(two.format("(1), (2)") + "ORDER BY a DESC"))
    assert compare.run(spark, "SELECT id FROM range(100)", limit=3).count() == 3
    assert compare.run(spark, "SELECT 7 AS x", timeout_s=30).first()["x"] == 7


def test_retrieval(spark):
    opts = spark.createDataFrame([("d", "a", 3, "x"), ("d", "b", 1, "y"), ("d", "a", 2, "z"), ("d", "a", 9, "x")], "db_id string, anchor string, idx int, option string")
    assert [tuple(r) for r in retrieval.slices(opts).orderBy("slice").collect()] == [("d", "b", 1, 1, "y"), ("d", "a", 2, 2, "z,x")]
    ans = spark.createDataFrame([("t.a", 1, "T.A"), ("t.a", 2, "t.b"), ("t.a", 3, "t.B"), ("t.a", 4, "t.q"), ("t.a", 5, None)], "anchor string, pos int, ref string")
    cols = spark.createDataFrame([("t.a",), ("t.b",)], "ref string")
    r = retrieval.retrieval_audit(ans.where("ref is not null"), cols).first()
    assert tuple(r) == ("t.a", 4, 1, 1, 1, 1)
    ded = retrieval.deduplicated(spark.createDataFrame([(2, "a  b"), (1, "a b "), (3, None)], "ingest_seq long, t string"), "t", "ingest_seq")
    assert [r["ingest_seq"] for r in ded.collect()] == [1]


def test_telemetry(spark):
    got = spark.createDataFrame([([-1.0, -3.0, None],), ([],), (None,)], "p array<double>").select(telemetry.perplexity(F.col("p")).alias("x")).collect()
    assert [None if r["x"] is None else round(r["x"], 9) for r in got] == [round(math.exp(2), 9), None, None]


def test_files(spark, tmp_path):
    for name, enc in (("a", "utf-8-sig"), ("b", "latin-1"), ("c", "utf-16")):
        (tmp_path / f"{name}.csv").write_bytes("original_column_name,column_name,column_description,data_format,value_description\ncol,Größe,\"line\none\",text,commonsense evidence: x\n,,,,\n".encode(enc))
    got = {r["tab"]: tuple(r)[1:] for r in files.column_documentation(files.read_csv_any(spark, str(tmp_path / "*.csv"))).collect()}
    assert got == {t: ("col", "Größe", "line one", "text", "x") for t in "abc"}
    path = scratch(spark, "jsonl")
    files.append_jsonl(spark.createDataFrame([(1, "a")], "id int, v string"), path)
    files.append_jsonl(spark.createDataFrame([(2, None)], "id int, v string"), path)
    assert files.read_jsonl(spark, path, "id int, v string").count() == 2
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": 1}\n{broken\n')
    assert files.read_jsonl(spark, str(bad), "id int", tolerant=True).count() == 1
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(bad), "id int").collect()
    p = spark.createDataFrame([("1", "SELECT 1"), ("1", "SELECT 2"), ("x", "q"), (None, "q")], "k string, sql string")
    assert [tuple(r) for r in files.predictions(p).collect()] == [(1, ["SELECT 1", "SELECT 2"])]
    v = spark.createDataFrame([("c", [1.0], None), ("d", None, [2.0])], "id string, embedding array<double>, vector array<double>")
    assert {r["id"]: r["embedding"] for r in files.embedding_rows(v).collect()} == {"c": [1.0], "d": [2.0]}
    with pytest.raises(Exception):
        files.embedding_rows(spark.createDataFrame([(None, [1.0])], "id string, vector array<double>")).collect()
    names = spark.createDataFrame([("T.A", "x"), ("t.a", "y"), ("t.z", " ")], "ref string, descriptive_name string")
    cols = spark.createDataFrame([("t.a",), ("t.b",)], "ref string")
    assert {tuple(r) for r in files.descriptive_name_audit(names, cols).collect()} == {("t.b", "missing"), ("t.z", "unexpected"), ("T.A", "duplicate"), ("t.z", "empty")}
    ids = spark.createDataFrame([(0, 5), (1, 3), (2, 4)], "pos int, question_id int")
    data = spark.createDataFrame([(3, "c"), (4, "d"), (5, "e"), (6, "f")], "question_id int, q string")
    assert [r["q"] for r in files.subset(data, ids, offset=1, limit=1).collect()] == ["c"]
    big = spark.range(10_000)
    assert abs(files.sampled(big, 0.2, 1).count() - 2000) < 200 and files.sampled(big, 0.2, 1).exceptAll(files.sampled(big.repartition(7), 0.2, 1)).count() == 0


def test_stream_with_late_data(spark):
    path = scratch(spark, "ev")
    t0 = dt.datetime(2031, 1, 1)
    for batch in ([(0, 1.0), (90, 2.0)], [(10_000, 3.0)], [(5, 4.0)]):
        spark.createDataFrame([(t0 + dt.timedelta(minutes=m), "k", v) for m, v in batch], "ts timestamp, k string, value double").coalesce(1).write.mode("append").parquet(path)
    shape = "ts timestamp, k string, value double"
    whole = streams.finished(streams.windowed(streams.follow(spark, path, shape), "ts", "k", "value", late="30 days"))
    static = streams.windowed(spark.read.schema(shape).parquet(path), "ts", "k", "value", watermark=False)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, static.collect()))


def test_usage_is_json_safe(spark):
    out = spark.createDataFrame([(None, None, None, None, None)], "stage string, model string, turn int, ok boolean, token_usage struct<prompt_tokens:long,completion_tokens:long,total_tokens:long>")
    got = {r["by"]: tuple(r)[1:] for r in telemetry.usage(out).collect()}
    assert got == {k: ("unknown", 1, 0, 1, 1, 0, 0, 0) for k in ("stage", "model", "turn")} and json.dumps(sorted(got))
