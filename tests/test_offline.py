import pytest
from pyspark.sql import functions as F

from kolonnade import config, providers
from kolonnade.operators import compare
from kolonnade.plans.offline import construct
from kolonnade.sources.catalog import Constraints, parse_ddl


def test_config():
    c = config.checked(config.merged({"lexical": {"token_overlap_threshold": 0.4}}))
    assert c["lexical"]["token_overlap_threshold"] == 0.4 and c["lexical"]["token_jaccard_threshold"] == 0.3
    assert config.digest({"b": 1, "a": 2}) == config.digest({"a": 2, "b": 1}) != config.digest({"a": 1, "b": 2})
    for bad in ({"lexical": {"token_overlap_threshold": 2}}, {"schema_embedding": {"selection": "best"}}, {"schema_embedding": {"top_k": 0}}, {"nope": {}}):
        with pytest.raises(ValueError):
            config.checked(config.merged(bad))
    assert config.enabled_channels(None) == list(config.DEFAULTS) and config.enabled_channels("value_collision, lexical") == ["lexical", "value_collision"]
    with pytest.raises(ValueError):
        config.enabled_channels("lexical,lexical")


def flaky(prompts):
    if any("bad" in p for p in prompts):
        raise TimeoutError("slow")
    return [p.upper() for p in prompts]


def test_a_failing_request_fails_alone(spark):
    asked = spark.createDataFrame([("1", "a"), ("2", "bad"), ("3", "c")], "request_id string, prompt string").coalesce(1)
    got = {r["request_id"]: (r["content"], r["ok"], r["error_class"]) for r in providers.completed(asked, flaky).collect()}
    assert got == {"1": ("A", True, None), "2": (None, False, "API_TRANSPORT_ERROR"), "3": ("C", True, None)}
    done = spark.createDataFrame([("1", True), ("2", False)], "request_id string, ok boolean")
    assert {r["request_id"] for r in providers.resumed(asked, done, flaky).collect()} == {"2", "3"}


def test_prompt_and_names(spark):
    row = spark.createDataFrame([("x", None)], "a string, b string").select(providers.prompt("<{a}|{b}>", a=F.col("a"), b=F.col("b")).alias("p"), providers.descriptive_name(F.lit("customerID_no")).alias("n")).first()
    assert tuple(row) == ("<x|>", "customer id no")
    with pytest.raises(ValueError):
        providers.prompt("{z}")


def test_construct(spark):
    a = spark.createDataFrame([(i, f"name {i}") for i in range(40)], "cust_id long, cust_name string")
    b = spark.createDataFrame([(i, i % 40) for i in range(60)], "order_id long, cust_id long")
    out = construct({"a": a, "b": b}, {"a": ["cust_id", "cust_name"], "b": ["order_id", "cust_id"]}, Constraints(primary={"a": ["cust_id"], "b": ["order_id"]}, foreign={"b.cust_id": "a"}))
    edges = {(r["l"], r["r"]): r["channels"] for r in out["edges"].collect()}
    assert edges[("a.cust_id", "b.cust_id")] == "lexical,surface_name_embedding,value_collision"
    assert out["decisions"].count() == out["queue"].count() and out["profile"].count() == 4


def test_parse_ddl():
    text = 'CREATE TABLE "a b" (\n "x y" TEXT DEFAULT \'a, (b)\' NOT NULL, z DECIMAL(10, 2), PRIMARY KEY ("x y"), FOREIGN KEY (z) REFERENCES t(q)\n);\nCREATE TABLE t (q INT);'
    assert parse_ddl(text) == [("a b", "x y", "column", "TEXT DEFAULT 'a, (b)' NOT NULL"), ("a b", "z", "column", "DECIMAL(10, 2)"), ("a b", None, "constraint", 'PRIMARY KEY ("x y")'), ("a b", None, "constraint", "FOREIGN KEY (z) REFERENCES t(q)"), ("t", "q", "column", "INT")]
    assert parse_ddl("") == parse_ddl("no table") == []


def test_checked_statements(spark):
    assert compare.validated(spark, "SELECT id FROM range(50)")["STATUS"] == "OK" and len(compare.validated(spark, "SELECT id FROM range(50)")["RESULT"]) == 30
    assert compare.validated(spark, "SELECT nothing FROM nowhere")["STATUS"] == "ERROR"
    assert compare.status(spark.sql("SELECT 1 WHERE false"), spark.sql("SELECT 1")) == "EMPTY" and compare.status(spark.sql("SELECT 1"), spark.sql("SELECT 1.0")) == "CORRECT" and compare.status(spark.sql("SELECT 2"), spark.sql("SELECT 1")) == "INCORRECT"
    cache = compare.PrintCache(2)
    for q in ("SELECT 1", "SELECT 2", "SELECT 1", "SELECT 3"):
        cache.get(spark, q)
    assert list(cache.known) == ["SELECT 1", "SELECT 3"]
