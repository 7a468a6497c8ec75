import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from kolonnade.operators.delivery import MessageStore, redelivered
from kolonnade.session import scratch
from kolonnade.streaming.streams import merge_stream

SHAPE = "k string, seq long, good boolean, home string, note map<string,string>, seq2 string"


def winners(rows):
    out = {}
    for k, seq, good, *_ in rows:
        if k is None:
            continue
        rank = (bool(good), seq if seq is not None else -(2**63))
        n, best = out.get(k, (0, None))
        out[k] = (n + 1, max(best, rank) if best else rank)
    return {k: (n, b[1] if b[1] > -(2**63) else None) for k, (n, b) in out.items()}


def merge(store, df, payload=("note", "seq2")):
    return store.merge(df, F.col("k"), F.col("seq"), F.col("good"), F.col("home"), payload)


def rows_of(seed, n, start=0):
    rng = random.Random(seed)
    return [(rng.choice([None, "hot", "hot", f"id{rng.randrange(40)}"]), start + i if rng.random() < 0.97 else None, rng.choice([True, False, None]), rng.choice(["a", "b", None]), {"x": str(i)}, "s") for i in range(n)]


def test_batches_give_the_winners_of_all_rows(spark):
    store = MessageStore(spark, scratch(spark, "t"))
    seen = []
    for b in range(3):
        rows = rows_of(b, 120, 1000 * b)
        seen += rows + rows[:5]
        merge(store, spark.createDataFrame(rows + rows[:5], SHAPE))
    got = {r["key"]: (r["copies"], r["seq"]) for r in store.read().collect()}
    assert got == winners(seen)


def test_payload_comes_from_the_winner(spark):
    store = MessageStore(spark, scratch(spark, "t"))
    merge(store, spark.createDataFrame([("a", 1, True, "h", {"v": "1"}, "p"), ("a", 2, False, "h", {"v": "2"}, "q")], SHAPE))
    merge(store, spark.createDataFrame([("a", 3, True, "z", {"v": "3"}, "r"), ("a", 9, False, "z", {"v": "9"}, "t")], SHAPE))
    (row,) = store.read().collect()
    assert (row["payload"]["note"], row["payload"]["seq2"], row["home"], row["copies"]) == ({"v": "3"}, "r", "h", 4)


def test_only_affected_homes_are_rewritten(spark):
    store = MessageStore(spark, scratch(spark, "t"))
    merge(store, spark.createDataFrame([("a", 1, True, "h1", None, ""), ("b", 1, True, "h2", None, "")], SHAPE))
    state = merge(store, spark.createDataFrame([("a", 2, True, "h9", None, ""), ("c", 2, True, "h3", None, "")], SHAPE))
    assert state["homes"] == {"h1": 2, "h2": 1, "h3": 2}


def test_a_batch_is_visible_only_after_its_manifest(spark, monkeypatch):
    store = MessageStore(spark, scratch(spark, "t"))
    merge(store, spark.createDataFrame([("a", 1, True, "h", None, "")], SHAPE))
    monkeypatch.setattr(store, "_commit", lambda state: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        merge(store, spark.createDataFrame([("a", 5, True, "h", None, "")], SHAPE))
    assert [r["seq"] for r in MessageStore(spark, store.path).read().collect()] == [1]


def test_empty_batches(spark):
    store = MessageStore(spark, scratch(spark, "t"))
    assert store.read() is None
    merge(store, spark.createDataFrame([], SHAPE))
    merge(store, spark.createDataFrame([("a", 1, True, "h", None, "")], SHAPE))
    merge(store, spark.createDataFrame([], SHAPE))
    assert store.read().count() == 1


def test_stream_of_batches(spark):
    path = scratch(spark, "in")
    rows = [(r[0], r[1], r[2], r[3]) for r in rows_of(7, 200)]
    for part in (rows[:90], rows[90:]):
        spark.createDataFrame(part, "key string, seq long, good boolean, home string").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("key string, seq long, good boolean, home string").option("maxFilesPerTrigger", 1).parquet(path)
    store = MessageStore(spark, scratch(spark, "t"))
    merge_stream(stream, store, scratch(spark, "state")).awaitTermination()
    assert {r["key"]: (r["copies"], r["seq"]) for r in store.read().collect()} == winners(rows)


def feeds(spark, decisions, responses):
    t = dt.datetime(2031, 3, 1)
    d = spark.createDataFrame([(k, s, ok, t, "extra") for k, s, ok in decisions], "candidate_id string, ingest_seq long, status string, delivered_at timestamp, key string")
    r = spark.createDataFrame([(k, s, ok, None) for k, s, ok in responses], "request_id string, ingest_seq long, ok boolean, delivered_at timestamp")
    return redelivered(d, r)


def test_redelivered(spark):
    got = feeds(
        spark,
        [(" A ", 1, "OK"), ("a", 2, "ERROR"), ("a", 2, "ERROR"), ("b", 3, None), ("b", 4, None), ("c", 5, "OK"), (None, 6, "OK"), (None, 7, "OK"), ("  ", 8, "OK"), ("\t", 9, "OK")],
        [("a", 1, False), ("A", 7, False)],
    )
    assert sorted(map(tuple, got.collect())) == [("batch_responses", "a", 7), ("verifier_decisions", "a", 1), ("verifier_decisions", "b", 4)]


def test_both_feeds_have_history_and_batch(spark, monkeypatch):
    taken, whole = [], MessageStore.merge

    def merge_seen(self, batch, *args):
        taken.append(sorted((r["key"].split("\n")[0][0], r["seq"]) for r in batch.where("key is not null and seq is not null").collect()))
        return whole(self, batch, *args)

    monkeypatch.setattr(MessageStore, "merge", merge_seen)
    got = feeds(spark, [("a", 10, "OK"), ("a", 100, "OK"), ("b", 90, None)], [("a", 1, True), ("a", 4, False), ("c", 3, True), ("c", None, True)])
    assert sorted(map(tuple, got.collect())) == [("batch_responses", "a", 1), ("batch_responses", "c", 3), ("verifier_decisions", "a", 100)]
    assert taken == [[("b", 1), ("v", 10)], [("b", 3), ("b", 4), ("v", 90), ("v", 100)]]


def test_only_touched_buckets_of_the_index_are_read(spark, monkeypatch):
    store, read, whole = MessageStore(spark, scratch(spark, "t")), [], MessageStore._index
    monkeypatch.setattr(MessageStore, "_index", lambda self, state, buckets: read.append(buckets) or whole(self, state, buckets))
    merge(store, spark.createDataFrame([(f"k{i}", i, True, "h", None, "") for i in range(100)], SHAPE))
    merge(store, spark.createDataFrame([("k7", 200, True, "h", None, ""), ("k7", 201, False, "z", None, "")], SHAPE))
    (bucket,) = spark.range(1).select(F.pmod(F.xxhash64(F.lit("k7")), F.lit(16)).cast("int")).first()
    assert read == [[bucket]]
    assert {r["key"]: r["copies"] for r in store.read().collect()} == {f"k{i}": 3 if i == 7 else 1 for i in range(100)}


def test_a_batch_taken_again_changes_nothing(spark):
    store = MessageStore(spark, scratch(spark, "t"))
    first = spark.createDataFrame([("a", 1, True, "h", None, "p"), ("b", 2, True, "h", None, "q")], SHAPE)
    args = (F.col("k"), F.col("seq"), F.col("good"), F.col("home"), ("note", "seq2"))
    for number in (0, 0, 1, 0, 1):
        store.merge(first.where(F.lit(number == 0) | (F.col("k") == "a")), *args, feed="f", number=number)
    assert {r["key"]: (r["copies"], r["seq"]) for r in store.read().collect()} == {"a": (2, 1), "b": (1, 2)}
    assert store.manifest()["version"] == 2


def test_segments_of_the_index_are_written_as_one(spark, monkeypatch):
    from kolonnade.operators import delivery

    monkeypatch.setattr(delivery, "SEGMENTS", 2)
    store, seen = MessageStore(spark, scratch(spark, "t")), []
    for b in range(5):
        seen += rows_of(b, 40, 100 * b)
        state = merge(store, spark.createDataFrame(seen[-40:], SHAPE))
    assert len(state["index"]) <= 2
    assert {r["key"]: (r["copies"], r["seq"]) for r in store.read().collect()} == winners(seen)


def test_redelivered_empty(spark):
    assert feeds(spark, [], []).count() == 0
