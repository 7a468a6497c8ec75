"""At-least-once delivery to exactly one row per identifier.

`MessageStore` keeps one winner per identifier in a partitioned table and takes further deliveries in
batches. A batch is reduced to one row per identifier, looked up in the identifier index, and combined
with the historical partitions the index names; only those partitions are written anew. A version becomes
visible when its manifest is renamed into place, so a reader sees either all of a batch or none of it, and
a lost executor or a failed job leaves the version before untouched.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from kolonnade.functions.keys import ident
from kolonnade.session import cut, scratch

_KEY, _HOME = "__key", "__home"
#: Segments of the index before they are written as one.
SEGMENTS = 16


class MessageStore:
    """One row per identifier, kept over batches.

    An identifier lives in the partition ("home") of its first delivery, also when later deliveries carry
    other dates. The winner is the largest `(good, seq)`; equal rows are one row. `copies` counts all
    deliveries, equal rows included. Rows whose identifier is null or blank are no messages and are left out.
    Rows with a null `seq` lose against all others; a null `good` counts as not good; a null home is the home
    "none". Payload columns may have any type and any name; they come from the winning row.
    The number of homes must be bounded (weeks or days): the manifest lists them.
    """

    def __init__(self, spark: SparkSession, path: str, index_buckets: int = 16):
        self.spark, self.path, self.index_buckets = spark, path.rstrip("/"), index_buckets
        jvm = spark.sparkContext._jvm
        self._hpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- manifest ---------------------------------------------------------------------------------

    def manifest(self) -> dict:
        """The committed state: version, version of each home, versions with an index segment."""
        folder = self._hpath(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return {"version": 0, "homes": {}, "index": []}
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        last = max((n for n in names if n.endswith(".json")), default=None)
        if last is None:
            return {"version": 0, "homes": {}, "index": []}
        stream = self._fs.open(self._hpath(f"{self.path}/manifest/{last}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, state: dict) -> None:
        name = f"{self.path}/manifest/{state['version']:012d}.json"
        tmp, final = self._hpath(name + ".tmp"), self._hpath(name)
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(state, sort_keys=True).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(tmp, final):
            raise RuntimeError(f"version {state['version']} was committed by another writer")

    # -- reading ----------------------------------------------------------------------------------

    def _homes(self, state: dict, homes: Sequence[str]) -> DataFrame | None:
        by_version: dict[int, list[str]] = {}
        for h in homes:
            by_version.setdefault(state["homes"][h], []).append(h)
        out = None
        for version, names in sorted(by_version.items()):
            part = self._data(state, version).where(F.col(_HOME).isin(names))
            out = part if out is None else out.unionByName(part)
        return out

    def _data(self, state: dict, version: int) -> DataFrame:
        # With its schema a version without rows can be read too.
        shape = T.StructType.fromJson(json.loads(state["schema"]))
        return self.spark.read.schema(shape).parquet(f"{self.path}/data/v{version}")

    def read(self) -> DataFrame | None:
        """Columns: key, copies, good, seq, payload (struct), home. None before the first batch."""
        state = self.manifest()
        found = self._homes(state, list(state["homes"]))
        return None if found is None else found.withColumnsRenamed({_KEY: "key", _HOME: "home"})

    def _index(self, state: dict, buckets: Sequence[int] | None) -> DataFrame | None:
        paths = [f"{self.path}/index/v{v}" for v in state["index"]]
        out = None
        for p in paths:
            part = self.spark.read.schema(f"{_KEY} string, home string, bucket int").parquet(p)
            part = part if buckets is None else part.where(F.col("bucket").isin(list(buckets)))
            out = part if out is None else out.unionByName(part)
        return None if out is None else out.select(_KEY, F.col("home").alias("__known"))

    # -- writing ----------------------------------------------------------------------------------

    def merge(self, batch: DataFrame, key: Column, seq: Column, good: Column, home: Column, payload: Sequence[str] = (), feed: str | None = None, number: int | None = None) -> dict:
        """Take one batch of deliveries; returns the committed manifest.

        With `feed` and `number` (ascending within a feed) a batch that was taken before is known by the manifest
        and changes nothing, so a batch that is delivered again after a failure counts once.
        """
        state = self.manifest()
        if feed is not None and number is not None and number <= state.get("taken", {}).get(feed, -1):
            return state
        version = state["version"] + 1
        rows = batch.select(
            key.alias(_KEY),
            F.coalesce(home.cast("string"), F.lit("none")).alias(_HOME),
            F.coalesce(good, F.lit(False)).alias("good"),
            seq.cast("long").alias("seq"),
            *([F.struct(*[F.col(f"`{c}`") for c in payload]).alias("payload")] if payload else []),
            F.lit(1).cast("long").alias("copies"),
        ).where(F.col(_KEY).isNotNull())
        incoming = _winners(rows, bool(payload))
        state["schema"] = incoming.schema.json()
        if state["index"]:
            # Small batches read the index buckets they touch only; the number of buckets is a parameter.
            incoming = cut(incoming.withColumn("bucket", F.pmod(F.xxhash64(_KEY), F.lit(self.index_buckets)).cast("int")))
            known = self._index(state, [r[0] for r in incoming.select("bucket").distinct().collect()])
            incoming = cut(incoming.join(known, _KEY, "left").withColumn("__new", F.col("__known").isNull()).withColumn(_HOME, F.coalesce("__known", _HOME)).drop("__known"))
            touched = [r[0] for r in incoming.select(_HOME).distinct().collect()]  # as many as there are homes
            history = self._homes(state, [h for h in touched if h in state["homes"]])
            merged = incoming.drop("bucket", "__new")
            if history is not None:
                merged = _winners(merged.unionByName(history), bool(payload))
            self._write(merged, version)
            fresh = incoming.where("__new").select("bucket", _KEY, F.col(_HOME).alias("home"))
        else:
            self._write(incoming, version)
            written = self._data(state, version)
            touched = [r[0] for r in written.select(_HOME).distinct().collect()]
            fresh = written.select(F.pmod(F.xxhash64(_KEY), F.lit(self.index_buckets)).cast("int").alias("bucket"), _KEY, F.col(_HOME).alias("home"))
        segments = [*state["index"], version]
        if len(segments) > SEGMENTS:
            # Many small segments become one.
            old = self._index(state, None).select(F.pmod(F.xxhash64(_KEY), F.lit(self.index_buckets)).cast("int").alias("bucket"), _KEY, F.col("__known").alias("home"))
            fresh, segments = fresh.unionByName(old), [version]
        fresh.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/index/v{version}")
        taken = state.get("taken", {}) | ({feed: number} if feed is not None and number is not None else {})
        state = {"version": version, "schema": state["schema"], "homes": state["homes"] | dict.fromkeys(touched, version), "index": segments, "taken": taken}
        self._commit(state)
        return state

    def _write(self, rows: DataFrame, version: int) -> None:
        # Rebalancing splits a home that holds much of the data over several tasks and joins small ones.
        rows.hint("rebalance", _HOME).write.mode("overwrite").partitionBy(_HOME).parquet(f"{self.path}/data/v{version}")


def _winners(rows: DataFrame, payload: bool) -> DataFrame:
    """One row per key; all aggregates combine before the shuffle, so a hot key costs one row per task."""
    rank = F.struct("good", F.coalesce("seq", F.lit(-(2**62))))
    return (
        rows.groupBy(_KEY)
        .agg(
            F.min(_HOME).alias(_HOME),
            F.max(F.struct("good", "seq")).alias("__top"),
            *([F.max_by("payload", rank).alias("payload")] if payload else []),
            F.sum("copies").alias("copies"),
        )
        .select(_KEY, _HOME, F.col("__top.good").alias("good"), F.col("__top.seq").alias("seq"), *(["payload"] if payload else []), "copies")
    )


def delivered_feed(decisions: DataFrame, responses: DataFrame) -> DataFrame:
    """Both feeds as (key, seq, good, home): the key carries the feed, the home its week of delivery."""

    def feed(df: DataFrame, name: str, key: str, good: Column) -> DataFrame:
        week = F.date_format(F.date_trunc("week", "delivered_at"), "yyyy-MM-dd")
        return df.select(
            F.concat(F.lit(name + "\n"), ident(F.col(key))).alias("key"),
            F.col("ingest_seq").alias("seq"),
            good.alias("good"),
            F.concat(F.lit(name + "-"), F.coalesce(week, F.lit("none"))).alias("home"),
        )

    return feed(decisions, "verifier_decisions", "candidate_id", F.col("status") == "OK").unionByName(
        feed(responses, "batch_responses", "request_id", F.col("ok"))
    )


def redelivered(decisions: DataFrame, responses: DataFrame) -> DataFrame:
    """Identifiers in more than one row, with the row that is kept.

    Each feed up to the middle of its own `ingest_seq` is loaded as history; what came later is merged as a batch
    through the index. Rows without `ingest_seq` belong to the batch. Empty tables give an empty result.
    """
    spark = decisions.sparkSession
    feed = delivered_feed(decisions, responses)
    name = F.split("key", "\n", 2)[0]
    middle = F.lit(None).cast("double")
    for feed_name, m in feed.where("key is not null").groupBy(name).agg(F.max("seq") / 2).collect():  # one row a feed
        middle = F.when(name == feed_name, F.lit(m)).otherwise(middle)
    store = MessageStore(spark, scratch(spark, "messages"))
    args = (F.col("key"), F.col("seq"), F.col("good"), F.col("home"))
    early = F.coalesce(F.col("seq") <= middle, F.lit(False))
    store.merge(feed.where(early), *args)
    store.merge(feed.where(~early), *args)
    kept = store.read()
    if kept is None:
        kept = spark.createDataFrame([], "key string, copies long, seq long")
    return kept.where("copies > 1").select(
        name.alias("feed"), F.split("key", "\n", 2)[1].alias("message_id"), F.col("seq").alias("kept_seq")
    )
