"""Proposals of all channels, united by pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from kolonnade.operators.numbering import numbered

#: Channels in their order, and the channels of each view.
CHANNELS = ("lexical", "surface_name_embedding", "schema_embedding", "value_collision")
VIEWS = {"surface": ("lexical", "surface_name_embedding"), "schema": ("schema_embedding",), "value": ("value_collision",)}


def channel(df: DataFrame, name: str, score: str) -> DataFrame:
    """(channel, proposal_id, l, r, score) from rows (candidate_id, l, r, score column)."""
    return df.select(F.lit(name).alias("channel"), F.col("candidate_id").alias("proposal_id"), F.least("l", "r").alias("l"), F.greatest("l", "r").alias("r"), F.col(score).cast("double").alias("score"))


def united(channels: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), channels)


def without_view(proposals: DataFrame, view: str) -> DataFrame:
    return proposals.where(~F.col("channel").isin(*VIEWS[view]))


def bundles(proposals: DataFrame) -> DataFrame:
    """(candidate_id, queue_position, l, r, n_proposals, channels, best_score): one row a pair, numbered by pair; channels in order.

    Several proposals of one pair in one channel count each; a pair has few, as there are few channels.
    """
    order = F.array_position(F.array(*map(F.lit, CHANNELS)), F.col("channel"))
    per = proposals.where("l <> r").withColumn("o", order).groupBy("l", "r").agg(F.count("*").alias("n_proposals"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("o", "channel"))), lambda x: x.channel), ",").alias("channels"), F.round(F.max("score"), 6).alias("best_score"))
    return numbered(per, "queue_position", "l", "r").select(F.format_string("cand_%06d", "queue_position").alias("candidate_id"), "queue_position", "l", "r", "n_proposals", "channels", "best_score")


def with_context(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """Pairs with type and keys of both ends."""
    side = lambda s: columns.select(F.col("ref").alias(s), F.col("tab").alias(f"{s}_tab"), F.col("data_type").alias(f"{s}_type"), F.col("primary_key").alias(f"{s}_primary_key"))
    return pairs.join(side("l"), "l").join(side("r"), "r")


def key_facts(pairs: DataFrame, columns: DataFrame) -> DataFrame:
    """(l, r, child, parent): declared foreign keys between the ends of pairs, in either direction."""
    links = columns.where("fk_ref is not null").select(F.col("ref").alias("child"), F.col("fk_ref").alias("parent"))
    keyed = links.withColumns({"l": F.least("child", "parent"), "r": F.greatest("child", "parent")})
    return pairs.select("l", "r").distinct().join(keyed, ["l", "r"]).select("l", "r", "child", "parent")


def pair_counts(columns: DataFrame) -> DataFrame:
    """(db_id, n_columns, n_pairs): the size of the universe of unordered pairs, without making them."""
    per = columns.groupBy("db_id").agg(F.countDistinct("ref").alias("n_columns"))
    return per.withColumn("n_pairs", F.expr("n_columns * (n_columns - 1) div 2"))


def pairs_of_table(columns: DataFrame) -> DataFrame:
    """(l, r): unordered pairs of columns of one table; tables have few columns."""
    a, b = columns.select("tab", F.col("ref").alias("l")), columns.select("tab", F.col("ref").alias("r"))
    return a.join(b, "tab").where("l < r").select("l", "r")
