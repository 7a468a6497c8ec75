"""Usage and dialogue roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kolonnade.functions.keys import ident


def usage(responses: DataFrame) -> DataFrame:
    """(by, key, request_count, ok_count, failed_count, missing_usage_count, prompt_tokens, completion_tokens, total_tokens) by stage, model and turn, in one pass; null keys are `unknown`."""
    t = lambda f: F.sum(F.coalesce(F.col(f"token_usage.{f}"), F.lit(0))).alias(f)
    keyed = responses.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in ("stage", "model", "turn")], "ok", "token_usage")
    out = keyed.groupingSets([[F.col("stage")], [F.col("model")], [F.col("turn")]], "stage", "model", "turn").agg(
        F.grouping_id().alias("g"), F.count("*").alias("request_count"), F.count_if(F.coalesce("ok", F.lit(False))).alias("ok_count"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed_count"),
        F.count_if(F.col("token_usage").isNull()).alias("missing_usage_count"), t("prompt_tokens"), t("completion_tokens"), t("total_tokens"),
    )
    by = F.when(F.col("g") == 3, "stage").when(F.col("g") == 5, "model").otherwise("turn")
    return out.select(by.alias("by"), F.coalesce("stage", "model", "turn").alias("key"), "request_count", "ok_count", "failed_count", "missing_usage_count", "prompt_tokens", "completion_tokens", "total_tokens")


def perplexity(logprobs: Column) -> Column:
    """exp of the negative mean of log probabilities; null without any."""
    known = F.filter(logprobs, lambda x: x.isNotNull())
    return F.when(F.size(known) > 0, F.exp(-F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)))


def transcripts(requests: DataFrame) -> DataFrame:
    """(question_id, n_turns, transcript): the different prompts of a question in order of turn and id, one a line."""
    once = requests.where("question_id is not null and prompt is not null").select("question_id", "turn", ident(F.col("request_id")).alias("id"), F.regexp_replace("prompt", "\\s+", " ").alias("p")).distinct()
    line = F.concat(F.lit("Turn "), F.coalesce(F.col("turn").cast("string"), F.lit("?")), F.lit(": "), "p")
    # A question has a handful of turns.
    return once.groupBy("question_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id", line.alias("x")))), lambda s: s.x), "\n").alias("transcript"))


def latest_stage(responses: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """(question_id, turn, stage): the last stage reached, by turn, then by the order of stages."""
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    return responses.where("ok and question_id is not null").groupBy("question_id").agg(F.max(F.struct("turn", order.alias("o"), "stage")).alias("x")).select("question_id", "x.turn", "x.stage")


def elapsed(ledger: DataFrame) -> DataFrame:
    """(status, n, total_s, p50_s): times of calls by status, rounded."""
    return ledger.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("elapsed_seconds"), 3).alias("total_s"), F.round(F.expr("percentile(elapsed_seconds, 0.5)"), 6).alias("p50_s"))

