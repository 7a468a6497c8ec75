"""Mixing sources to target weights of tokens.

The documents of each source are counted by exact length in tokens. The total is the largest at which every
source that has documents reaches its share within its allowed repeats. A source's budget is filled by whole
passes over all its texts first; what remains is taken from each length in proportion, and the last stretch
is fitted by a bounded subset-sum over the lengths that are left, so that the budget is met to the token
wherever the lengths allow it. How many documents of each length to take is decided on counts alone; which
ones follows from a seeded hash.

Counts go to one task a source; there are at most as many as there are different lengths.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from kolonnade.session import cut

#: Where the vocabulary files lie and which one counts; both are parameters.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into pieces before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEED = 11
#: Tokens fitted exactly at the end of a budget, at least this many times the longest text.
FITTED = 4


def source_key(c: Column) -> Column:
    """Sources are the same if their letters and digits agree, whatever case, blanks, hyphens and underscores."""
    key = F.regexp_replace(F.lower(c), "[\\s\\u00a0_\\-\\u2010-\\u2015]+", "")
    return F.when(key != "", key)


def _count(frames: Iterator[pd.DataFrame], folder: str, vocabulary: str) -> Iterator[pd.DataFrame]:
    import tiktoken

    with open(os.path.join(folder, vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    for f in frames:
        yield f[["doc_id", "source", "h"]].assign(n_tokens=[len(encoding.encode_ordinary(t)) for t in f["text"]])


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, source, h, n_tokens) of documents with a text and a source; each text once a source.

    Of equal texts of a source the least `doc_id` stands for all, so that no text is used more often than
    allowed. `h` is the seeded order. Empty texts have no tokens and are left out.
    """
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source_key(F.col("source")).alias("source"), "text").where("doc_id is not null and source is not null and length(text) > 0")
    # Copies are found by two hashes and the length, so that texts travel no further than their task.
    once = keyed.groupBy("source", F.xxhash64("text").alias("t1"), F.hash("text").alias("t2"), F.length("text").alias("t3")).agg(F.min("doc_id").alias("doc_id"))
    firsts = keyed.withColumns({"t1": F.xxhash64("text"), "t2": F.hash("text"), "t3": F.length("text")}).join(once, ["source", "t1", "t2", "t3", "doc_id"], "left_semi").dropDuplicates(["source", "doc_id"])
    rows = firsts.select("doc_id", "source", F.xxhash64(F.lit(SEED), "doc_id", "t1").alias("h"), "text")
    return rows.mapInPandas(lambda fs: _count(fs, folder, vocabulary), "doc_id long, source string, h long, n_tokens int").where("n_tokens > 0")


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length (distinct, ascending) to take so that the total comes as near to `budget` as can be from below."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    reserve = int(min(budget, FITTED * lengths.max()))
    take = (counts * max(0, budget - reserve)) // max(1, total)
    left = budget - int((lengths * take).sum())
    # Long texts first bring the rest down to the reserve.
    for i in np.argsort(-lengths, kind="stable"):
        if left <= reserve:
            break
        n = min(int(counts[i] - take[i]), (left - reserve) // int(lengths[i]))
        take[i] += n
        left -= n * int(lengths[i])
    # Bounded subset sum: counts split into powers of two; `by` remembers the piece that first reached a sum.
    pieces: list[tuple[int, int]] = []
    for i in np.flatnonzero((counts > take) & (lengths <= left)):
        n, step = min(int(counts[i] - take[i]), left // int(lengths[i])), 1
        while n > 0:
            pieces.append((int(i), min(step, n)))
            n -= step
            step *= 2
    reached, by = np.zeros(left + 1, bool), np.full(left + 1, -1, np.int64)
    reached[0] = True
    for p, (i, n) in enumerate(pieces):
        w = int(lengths[i]) * n
        if w > left:
            continue
        new = reached[: left + 1 - w] & ~reached[w:]
        by[w:][new] = p
        reached[w:] |= new
        if reached[left]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n = pieces[by[at]]
        take[i] += n
        at -= int(lengths[i]) * n
    return take


def _fitted(frame: pd.DataFrame) -> pd.DataFrame:
    """One source: (source, n_tokens, n_docs, budget, allowed) to (source, n_tokens, passes, extra)."""
    frame = frame.sort_values("n_tokens")
    lengths, counts = frame["n_tokens"].to_numpy(np.int64), frame["n_docs"].to_numpy(np.int64)
    budget, allowed = int(frame["budget"].iloc[0]), int(frame["allowed"].iloc[0])
    whole = int((lengths * counts).sum())
    passes = min(allowed, budget // whole)
    extra = fit_counts(lengths, counts, budget - passes * whole) if passes < allowed else np.zeros_like(counts)
    return pd.DataFrame({"source": frame["source"], "n_tokens": lengths, "passes": passes, "extra": extra})


def plan(counted: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Budgets per source and documents to take per (source, length).

    Targets of one source (whatever its spelling) are added up, of their repeats the least counts; null or
    non-positive shares want nothing, null repeats mean one use. Shares are taken relative to those of the
    sources that have documents. `total`: tokens of the mixture; without it as many as all shares allow.
    """
    wanted = targets.select(source_key(F.col("source")).alias("source"), F.col("source").alias("name"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.coalesce("max_repeats", F.lit(1)).alias("allowed")).where("source is not null").distinct()
    wanted = wanted.groupBy("source").agg(F.min("name").alias("name"), F.sum(F.greatest("share", F.lit(0.0))).alias("target_share"), F.greatest(F.min("allowed"), F.lit(0)).alias("allowed"))
    histogram = cut(counted.groupBy("source", "n_tokens").agg(F.count("*").alias("n_docs")))
    sizes = histogram.groupBy("source").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    budgets = wanted.join(sizes, "source", "left").na.fill(0, ["docs", "tokens"])
    live = (F.col("tokens") > 0) & (F.col("allowed") > 0) & (F.col("target_share") > 0)
    # One row per source wanted.
    budgets = cut(budgets.withColumn("live", live))
    shares = budgets.where("live").agg(F.sum("target_share").alias("sum"), F.min(F.col("tokens") * F.col("allowed") / F.col("target_share")).alias("per")).first()
    whole = shares["sum"] or 1.0
    size = int(total if total is not None else (shares["per"] or 0) * whole)
    budgets = budgets.withColumn("share", F.when(F.col("live"), F.col("target_share") / F.lit(whole)).otherwise(0.0))
    budgets = budgets.withColumn("budget", F.least(F.floor(F.col("share") * F.lit(float(size)) + 1e-6), F.col("tokens") * F.col("allowed")).cast("long"))
    lengths = histogram.join(budgets.where("live").select("source", "budget", "allowed"), "source").select("source", "n_tokens", "n_docs", "budget", F.col("allowed").cast("int"))
    taken = lengths.groupBy("source").applyInPandas(_fitted, "source string, n_tokens int, passes int, extra long")
    return budgets, cut(taken)


def selection(counted: DataFrame, taken: DataFrame) -> DataFrame:
    """(source, doc_id, n_tokens, n_uses) of the documents that are used.

    The extra documents of a length are those first in the seeded order. A length may hold most documents of
    a source, so ranks are made of the counts of hash stretches and the rank inside a stretch.
    """
    rows = counted.join(taken, ["source", "n_tokens"])
    some = rows.where("passes > 0 or extra > 0").withColumn("stretch", F.shiftrightunsigned("h", 58).cast("int"))
    per = cut(some.groupBy("source", "n_tokens", "stretch").agg(F.count("*").alias("n")))
    before = per.withColumn("before", F.sum("n").over(W.partitionBy("source", "n_tokens").orderBy("stretch").rowsBetween(W.unboundedPreceding, -1))).select("source", "n_tokens", "stretch", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = some.join(before, ["source", "n_tokens", "stretch"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("source", "n_tokens", "stretch").orderBy("h", "doc_id")))
    uses = (F.col("passes") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)).cast("int")
    return ranked.select("source", "doc_id", "n_tokens", uses.alias("n_uses")).where("n_uses > 0")


def mixture(documents: DataFrame, targets: DataFrame, total: int | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The selection (source, doc_id, n_tokens, n_uses) and the report on shares.

    Report, one row per source wanted: source, target_share (as given), share (relative to sources with
    documents), docs, tokens, max_repeats, budget, used_docs, used_tokens, actual_share. Sources without
    documents have zeros; documents without a target are not used; without documents or targets nothing is.
    """
    counted = cut(token_counts(documents, folder, vocabulary))
    budgets, taken = plan(counted, targets, total)
    chosen = cut(selection(counted, taken))
    used = chosen.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long") * F.col("n_uses")).alias("used_tokens"), F.count("*").alias("used_docs"))
    all_used = chosen.agg(F.sum(F.col("n_tokens").cast("long") * F.col("n_uses")).alias("x")).first()["x"] or 0
    report = budgets.join(used, "source", "left").select(
        F.col("name").alias("source"), "target_share", "share", "docs", "tokens", F.col("allowed").alias("max_repeats"), "budget",
        F.coalesce("used_docs", F.lit(0)).alias("used_docs"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.when(F.lit(all_used) > 0, F.coalesce("used_tokens", F.lit(0)) / F.lit(all_used)).otherwise(0.0).alias("actual_share"),
    )
    return chosen, report
