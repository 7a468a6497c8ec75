"""All similar pairs of sets by recursive chosen paths.

In every tree a set follows each of its tokens with probability 1 / (threshold * size), decided by a hash of
the path and the token that all sets share: two sets at the threshold are expected to meet in at least one
child of a node they share. Nodes with few sets are compared all against all by sketches of one-bit
minima, larger ones branch again. There are as many trees as the worst pairs need for the wanted recall where
they stay in large nodes down to the last level. Survivors are verified on the whole sets.

Equal sets are one set in the trees. A node that is still large at the last level (sets that share nearly
everything) is compared in blocks, so no task gets more than two blocks and no pair of the node is lost.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from kolonnade.functions.text import MISSING
from kolonnade.llm.batches import whole_groups
from kolonnade.session import cut

LEAF = 128
LEVELS = 6
BLOCK = 512
SKETCH_WORDS = 4
RECALL = 0.999


def trees_for(recall: float, levels: int) -> int:
    """Trees that bring a pair at the threshold together on the last level with probability `recall`.

    The worst pair is a set inside another: one common child a node is expected, Poisson at most as badly spread.
    """
    lost = 0.0
    for _ in range(levels):
        lost = math.exp(lost - 1)
    return math.ceil(math.log(1 - recall) / math.log(lost))


TREES = trees_for(RECALL, LEVELS)


def normal_value(v: str) -> str:
    """NFKC, case folded, trimmed, white space collapsed."""
    if not v.isascii():
        v = unicodedata.normalize("NFKC", v).casefold()
        v = unicodedata.normalize("NFKC", v) if not v.isascii() else v
    else:
        v = v.lower()
    return " ".join(v.split())


def _sketches(tokens: list[np.ndarray]) -> np.ndarray:
    """(n, words) bits of the least hash of each set under 64 * words hash functions."""
    rng = np.random.default_rng(20)
    flat = np.concatenate(tokens).astype(np.uint64)
    starts = np.cumsum([0, *[len(t) for t in tokens[:-1]]])
    flat ^= flat >> np.uint64(32)
    out = np.zeros((len(tokens), SKETCH_WORDS), np.uint64)
    with np.errstate(over="ignore"):
        for w in range(SKETCH_WORDS):
            for bit in range(64):
                a, b = rng.integers(1, 2**63, 2, dtype=np.uint64)
                h = flat * (a | np.uint64(1)) + b
                h ^= h >> np.uint64(29)
                least = np.minimum.reduceat(h * np.uint64(0xBF58476D1CE4E5B9), starts)
                out[:, w] |= ((least >> np.uint64(33)) & np.uint64(1)) << np.uint64(bit)
    return out


def _prepared(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    missing = set(MISSING)
    for frame in frames:
        for at in range(0, len(frame), 2000):
            f = frame.iloc[at : at + 2000]
            ids, sets = [], []
            for i, values in zip(f["id"], f["values"]):
                words = {normal_value(v) for v in values if v is not None} - missing
                if len(words) >= least:
                    ids.append(i)
                    sets.append(np.sort(np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)).view(np.int64))
            if ids:
                sketch = _sketches(sets)
                yield pd.DataFrame(
                    {
                        "id": ids,
                        "sid": [hashlib.blake2b(np.sort(t).tobytes(), digest_size=16).digest() for t in sets],
                        "tokens": sets,
                        "size": [len(t) for t in sets],
                        "sketch": [r.tobytes() for r in sketch],
                    }
                )


def _compared(frames: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Pairs within each node whose sizes and sketches allow the threshold."""
    bits = 64 * SKETCH_WORDS
    agree = (1 + threshold) / 2
    most = bits - bits * agree + 4.5 * np.sqrt(bits * agree * (1 - agree))
    for frame in whole_groups(frames, "path"):
        path = frame["path"].to_numpy()
        sid = frame["sid"].to_numpy()
        size = frame["size"].to_numpy().astype(np.float64)
        sketch = np.frombuffer(b"".join(frame["sketch"]), np.uint64).reshape(-1, SKETCH_WORDS)
        live = np.arange(len(path) - 1)
        step, left, right = 1, [], []
        while len(live):
            live = live[live + step < len(path)]
            live = live[path[live] == path[live + step]]
            other = live + step
            fits = np.minimum(size[live], size[other]) >= threshold * np.maximum(size[live], size[other])
            i, j = live[fits], other[fits]
            near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1) <= most
            left.append(i[near])
            right.append(j[near])
            step += 1
        if left:
            i, j = np.concatenate(left), np.concatenate(right)
            pairs = {(sid[x], sid[y]) if sid[x] < sid[y] else (sid[y], sid[x]) for x, y in zip(i, j) if sid[x] != sid[y]}
            if pairs:
                a, b = zip(*pairs)
                yield pd.DataFrame({"a": a, "b": b})


def distinct_sets(rows: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(id, values array<string>) to sets (sid, tokens, size, sketch) and membership (id, sid)."""
    ready = cut(rows.mapInPandas(lambda fs: _prepared(fs, least), "id long, sid binary, tokens array<long>, size int, sketch binary"))
    sets = cut(ready.groupBy("sid").agg(F.first("tokens").alias("tokens"), F.first("size").alias("size"), F.first("sketch").alias("sketch")))
    return sets, ready.select("id", "sid").distinct()


def similar_sets(sets: DataFrame, threshold: float, trees: int = TREES) -> DataFrame:
    """Pairs (a < b) of `sets` with Jaccard similarity of at least `threshold`, verified on all tokens."""
    chance = F.lit(2.0**62 / threshold) / F.col("size")
    first = F.flatten(
        F.transform(
            F.array(*[F.lit(1000003 * r) for r in range(1, trees + 1)]),
            lambda r: F.transform(F.filter("tokens", lambda t: F.shiftrightunsigned(F.xxhash64(r, t), 2) < chance), lambda t: F.xxhash64(t, r)),
        )
    )
    rows = sets.select("sid", F.explode(first).alias("path"))
    leaves: DataFrame | None = None
    for level in range(1, LEVELS + 1):
        rows = cut(rows)
        counted = rows.groupBy("path").count().where("count > 1")
        large = cut(counted.where(F.col("count") > LEAF))
        small = rows.join(counted.where(F.col("count") <= LEAF).select("path"), "path", "left_semi")
        leaves = small if leaves is None else leaves.unionByName(small)
        if large.isEmpty():
            break
        if level == LEVELS:
            blocks = F.ceil(F.col("count") / BLOCK).cast("int")
            mine = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
            dense = rows.join(large.select("path", blocks.alias("blocks")), "path").withColumn("i", mine)
            dense = dense.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            leaves = leaves.unionByName(dense.select("sid", F.xxhash64("path", F.least("i", "j"), F.greatest("i", "j")).alias("path")))
            break
        deeper = rows.join(large.select("path"), "path", "left_semi").join(sets.select("sid", "tokens", "size"), "sid")
        rows = deeper.select(
            "sid",
            F.explode(F.transform(F.filter("tokens", lambda t: F.shiftrightunsigned(F.xxhash64(F.col("path"), t), 2) < chance), lambda t: F.xxhash64(t, F.col("path")))).alias("path"),
        )
    nodes = leaves.join(sets.select("sid", "size", "sketch"), "sid")
    nodes = nodes.repartition("path").sortWithinPartitions("path")
    pairs = nodes.mapInPandas(lambda fs: _compared(fs, threshold), "a binary, b binary").distinct()
    both = pairs.join(sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a").join(sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    # shared / union >= threshold, without rounding the quotient down below an exact fraction
    return both.where(shared / (F.size("ta") + F.size("tb") - shared) >= threshold - 1e-12).select("a", "b")


def domain_values(domains: DataFrame) -> DataFrame:
    """(id, values): the values of a record, or the keys of its representatives where the array is null."""
    return domains.select(F.col("domain_id").cast("long").alias("id"), F.coalesce("normalized_values", F.map_keys("representatives")).alias("values")).where("id is not null and values is not null")


def similar_domains(domains: DataFrame, threshold: float = 0.6, least: int = 5, trees: int = TREES) -> DataFrame:
    """Pairs (domain_id_a < domain_id_b) of records with at least `least` values and Jaccard similarity of at least `threshold`.

    The result is defined on records, so copies of one set come out as pairs too; the join itself works on
    distinct sets. Nulls and missing tokens are no values; null arrays fall back to the representatives;
    records with fewer values, null ids and further columns are ignored; empty tables give empty results.
    """
    sets, members = distinct_sets(domain_values(domains), least)
    members = cut(members)
    pairs = similar_sets(sets, threshold, trees)
    a = members.select(F.col("id").alias("x"), F.col("sid").alias("a"))
    b = members.select(F.col("id").alias("y"), F.col("sid").alias("b"))
    across = pairs.join(a, "a").join(b, "b").select("x", "y")
    # Copies of one set, in blocks: a set that many records hold gathers in no task.
    blocks = members.groupBy("sid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").select("sid", "blocks")
    copies = members.join(blocks, "sid")
    x = copies.select("sid", F.col("id").alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    y = copies.select("sid", F.col("id").alias("y"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    within = x.join(y, ["sid", "block"]).select("x", "y")
    return across.unionByName(within).where("x <> y").select(F.least("x", "y").alias("domain_id_a"), F.greatest("x", "y").alias("domain_id_b")).distinct()


def domain_classes(domains: DataFrame, threshold: float = 0.6, least: int = 5, trees: int = TREES) -> DataFrame:
    """(domain_id, class_id, n_links): records of equal sets are a class, named by its least record; links are the other records similar to one.

    Nothing is expanded into pairs of records. Rows as in `similar_domains`; a record without links has 0.
    """
    sets, members = distinct_sets(domain_values(domains), least)
    members = cut(members)
    classes = cut(members.groupBy("sid").agg(F.min("id").alias("class_id"), F.count("*").alias("n")))
    pairs = similar_sets(sets, threshold, trees)
    both = pairs.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select(F.col("p.a").alias("sid"), F.col("p.b").alias("other"))
    linked = both.join(classes.select(F.col("sid").alias("other"), "n"), "other").groupBy("sid").agg(F.sum("n").alias("others"))
    links = classes.join(linked, "sid", "left").select("sid", "class_id", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(links, "sid").select(F.col("id").alias("domain_id"), "class_id", "n_links")
