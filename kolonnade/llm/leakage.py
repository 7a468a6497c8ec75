"""Test items inside documents, by size-partitioned MinHash containment search.

The texts of the items are partitioned by their number of words. Every text keeps its least shingles (a bottom-k
MinHash sketch; rare shingles before frequent ones, ties by hash): as many as the words that may be changed can
destroy, and a few more. A document that holds the text therefore holds at least those few, in the places where
the text has them, so no text is missed. Quotes of twelve words are found by the least of each eight shingles of five words.

Documents are read once. A filter of fixed size, made of all sketches, tells which shingles of a document may be
one of a sketch; only stretches with enough of them inside a window of the partition's length go on. They meet
the sketches in a join by shingle, are counted by the place where the text would begin, and the words decide.
Nothing that grows with items or documents is held by the driver or sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from kolonnade.llm.filters import filter_of, has
from kolonnade.llm.words import Hasher, shingle_hashes, words
from kolonnade.session import cut

#: Words of a quote that leaks by itself, words that may be changed in a whole text.
QUOTE, CHANGED = 12, 4
#: Shingles of a sketch that must be found beyond those that changed words can destroy, and of a text without changes.
BEYOND, UNCHANGED = 3, 6
SIZE_STEP = 1.25
#: Greatest number of bits of the filter, as a power of two; more sketches than fit let more shingles pass, none fewer.
FILTER_BITS = 26
STREAM = 60_000
#: Shingles: runs of one, two, three and five words, and pairs with a word between; words that each spans.
RUN1, RUN2, RUN3, APART, RUN5 = 1, 2, 3, 4, 5
SPAN = {RUN1: 1, RUN2: 2, RUN3: 3, APART: 3, RUN5: 5}
QUOTES = 9_000_000


def changeable(m: int) -> int:
    """Words that may be changed in a text of m words: `CHANGED`, below eight words a third of them."""
    return CHANGED if m >= 2 * CHANGED else min(CHANGED, m // 3)


def shape(m: int, exact: bool) -> tuple[tuple[int, ...], int, int]:
    """(shingles, sketch size, least number found) of a whole text of m words."""
    spare = 0 if exact else changeable(m)
    if not spare:
        n = min(RUN3, m)
        take = min(UNCHANGED, m - n + 1)
        return (n,), take, take
    for n, least in ((RUN3, BEYOND), (RUN2, 1)):
        beyond = min(BEYOND, m - n + 1 - n * spare)
        if beyond >= least:
            return (n,), n * spare + beyond, beyond
    # Of so few words with a third or four of nine changed, two that stay are neighbours or have one word between.
    return (RUN2, APART), 2 * m, 1


def _mix(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ np.uint64(0xD6E8FEB86659FD93 * (salt + 1) % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
        return (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


def _keys(h: np.ndarray, kind: int) -> np.ndarray:
    """Hashes of all shingles of a kind, by the place where they begin."""
    if kind != APART:
        return _mix(shingle_hashes(h, kind), kind)
    with np.errstate(over="ignore"):
        return _mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ h[2:], kind) if len(h) > 2 else np.zeros(0, np.uint64)


def _class(m: int, exact: bool) -> int:
    return 2 * int(np.ceil(np.log(m) / np.log(SIZE_STEP) - 1e-9)) + exact


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item_id, exact, text) to texts with their shingles: places, keys of their kind, keys of their partition."""
    hasher = Hasher()
    for f in frames:
        rows = []
        for item, exact, text in zip(f["item_id"], f["exact"], f["text"]):
            h = hasher(words(text))
            m = len(h)
            if not m:
                continue
            kinds, take, need = shape(m, exact)
            cls = _class(m, exact)
            grams = [(k, int(p), int(key), int(ck)) for k in kinds for p, (key, ck) in enumerate(zip(_keys(h, k).view(np.int64), _mix(_keys(h, k), 16 * cls + k).view(np.int64)))]
            quotes = []
            if not exact and m >= QUOTE:
                five = _keys(h, RUN5)
                least = np.lib.stride_tricks.sliding_window_view(five, QUOTE - RUN5 + 1).argmin(axis=1) + np.arange(m - QUOTE + 1)
                quotes = [(RUN5, int(p), int(five[p].view(np.int64)), int(_mix(five[p : p + 1], QUOTES).view(np.int64)[0])) for p in np.unique(least)]
            raw = h.tobytes()
            rows.append((item, xxhash.xxh3_128_digest(raw, int(exact)), bool(exact), m, cls, take, need, raw, grams, quotes))
        yield pd.DataFrame(rows, columns=["item_id", "tid", "exact", "m", "cls", "take", "need", "words", "grams", "quotes"])


_GRAMS = "array<struct<kind:int,place:int,key:long,ckey:long>>"


@dataclass
class Partition:
    """What a document must show for one size class: kind of shingle, least number, window in words, salt of its keys."""

    kind: int
    need: int
    longest: int
    salt: int


def item_texts(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (tid, exact, m, words), their items (tid, item_id), and sketches (ckey, kind, cls, tid, place, need, m)."""
    # Questions and evidence may be changed, SQL must be held as it is.
    fields = F.explode(F.array(*[F.struct(F.lit(name == "gold_sql").alias("exact"), F.col(name).alias("text")) for name in ("question", "evidence", "gold_sql")])).alias("f")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), fields).where("item_id is not null and f.text is not null").select("item_id", "f.exact", "f.text").distinct()
    made = cut(rows.mapInPandas(_texts, f"item_id long, tid binary, exact boolean, m int, cls int, take int, need int, words binary, grams {_GRAMS}, quotes {_GRAMS}"))
    held = made.select("tid", "item_id").distinct()
    texts = made.drop("item_id").dropDuplicates(["tid"])
    grams = texts.select("tid", "cls", "m", "take", "need", F.explode("grams").alias("g")).select("tid", "cls", "m", "take", "need", "g.*")
    often = grams.groupBy("kind", "key").agg(F.floor(F.log2(F.count("*"))).alias("often"))
    order = W.partitionBy("tid").orderBy("often", "key", "place", "kind")
    whole = grams.join(often, ["kind", "key"]).withColumn("rn", F.row_number().over(order)).where("rn <= take")
    quotes = texts.select("tid", F.explode("quotes").alias("g")).select("g.ckey", "g.key", "g.kind", F.lit(QUOTES).alias("cls"), "tid", "g.place", F.lit(1).alias("need"), F.lit(QUOTE).alias("m"))
    sketches = whole.select("ckey", "key", "kind", "cls", "tid", "place", "need", "m").unionByName(quotes)
    return texts.select("tid", "exact", "m", "words"), held, cut(sketches)


def partitions(sketches: DataFrame) -> list[Partition]:
    """One a size class and kind of shingle: as many as lengths have powers of `SIZE_STEP`."""
    found = sketches.groupBy("cls", "kind").agg(F.min("need").alias("need"), F.max("m").alias("longest")).collect()
    return [Partition(r["kind"], r["need"], r["longest"], r["cls"] if r["cls"] == QUOTES else 16 * r["cls"] + r["kind"]) for r in found]


def _hits(stream: np.ndarray, doc: np.ndarray, parts: list[Partition], bitmap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, reach) of the shingles of the stream that may belong to a sketch and have enough like them nearby."""
    places, keys, reach = [], [], []
    for kind in {p.kind for p in parts}:
        span = SPAN[kind]
        if len(stream) < span:
            continue
        own = _keys(stream, kind)
        at = np.flatnonzero(has(bitmap, own))
        at = at[doc[at] == doc[at + span - 1]]
        own = own[at]
        for p in (p for p in parts if p.kind == kind):
            mine = _mix(own, p.salt)
            ok = has(bitmap, mine)
            pos, key = at[ok], mine[ok]
            if p.need > 1:
                if len(pos) < p.need:
                    continue
                near = (pos[p.need - 1 :] - pos[: len(pos) - p.need + 1] < p.longest) & (doc[pos[p.need - 1 :]] == doc[pos[: len(pos) - p.need + 1]])
                keep = np.zeros(len(pos), bool)
                for k in range(p.need):
                    keep[k : k + len(near)] |= near
                pos, key = pos[keep], key[keep]
            places.append(pos)
            keys.append(key)
            reach.append(np.full(len(pos), p.longest + span))
    if not places:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(places), np.concatenate(keys).view(np.int64), np.concatenate(reach)


def _stretches(frames: Iterator[pd.DataFrame], parts: list[Partition], bitmap) -> Iterator[pd.DataFrame]:
    """(doc_id, text) to stretches of documents that may hold a text: words and the shingles that say so."""
    hasher, bits = Hasher(), bitmap.value

    def search(ids: list[int], docs: list[np.ndarray]) -> pd.DataFrame:
        stream = np.concatenate(docs)
        sizes = np.array([len(d) for d in docs])
        first = np.cumsum(sizes) - sizes
        doc = np.repeat(np.arange(len(docs)), sizes)
        place, key, reach = _hits(stream, doc, parts, bits)
        rows = []
        if len(place):
            d = doc[place]
            low = np.maximum(place - reach, first[d])
            order = np.lexsort((low, d))
            place, key, low, d = place[order], key[order], low[order], d[order]
            high = np.minimum(place + reach[order], first[d] + sizes[d])
            # Stretches of a document that touch are one.
            edge = np.flatnonzero(np.r_[True, (low[1:] > np.maximum.accumulate(high)[:-1]) | (d[1:] != d[:-1])])
            for lo, hi in zip(edge, [*edge[1:], len(low)]):
                begin, end = low[lo], high[lo:hi].max()
                at = begin - first[d[lo]]
                raw = stream[begin:end].tobytes()
                rows.append((ids[d[lo]], int(at), xxhash.xxh3_64_digest(raw), raw, key[lo:hi], (place[lo:hi] - begin).astype(np.int32)))
        return pd.DataFrame(rows, columns=["doc_id", "at", "digest", "words", "keys", "places"])

    for frame in frames:
        ids, docs, size = [], [], 0
        for i, text in zip(frame["doc_id"], frame["text"]):
            h = hasher(words(text))
            if not len(h):
                continue
            ids.append(int(i))
            docs.append(h)
            size += len(h)
            if size >= STREAM:
                yield search(ids, docs)
                ids, docs, size = [], [], 0
        if ids:
            yield search(ids, docs)


def holds_at(doc: np.ndarray, text: np.ndarray, start: int, exact: bool) -> bool:
    """Whether words of a document hold a text whole, with few changes, or a long enough quote of it, if it begins at `start`."""
    m = len(text)
    lo, hi = max(0, -start), min(m, len(doc) - start)
    if hi <= lo:
        return False
    same = doc[start + lo : start + hi] == text[lo:hi]
    if hi - lo == m and m - np.count_nonzero(same) <= (0 if exact else changeable(m)):
        return True
    if exact or len(same) < QUOTE:
        return False
    edge = np.flatnonzero(np.diff(np.r_[0, same.astype(np.int8), 0]))
    return len(edge) > 0 and int((edge[1::2] - edge[::2]).max()) >= QUOTE


def _verified(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        ok = [
            any(holds_at(np.frombuffer(doc, np.uint64), np.frombuffer(text, np.uint64), int(s), exact) for s in starts)
            for doc, text, starts, exact in zip(f["words"], f["held"], f["starts"], f["exact"])
        ]
        yield f.loc[ok, ["doc_id", "tid"]]


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) for every document that gives away an item.

    A document gives away an item by holding its question, evidence or SQL whole (question and evidence with
    up to four changed words; of texts under eight words a third) or twelve consecutive words of question or
    evidence. Words are compared without case, punctuation, white space, markup, invisible characters and
    compatibility forms. Texts of one word count. Null texts and ids are left out, empty texts hold nothing,
    repeated rows and further columns change nothing; without items or documents the result is empty.
    """
    spark = documents.sparkSession
    texts, held, sketches = item_texts(items)
    bitmap, parts = spark.sparkContext.broadcast(filter_of(sketches, ["key", "ckey"], FILTER_BITS)), partitions(sketches)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    stretches = cut(rows.mapInPandas(lambda fs: _stretches(fs, parts, bitmap), "doc_id long, at int, digest binary, words binary, keys array<long>, places array<int>"))
    where = ["doc_id", "at", "digest"]
    hits = stretches.select(*where, F.explode(F.arrays_zip("keys", "places")).alias("h")).select(*where, F.col("h.keys").alias("ckey"), F.col("h.places").alias("pos")).distinct()
    met = hits.join(sketches.select("ckey", "cls", "tid", "place", "need"), "ckey").groupBy(*where, "tid", "cls", (F.col("pos") - F.col("place")).alias("start")).agg(F.count("*").alias("n"), F.max("need").alias("need"))
    # Places are as many as the stretch has shingles of the sketch.
    found = met.where("n >= need").groupBy(*where, "tid").agg(F.collect_set("start").alias("starts"))
    both = found.join(stretches.select(*where, "words").dropDuplicates(where), where).join(texts.select("tid", "exact", F.col("words").alias("held")), "tid")
    sure = both.select("doc_id", "tid", "words", "held", "starts", "exact").mapInPandas(_verified, "doc_id long, tid binary").distinct()
    return sure.join(held, "tid").select("doc_id", F.col("item_id").cast("int").alias("item_id")).distinct()
