"""Nearest vectors by random cells and shifted space-filling curves.

Every curve has its own random cells: a vector is in that of the nearest of some random orthogonal directions. Their number grows
with that of the vectors, so that a cell holds about `RANGE_ROWS` of them, of whatever size the table is. Finer cells
of about a window part it, and inside these vectors stand by the Hilbert index of a few other random directions. Curves are cut into key
ranges of whole cells; a cell too large for a range is cut by sampled quantiles, and each part also receives the first stretch of the next one.
In each range a window slides over the ordered vectors and keeps, for every vector, the best of its window; in large tables
it slides again over the same vectors in the order of other fine cells. The windows of all curves are merged and ranked
by exact cosines. One shuffle serves all curves.

Keys are fine enough to order the inside of a cluster of near-copies, on every curve another way, and ranges are
split on them. Where cosines tie, the least identifiers win, wherever they stand in the cluster: a cell with more
vectors than a window is led by as many of its least identifiers, and all its vectors are compared with them.

Vectors of one direction (equal to nine decimals) are one point of the curves; their identifiers come back
in the ranking, so copies neither fill windows nor make pairs among all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from kolonnade.session import cut

CURVES, AXES, BITS = 24, 6, 20
#: Bytes of a key that make a cell, for one curve after the other: widths of about 3e-3, 5e-4 and 8e-5 on unit vectors.
CELL_BYTES = (6, 8, 10)
#: Bytes in front of the Hilbert index: two for the cell of a range, one for the finer cell.
LEAD = 3
WINDOW = 256
RANGE_ROWS = 30_000
#: Orders of a range besides that of the keys; one for every four ranges, so many at most.
AGAIN = 2
HALO = 1 / 16
SPREAD = 3.5


def _walk(cells: np.ndarray, bits: int) -> np.ndarray:
    """(axes, n) numbers whose bits, axis by axis and the highest first, make the Hilbert index: Gray code, axis by axis and bit by bit."""
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for b in range(bits - 1, 0, -1):
        mask, low = 1 << b, (1 << b) - 1
        for i in range(axes):
            flip = (x[i] & mask) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    parity = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        parity ^= np.where((x[-1] & (1 << b)) != 0, (1 << b) - 1, 0)
    return x ^ parity


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, axes), `axes * bits` <= 62."""
    x = _walk(cells, bits)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def hilbert_bytes(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, axes) as byte strings in the order of the index, of any length."""
    x = _walk(cells, bits)
    digits = (x.T[:, None, :] >> np.arange(bits - 1, -1, -1)[:, None]) & 1
    packed = np.packbits(digits.reshape(len(cells), bits * len(x)).astype(np.uint8), axis=1)
    return np.ascontiguousarray(packed).view(f"S{packed.shape[1]}").ravel()


@lru_cache(maxsize=512)
def _turn(dim: int, *seed: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))[0].astype(np.float32)


def direction_cells(short: np.ndarray, many: float, *seed: int) -> np.ndarray:
    """Numbers of about `many` cells for unit vectors in single precision: the nearest of random directions and their opposites, of several such sets where one has too few."""
    out, dim, level = np.zeros(len(short), np.int64), short.shape[1], 0
    while many >= 2:
        axes = min(dim, round(many / 2))
        spot = short @ _turn(dim, *seed, level)[:, :axes]
        at = np.abs(spot).argmax(axis=1)
        out = out * (2 * axes) + 2 * at + (spot[np.arange(len(at)), at] < 0)
        many, level = many / (2 * axes), level + 1
    return out


def curve_keys(unit: np.ndarray, curves: int, seed: int, coarse: float = 0, fine: float = 0) -> np.ndarray:
    """(n, curves) keys of unit vectors as byte strings: about `coarse` and `fine` cells, Hilbert index; the same seed gives the same curves everywhere."""
    rng, dim = np.random.default_rng(seed), unit.shape[1]
    axes, short = min(AXES, dim), unit.astype(np.float32)
    width = -(-BITS * axes // 8)
    raw = np.zeros((len(unit), curves, LEAD + width), np.uint8)
    for t in range(curves):
        axis = np.linalg.qr(rng.standard_normal((dim, axes)))[0]
        spot = unit @ axis * np.sqrt(dim) + SPREAD + rng.random(axes)
        cells = np.clip(spot / (2 * SPREAD + 1) * (1 << BITS), 0, (1 << BITS) - 1)
        raw[:, t, :2] = direction_cells(short, coarse, seed, t, 0).astype(">u2").view(np.uint8).reshape(-1, 2)
        raw[:, t, 2] = direction_cells(short, fine, seed, t, 1)
        raw[:, t, LEAD:] = hilbert_bytes(cells.astype(np.int64), BITS).view(np.uint8).reshape(-1, width)
    return raw.view(f"S{LEAD + width}").reshape(len(unit), curves)


def _full(keys: np.ndarray) -> list[bytes]:
    """Byte strings with the zeros at their ends."""
    width, raw = keys.dtype.itemsize, np.ascontiguousarray(keys).tobytes()
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def _pack(matrix: np.ndarray) -> list[bytes]:
    """Bytes of each row: four a number where that loses nothing, else eight."""
    short = matrix.astype(np.float32)
    if (short == matrix).all():
        return [r.tobytes() for r in short]
    return [s.tobytes() if (s == r).all() else r.tobytes() for s, r in zip(short, matrix)]


def _unit(blobs: pd.Series, dim: int) -> np.ndarray:
    raw = np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64) for b in blobs]).astype(np.float64)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, keep: int) -> pd.DataFrame:
    """The best `keep` of each q by (s descending, c)."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (c[1:] != c[:-1])
    q, c, s = q[fresh], c[fresh], s[fresh]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    top = rank < keep
    return pd.DataFrame({"q": q[top], "c": c[top], "s": s[top]})


class _Found:
    """Candidates (q, c, s) of a range; all but the best `keep` of each q are dropped from time to time."""

    def __init__(self, keep: int):
        self.keep, self.parts, self.rows = keep, [], 0

    def add(self, q: np.ndarray, c: np.ndarray, s: np.ndarray) -> None:
        self.parts.append((q, c, s))
        self.rows += len(q)
        if self.rows > 2_000_000:
            b = self.best()
            self.parts, self.rows = [tuple(b[x].to_numpy() for x in "qcs")], 0

    def best(self) -> pd.DataFrame:
        return _best(*map(np.concatenate, zip(*self.parts)), self.keep)


def _slide(found: _Found, ids: np.ndarray, unit: np.ndarray, first: int, floor: float, window: int, block: int = 256) -> None:
    """Each row from the `first` on against the `window` rows before it. Single precision tells what is looked at, double what counts."""
    short = unit.astype(np.float32)
    for lo in range(first, len(ids), block):
        hi, left = min(lo + block, len(ids)), max(0, lo - window)
        i, j = np.nonzero(short[lo:hi] @ short[left:hi].T >= np.float32(floor - 1e-5))
        i, j = i + lo, j + left
        near = (j < i) & (i - j <= window) & (ids[i] != ids[j])
        i, j = i[near], j[near]
        if len(i) > 16 * block:
            s = np.round(unit[lo:hi] @ unit[left:hi].T, 6)[i - lo, j - left]
        else:
            s = np.round(np.einsum("ij,ij->i", unit[i], unit[j]), 6)
        far = s >= floor
        if far.any():
            i, j, s = ids[i[far]], ids[j[far]], s[far]
            found.add(np.r_[i, j], np.r_[j, i], np.r_[s, s])


def _windows(frames: Iterator[pd.DataFrame], dim: int, floor: float, keep: int, window: int, stride: int, again: int, most: int) -> Iterator[pd.DataFrame]:
    """Slide over rows ordered by (slot, key): each row against the `window` rows before it in its slot, and the heads of its cell; then `again` times in other orders."""
    slot, ids, unit = None, np.zeros(0, np.int64), np.zeros((0, dim))
    cell, head_ids, head_unit = None, ids, unit
    found, held, rows = _Found(keep), [], 0

    def ended() -> Iterator[pd.DataFrame]:
        if rows > window:
            all_ids, all_unit = (np.concatenate(x) for x in zip(*held))
            short = all_unit.astype(np.float32)
            for k in range(again):
                order = np.argsort(direction_cells(short, min(rows / window, 2 * dim), slot, k, 2), kind="stable")
                _slide(found, all_ids[order], all_unit[order], 0, floor, window)
        if found.parts:
            yield found.best()

    for frame in frames:
        for at in range(0, len(frame), 4096):
            chunk = frame.iloc[at : at + 4096]
            for own, part in chunk.groupby("slot", sort=True):
                if own != slot or rows > most:
                    yield from ended()
                    found, held, rows = _Found(keep), [], 0
                if own != slot:
                    slot, ids, unit = own, ids[:0], unit[:0]
                    cell, head_ids, head_unit = None, head_ids[:0], head_unit[:0]
                part_ids, part_unit, heads = part["gid"].to_numpy(), _unit(part["blob"], dim), part["head"].to_numpy()
                if cell is not None or heads.any():
                    width = LEAD + CELL_BYTES[own // stride % len(CELL_BYTES)]
                    cells = [k[:width] for k in part["key"]]
                    starts = [i for i in range(len(cells)) if not i or cells[i] != cells[i - 1]]
                    for lo, hi in zip(starts, [*starts[1:], len(cells)]):
                        if cells[lo] != cell:
                            cell, head_ids, head_unit = None, head_ids[:0], head_unit[:0]
                        first = lo + int(heads[lo:hi].sum())
                        if first > lo:
                            cell = cells[lo]
                            head_ids = np.concatenate([head_ids, part_ids[lo:first]])
                            head_unit = np.concatenate([head_unit, part_unit[lo:first]])
                        if cell is None or first == hi:
                            continue
                        sims = np.round(part_unit[first:hi] @ head_unit.T, 6)
                        i, j = np.nonzero((sims >= floor) & (part_ids[first:hi, None] != head_ids))
                        b = _best(part_ids[first:hi][i], head_ids[j], sims[i, j], keep)
                        found.add(*(b[x].to_numpy() for x in "qcs"))
                if again:
                    held.append((part_ids[~heads], part_unit[~heads]))
                    rows += len(held[-1][0])
                before = len(ids)
                ids = np.concatenate([ids, part_ids[~heads]])
                unit = np.concatenate([unit, part_unit[~heads]])
                _slide(found, ids, unit, before, floor, window)
                ids, unit = ids[-window:], unit[-window:]
    yield from ended()


def clean_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v): one row per id; null, short, long, non-finite and zero vectors are left out.

    Of several vectors of one id the least by array order is taken.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    usable = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)) & F.exists(v, lambda x: F.abs(x) > 1e-150)
    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(usable).groupBy("id").agg(F.min("v").alias("v"))


def nearest_pairs(
    vectors: DataFrame,
    k: int = 5,
    floor: float = 0.8,
    dim: int = 96,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    curves: int = CURVES,
    window: int = WINDOW,
    seed: int = 7,
) -> DataFrame:
    """Pairs (a < b) with cosine, rounded to six decimals, of at least `floor`, one being among the `k` nearest of the other.

    Nearest: by rounded cosine descending, then id. Approximate: a neighbour is missed if no curve brings the
    two within `window` places; see the README for the recall measured. Every usable vector is a query.
    Nulls, wrong lengths and zero vectors take no part; an id counts once; other columns are ignored; an
    empty table gives an empty result.
    """
    spark, keep = vectors.sparkSession, k + 1

    def directed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A direction, to nine decimals, is known by a hash of 128 bits."""
        for f in frames:
            raw = np.stack(f["v"].to_numpy())
            way = np.floor(raw / np.linalg.norm(raw, axis=1, keepdims=True) * 1e9 + 0.5).astype(np.int64)
            yield pd.DataFrame({"id": f["id"], "h": [xxhash.xxh3_128_digest(w.tobytes()) for w in way], "blob": _pack(raw)})

    rows = cut(clean_vectors(vectors, id_col, vector_col, dim).mapInPandas(directed, "id long, h binary, blob binary"))
    # Copies: each point keeps the k + 1 least ids; the limit is applied in every task before the shuffle.
    group = W.partitionBy("h")
    firsts = cut(rows.select("id", "h").withColumn("rn", F.row_number().over(group.orderBy("id"))).where(F.col("rn") <= keep).withColumn("gid", F.min("id").over(group)))

    n = firsts.where("rn = 1").count()
    ranges, most = max(1, -(-n // RANGE_ROWS)), 4 * RANGE_ROWS
    coarse = min(n / RANGE_ROWS, 40_000)
    fine = min(n / max(coarse, 1) / window, 2 * dim, 250)

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"gid": f["gid"], "blob": f["blob"], "keys": [_full(ks) for ks in curve_keys(_unit(f["blob"], dim), curves, seed, coarse, fine)]})

    points = rows.join(firsts.where("rn = 1").select("id"), "id", "left_semi").select(F.col("id").alias("gid"), "blob")
    points = cut(points.mapInPandas(keyed, "gid long, blob binary, keys array<binary>"))
    size = LEAD - (-BITS * min(AXES, dim) // 8)
    edges = [np.zeros(0, f"S{size}")] * curves
    if ranges > 1:
        # As many keys as there are ranges, not rows.
        some = points.where(F.pmod(F.xxhash64("gid", F.lit(seed)), F.lit(max(1, n // max(10_000, 64 * ranges)))) == 0)

        def bounds(f: pd.DataFrame) -> pd.DataFrame:
            """Where ranges begin, and where the halos that they give to those before end."""
            keys = np.sort(f["key"].to_numpy().astype(f"S{size}"))
            begins = np.unique(keys.astype("S2"), return_index=True)[1].tolist()
            out, full, most = [], 0.0, len(keys) / ranges
            for lo, hi in zip(begins, [*begins[1:], len(keys)]):
                parts = max(1, int(-(-(hi - lo) // (2 * most))))
                if full and full + (hi - lo) / parts > 1.5 * most:
                    out += [keys[lo][:2]] * 2
                    full = 0.0
                for i in range(1, parts):
                    out += [keys[lo + int((hi - lo) * x / parts)] for x in (i, i + HALO)]
                full = (hi - lo) / parts + (full if parts == 1 else 0.0)
            return pd.DataFrame({"t": f["t"].iloc[0], "i": range(len(out)), "key": [bytes(x).ljust(size, b"\0") for x in out]}).astype({"t": "int32", "i": "int32"})

        found = some.select(F.posexplode("keys").alias("t", "key")).groupBy("t").applyInPandas(bounds, "t int, i int, key binary").collect()
        edges = [np.array([bytes(r.key) for r in sorted(found, key=lambda r: r.i) if r.t == t], f"S{size}") for t in range(curves)]
    stride = 1 + max((len(e) for e in edges), default=0) // 2

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys = np.array(f["keys"].tolist(), f"S{size}").reshape(len(f), curves)
            for t in range(curves):
                place = np.searchsorted(edges[t], keys[:, t], side="right")  # even: own range only, odd: halo of the range before
                slot = t * stride + (place + 1) // 2
                out = pd.DataFrame({"slot": slot, "key": _full(keys[:, t]), "gid": f["gid"].to_numpy(), "blob": f["blob"].to_numpy(), "head": False})
                halo = out[place % 2 == 1]
                yield pd.concat([out, halo.assign(slot=halo["slot"] - 1)]) if len(halo) else out

    def lead(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Heads to all ranges that hold a part of their cell."""
        for f in frames:
            slots = []
            for t, cell in zip(f["t"], f["cell"]):
                low, high = np.searchsorted(edges[t], np.array([cell, cell.ljust(size, b"\xff")], f"S{size}"), side="right")
                slots.append([t * stride + i for i in range(low // 2, (high + 1) // 2 + 1)])
            yield f.assign(slot=slots, head=True).explode("slot").astype({"slot": "int64"}).rename(columns={"cell": "key"})[["slot", "key", "gid", "blob", "head"]]

    shape = "slot long, key binary, gid long, blob binary, head boolean"
    width = F.element_at(F.array(*[F.lit(LEAD + b) for b in CELL_BYTES]), F.col("t") % len(CELL_BYTES) + 1)
    cells = points.select("gid", F.posexplode("keys").alias("t", "key")).select("gid", "t", F.substring("key", F.lit(1), width).alias("cell"))
    large = cells.groupBy("t", "cell").count().where(F.col("count") > window).drop("count")
    first = W.partitionBy("t", "cell").orderBy("gid")
    heads = cells.join(large, ["t", "cell"]).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= window).join(points.select("gid", "blob"), "gid")
    placed = points.mapInPandas(spread, shape).unionByName(heads.select("t", "cell", "gid", "blob").mapInPandas(lead, shape))
    tasks = min(curves * stride, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")) + curves * stride // 8)
    again = min(AGAIN, ranges // 4)
    near = (
        placed.repartition(tasks, "slot")
        .sortWithinPartitions("slot", "key", F.col("head").desc(), "gid")
        .mapInPandas(lambda frames: _windows(frames, dim, floor, keep, window, stride, again, most), "q long, c long, s double")
    )
    # At most curves * windows a task * keep candidates a point, and as many by heads.
    ranked = near.groupBy("q").agg(F.slice(F.sort_array(F.collect_set(F.struct((-F.col("s")).alias("s"), "c"))), 1, keep).alias("best"))
    ids = firsts.groupBy("gid").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    others = ranked.select("q", F.explode("best").alias("b")).select("q", F.col("b.c").alias("gid"), F.col("b.s").alias("s"))
    own = firsts.where("rn = 1").select(F.col("gid").alias("q"), "gid", F.lit(-1.0).alias("s"))
    listed = (
        others.unionByName(own)
        .join(ids, "gid")
        .groupBy("q")
        .agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("s"), i.alias("id"))))).alias("all"))
        .select(F.col("q").alias("gid"), F.slice(F.sort_array("all"), 1, keep).alias("all"))
    )
    members = rows.select("id", "h").join(firsts.where("rn = 1").select("h", "gid"), "h").select("id", "gid")
    pairs = members.join(listed, "gid").select("id", F.explode(F.slice(F.filter("all", lambda x: x.id != F.col("id")), 1, k)).alias("b"))
    return pairs.select(F.least("id", "b.id").alias("vec_id_a"), F.greatest("id", "b.id").alias("vec_id_b")).distinct()
