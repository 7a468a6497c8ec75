"""Numbers of rows in an order over the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kolonnade.session import cut


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """`rows` with their number from 1 as `name`, by ascending `order`, which must be unique.

    Ranges of the order are numbered side by side: the place in a range and the sizes of the ranges before it,
    which are as many as there are partitions. No row gathers in one task.
    """
    placed = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part, place = F.shiftright("__place", 33), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in sorted(sizes):
        before += [F.lit(p), F.lit(total)]
        total += sizes[p]
    start = F.element_at(F.create_map(*before), part) if before else F.lit(0)
    return placed.withColumn(name, (start + place + 1).cast("long")).drop("__place")
