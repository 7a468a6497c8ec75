"""Pairwise links to groups: contraction of the link graph.

Each round removes an independent set of vertices with one or two neighbours and remembers for each a
neighbour that stays: vertices of degree one fall off, chains of degree two shorten as in list ranking by
independent sets (a removed chain vertex leaves an edge between its two neighbours). Where few such vertices
are left, the rest is the reduced core; it is solved by contracting random mates (a vertex with coin 0 joins
a neighbour with coin 1). Labels are then restored along the remembered neighbours by pointer doubling.

Hubs never become a key that gathers their neighbours: degrees are partial aggregates, the test for low
neighbours and the removal of edges are keyed by edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kolonnade.functions.keys import ident
from kolonnade.session import cut

#: Share of the vertices of a round that must be removable for another round of stripping.
LEAST_SHARE = 0.1


def _coin(v: Column | str, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), v)


def connected(edges: DataFrame) -> DataFrame:
    """`edges` (u long, v long) to (id, root): every vertex with one representative of its component.

    Self-links, repeated links and links in either direction are allowed; rows with a null end are left out.
    Vertices that occur in self-links only are not returned. The root is some vertex of the component.
    """
    spark = edges.sparkSession
    edges = cut(
        edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    )
    removed: DataFrame | None = None
    turn = 0
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = F.count("*") <= 2
        vertices = cut(both.groupBy("u").agg(low.alias("low"), F.min("v").alias("a"), F.max("v").alias("b"), F.min(F.struct(F.pmod(_coin("v", turn), F.lit(2)).alias("c"), "v")).alias("mate0"), F.max(F.struct(F.pmod(_coin("v", turn), F.lit(2)).alias("c"), "v")).alias("mate1")))
        n, n_low = vertices.agg(F.count("*"), F.count_if("low")).first()
        if n == 0:
            break
        if n_low >= LEAST_SHARE * n:
            lows = vertices.where("low").select(F.col("u").alias("x"), "a", "b")
            ends = lows.select("x", F.explode(F.array_distinct(F.array("a", "b"))).alias("y"))
            # An edge that comes twice has two low ends; the one with the larger coin waits for a later round.
            waiting = (
                ends.groupBy(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"))
                .count()
                .where("count = 2")
                .select(F.when(F.struct(_coin("p", turn), "p") > F.struct(_coin("q", turn), "q"), F.col("p")).otherwise(F.col("q")).alias("x"))
                .distinct()
            )
            gone = cut(lows.join(waiting, "x", "left_anti"))
            dead = gone.select(F.explode(F.array_distinct(F.array(F.struct(F.least("x", "a").alias("u"), F.greatest("x", "a").alias("v")), F.struct(F.least("x", "b").alias("u"), F.greatest("x", "b").alias("v"))))).alias("e")).select("e.*")
            bridges = gone.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
            rest = edges.join(dead, ["u", "v"], "left_anti").unionByName(bridges).distinct()
        else:
            mine = F.pmod(_coin("u", turn), F.lit(2))
            gone = cut(vertices.where((mine == 0) & (F.col("mate1.c") == 1)).select(F.col("u").alias("x"), F.col("mate1.v").alias("a")))
            moved = edges
            for end in ("u", "v"):
                moved = moved.join(gone.select(F.col("x").alias(end), F.col("a").alias("to")), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
            rest = moved.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        step = gone.select(F.col("x").alias("id"), F.col("a").alias("up"))
        removed = step if removed is None else removed.unionByName(step)
        edges = cut(rest)
        turn += 1
    if removed is None:
        return spark.createDataFrame([], "id long, root long")
    # Vertices point to vertices removed later; doubling reaches the root in log2(turns) joins.
    up = cut(removed)
    for _ in range(max(0, (turn - 1).bit_length())):
        far = up.select(F.col("id").alias("up"), F.col("up").alias("far"))
        up = cut(up.join(far, "up", "left").select("id", F.coalesce("far", "up").alias("up")))
    inner = up.select("id")
    roots = up.select(F.col("up").alias("id")).distinct().join(inner, "id", "left_anti")
    return up.select("id", F.col("up").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))


def column_ref(side: str) -> Column:
    """`tab.col` of one side of an edge, both in comparison form; null if one is missing."""
    tab, col = ident(F.col(f"{side}.tab")), ident(F.col(f"{side}.col"))
    return F.when(tab.isNotNull() & col.isNotNull(), F.concat(tab, F.lit("."), col))


def link_groups(edges: DataFrame) -> DataFrame:
    """Accepted edges to (db_id, column_ref, group_ref): the group is named by its smallest column.

    Only rows with a database and two complete sides count; a column linked to itself alone is its own
    group. Names compare stripped and in lower case, by code points. Repeated rows change nothing, further
    columns of the input are ignored, an empty input gives an empty result. `db_id` compares like a name.
    """
    pairs = edges.select(ident(F.col("db_id")).alias("db_id"), column_ref("col1").alias("l"), column_ref("col2").alias("r")).where("db_id is not null and l is not null and r is not null").distinct()
    # A string column orders by bytes of UTF-8, which is the order of code points.
    names = pairs.select("db_id", F.explode(F.array("l", "r")).alias("column_ref")).distinct()
    nodes = cut(names.withColumn("id", F.monotonically_increasing_id()))
    ids = pairs.where("l <> r")
    for side in ("l", "r"):
        ids = ids.join(nodes.select("db_id", F.col("column_ref").alias(side), F.col("id").alias(f"{side}_id")), ["db_id", side])
    found = connected(ids.select(F.col("l_id").alias("u"), F.col("r_id").alias("v")))
    grouped = cut(nodes.join(found, "id", "left").withColumn("root", F.coalesce("root", "id")))
    # The join back to one row per group carries a salt: a group may hold a third of all columns.
    salts = 16
    least = grouped.groupBy("root").agg(F.min("column_ref").alias("group_ref")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return grouped.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(least, ["root", "salt"]).select("db_id", "column_ref", "group_ref")
