"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import join_counted, materialize


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """Component of every vertex that ``edges`` (u, v) mentions: columns ``node`` and ``root``.

    ``root`` is the smallest vertex of the component. Self loops are ignored
    and an empty edge table gives an empty result. The rounds are logarithmic
    in the longest path; each ends in a written table, and only two numbers a
    round reach the driver.
    """
    star = materialize(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges"
    )
    seen = _mark(star)
    while seen[0]:
        # large star: every greater neighbour of u moves to the least of u's neighbourhood
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both, materialize(least, "least"), ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its lesser neighbours move to the least of them; after the large star no u has many
        lesser = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lesser, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = materialize(moved.unionByName(lesser.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = _mark(star)
        if now == seen:
            break
        seen = now
    # at the fixed point every edge joins a vertex to its component's least
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
