"""Mixing sources to target token weights by entropy balancing."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._shared import HOT_KEYS, materialize, row_key, running_sum

#: Documents of one size that are ranked in one task.
_BUCKET = 1024


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and the controls 9 to 13 (null: 0)."""
    pieces = F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+")
    return (F.size(pieces) - (F.element_at(pieces, 1) == "").cast("int") - ((F.size(pieces) > 1) & (F.element_at(pieces, -1) == "")).cast("int")).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, cap: float) -> dict[str | None, float]:
    """Targets by source: ``share`` of all sizes by repeating weights, none above ``cap`` times its size.

    Sources take their weights by code point, null last. What a stopped
    source leaves is shared again among the others by weight, until none is
    above its stop (or all are at theirs).
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    rest = share * sum(sizes.values())
    open_ = list(order)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > cap * sizes[s]]
        if not over:
            out |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            out[s] = cap * sizes[s]
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _solve(cells: DataFrame, totals: dict, goal: dict, cap: float, tolerance: float = 1e-9, rounds: int = 120) -> dict:
    """Multipliers of the convex dual, one a source, by safeguarded Newton steps over the size histogram.

    A document of n words has the rate min(cap, exp(lambda * n / scale)), with
    its source's mean size as the scale. Each step is one aggregation; two
    sums a source come back.
    """
    spark = cells.sparkSession
    live = [s for s in totals if totals[s]["size"] > 0]
    scale = {s: totals[s]["size"] / totals[s]["n"] for s in live}
    # every size is at least 1, so these enclose the root
    high = {s: math.log(cap) * scale[s] for s in live}
    low = {s: min(0.0, math.log(goal[s] / totals[s]["size"]) * scale[s]) if goal[s] > 0 else -math.inf for s in live}
    now = {s: high[s] if goal[s] >= cap * totals[s]["size"] * (1 - 1e-12) else min(high[s], max(low[s], 0.0)) for s in live}
    going = {s for s in live if goal[s] < cap * totals[s]["size"] * (1 - 1e-12) and goal[s] > 0}
    for turn in range(rounds):
        if not going:
            break
        state = spark.createDataFrame([(s, now[s], scale[s]) for s in sorted(going, key=lambda s: (s is None, s or ""))], "s string, lam double, scale double")
        joined = cells.join(F.broadcast(state), F.col("source").eqNullSafe(F.col("s")))
        tilt = F.exp(F.least(F.col("lam") * F.col("size") / F.col("scale"), F.lit(math.log(cap) + 1)))
        free = tilt < cap
        words = F.col("n") * F.col("size")
        sums = joined.groupBy("s").agg(
            F.sum(words * F.least(tilt, F.lit(cap))).alias("f"), F.sum(F.when(free, words * tilt * F.col("size") / F.col("scale")).otherwise(0.0)).alias("d")
        )
        for row in sums.collect():
            s, f, d = row["s"], row["f"], row["d"]
            if abs(f - goal[s]) <= tolerance * goal[s] or high[s] - low[s] < 1e-13 * max(1.0, abs(high[s])):
                going.discard(s)
                continue
            if f < goal[s]:
                low[s] = now[s]
            else:
                high[s] = now[s]
            step = now[s] - (f - goal[s]) / d if d > 0 else math.nan
            # now and then a step halves the bracket, so a bad curve costs rounds and not the result
            now[s] = step if low[s] < step < high[s] and turn % 16 < 12 else (low[s] + high[s]) / 2
    if going:
        raise RuntimeError(f"no multiplier found in {rounds} rounds for the sources {sorted(map(repr, going))}")
    return {s: (now[s] / scale[s] if goal[s] > 0 else -math.inf) for s in live}


def _round_cells(cap: int):
    """Whole copies for each size of one source, largest first; what a size gains or loses passes to the next.

    Distinct sizes add up to the source's words at most, so w words have
    fewer than sqrt(2 * w) of them: 5.5 million for 100 TB in one source.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("size", "descending")])
        size, n, rate = (table.column(c).to_pylist() for c in ("size", "n", "rate"))
        copies, carry = [], 0.0
        for words, count, each in zip(size, n, rate, strict=True):
            if words:
                want = count * each * words + carry
                copies.append(min(cap * count, max(0, round(want / words))))
                carry = want - copies[-1] * words
            else:
                copies.append(count)
        return table.select(["source", "size", "n"]).append_column("copies", pa.array(copies, pa.int64()))

    return run


_KEY = ["_k1", "_k2"]


def _numbered(rows: DataFrame, keys: DataFrame, name: str) -> DataFrame:
    """Those of the rows whose key is among the few ``keys``, with the number of rows of the key before each one in ``_row``."""
    mine = materialize(rows.join(F.broadcast(keys.select(*_KEY)), _KEY, "left_semi"), name)
    return running_sum(mine, F.concat_ws(":", *[F.col(k).cast("string") for k in _KEY]), [], F.lit(1).cast("long"), "_row")


def _most_often(counted: DataFrame, count: str) -> DataFrame | None:
    """Rows of the written ``counted`` whose ``count`` is too much for one task, fewer than HOT_KEYS of them; None if there are none."""
    seen = counted.agg(F.sum(count).alias("total"), F.max(count).alias("most")).first()
    limit = max(_BUCKET, (seen["total"] or 0) // HOT_KEYS)
    return counted.where(F.col(count) > limit) if (seen["most"] or 0) > limit else None


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2, with_keys: bool = False) -> DataFrame:
    """Give every document a number of copies so that its source's words come near its target.

    Entropy balancing: among all rates from 0 to ``cap`` that meet each
    source's word target, those nearest to one copy each (in relative
    entropy) are exponential tilts of the document sizes. The one multiplier
    a source is found on the histogram of sizes, where documents of one size
    are one row, by Newton steps on the convex dual.

    Rates become copies in two exact steps. Largest size first, each size of
    a source gets a whole number of copies, and what rounding adds or takes
    passes on to the next size; so a source ends within about its smallest
    document of its target, or within half of a larger one if the documents
    below that are too few to make it up. Within a size, copies go to the
    documents of least hash; large groups are cut into buckets by another hash, each with
    its even share, so no task ranks more than a bucket.

    Sizes are counts of words; a null text has none. A null source is a
    source of its own, last in order. Documents without words are taken once
    and add nothing. Ties and repeated rows are ranked one by one; the
    choice depends on the rows alone, not on their partitions. Null ids
    take part. The driver holds one number set a source, as any list of
    weights does. An empty table gives an empty result.

    Returns doc_id, source, size, source_size, target, rate, copies and taken.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *row_key("doc_id", "text")), "sizes")
    repeats = _most_often(materialize(sized.groupBy(*_KEY).agg(F.count("*").alias("n")).where(F.col("n") > _BUCKET), "repeats"), "n")
    if repeats is None:
        sized = sized.withColumn("_row", F.lit(0).cast("long"))
    else:
        others = sized.join(F.broadcast(repeats.select(*_KEY)), _KEY, "left_anti").withColumn("_row", F.lit(0).cast("long"))
        sized = materialize(others.unionByName(_numbered(sized, repeats, "repeated")), "numbered")
    cells = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "cells")
    totals = {r["source"]: r for r in cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("size"), F.sum("n").alias("n")).collect()}
    sizes = {s: r["size"] for s, r in totals.items()}
    spark, schema = docs.sparkSession, "s string, source_size long, target double, lam double"
    goal = targets(sizes, weights, share, float(cap)) if totals else {}
    lam = _solve(cells, totals, goal, float(cap))
    plan = F.broadcast(spark.createDataFrame([(s, sizes[s], float(goal[s]), lam.get(s, 0.0)) for s in totals], schema))
    exponent = F.col("lam") * F.col("size")
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(exponent >= math.log(cap), F.lit(float(cap))).otherwise(F.exp(exponent))
    rated = cells.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate)
    whole = rated.select("source", "size", "n", "rate").groupBy("source").applyInArrow(_round_cells(cap), "source string, size long, n long, copies long")
    # documents of one size in buckets of about _BUCKET, each with its even share of the copies
    shares = materialize(whole.withColumn("buckets", F.ceil(F.col("n") / _BUCKET)), "shares")
    mine = shares.select(F.col("source").alias("s2"), F.col("size").alias("size2"), F.col("n").alias("cell_n"), F.col("copies").alias("cell_copies"), "buckets")
    same = F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("size2"))
    # a size with more than 1 / HOT_KEYS of the documents would be one task: there are fewer than HOT_KEYS, and they are broadcast
    often = F.col("cell_n") > sum(t["n"] for t in totals.values()) // HOT_KEYS
    hot = F.broadcast(mine.where(often))
    placed = sized.join(hot, same).unionByName(sized.join(F.broadcast(mine.where(often).select("s2", "size2")), same, "left_anti").join(mine.where(~often), same))
    # equal rows have one hash; if there are very many, their numbers deal them over the buckets
    hashed = F.when(F.col("_row") == 0, F.xxhash64("_k1", F.lit("bucket"))).otherwise(F.xxhash64("_k1", F.lit("bucket"), "_row"))
    placed = placed.withColumn("bucket", F.pmod(hashed, F.col("buckets")))
    by_size = ["source", "size"]
    per = placed.groupBy(*by_size, "bucket").agg(F.count("*").alias("m"), F.any_value("cell_n").alias("cell_n"), F.any_value("cell_copies").alias("cell_copies"))
    upto = F.sum("m").over(Window.partitionBy(*by_size).orderBy("bucket"))
    # exact integer prefix shares: the buckets' copies add up to the size's
    even = lambda c: F.floor(c.cast("decimal(20,0)") * F.col("cell_copies").cast("decimal(18,0)") / F.col("cell_n")).cast("long")
    dealt = per.withColumn("upto", upto).select(
        F.col("source").alias("s2"), F.col("size").alias("size2"), F.col("bucket").alias("b2"), "m", (even(F.col("upto")) - even(F.col("upto") - F.col("m"))).alias("bucket_copies")
    )
    joined = placed.select("doc_id", "source", "size", "_k1", "_k2", "bucket").join(
        dealt, F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("size2")) & (F.col("bucket") == F.col("b2"))
    )
    place = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("_k1", "_k2"))
    base = F.floor(F.col("bucket_copies") / F.col("m"))
    copies = (base + (F.col("place") <= F.col("bucket_copies") - base * F.col("m")).cast("long")).cast("long")
    final = joined.withColumn("place", place).withColumn("copies", copies).join(plan, F.col("source").eqNullSafe(F.col("s")))
    names = ["doc_id", "source", "size", "source_size", "target", rate.alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken")]
    return final.select(*names, *(["_k1", "_k2"] if with_keys else []))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as many times as ``mix`` gives it.

    Rows with the same id and text share their copies evenly. Null texts and
    sources are as in ``mix``. All columns are kept, but those named _k1, _k2,
    _copies, _rows, _row or _copy are dropped. An empty table stays empty.
    """
    docs = docs.drop("_k1", "_k2", "_copies", "_rows", "_row", "_copy")
    dealt = materialize(mix(docs, weights, share, cap, with_keys=True).groupBy(*_KEY).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")), "dealt")
    keyed = docs.select("*", *row_key("doc_id", "text"))
    hot = _most_often(dealt, "_rows")
    few = keyed if hot is None else keyed.join(F.broadcast(hot.select(*_KEY)), _KEY, "left_anti")
    # equal rows share their copies evenly
    each = few.withColumn("_row", F.row_number().over(Window.partitionBy(*_KEY).orderBy("_k1"))).join(dealt, _KEY)
    if hot is not None:
        many = _numbered(keyed, hot, "repeated-rows").withColumn("_row", F.col("_row") + 1)
        each = each.unionByName(many.join(F.broadcast(hot), _KEY))
    base = F.floor(F.col("_copies") / F.col("_rows"))
    copies = (base + (F.col("_row") <= F.col("_copies") - base * F.col("_rows")).cast("long")).cast("int")
    return each.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)
