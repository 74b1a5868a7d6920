"""Approximate nearest neighbours by inner product: inverted file, product-quantised residuals, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._shared import materialize


def _nearest(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    """The centre at the least Euclidean distance of each row."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([(half - x[a : a + block] @ centres.T).argmin(axis=1) for a in range(0, len(x), block)] or [np.zeros(0, np.int64)])


def _lloyd(x: np.ndarray, k: int, rounds: int, random: np.random.Generator) -> np.ndarray:
    """k-means centres; an empty one moves to a random row."""
    centres = x[random.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = sums / np.maximum(counts, 1)[:, None]
        empty = np.flatnonzero(counts == 0)
        centres[empty] = x[random.integers(0, len(x), len(empty))]
    return centres


@dataclass
class Quantiser:
    """Coarse centres in the lifted space, and a codebook for each run of dimensions of the residual.

    A vector is lifted by one more coordinate that brings all to one length,
    so that the nearest by distance is the largest by inner product.
    """

    lift: float
    coarse: np.ndarray
    spans: list[tuple[int, int]]
    codebooks: list[np.ndarray]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, self.lift - (x * x).sum(axis=1)))
        return np.hstack([x, rest[:, None]])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells = _nearest(self.lifted(x), self.coarse)
        rest = x - self.coarse[cells, :-1]
        codes = [_nearest(rest[:, a:b], book) for (a, b), book in zip(self.spans, self.codebooks, strict=True)]
        return cells, np.stack(codes, axis=1).astype(np.uint8)

    def cell_order(self, q: np.ndarray) -> np.ndarray:
        """Cells of each query, nearest first."""
        half = (self.coarse * self.coarse).sum(axis=1) / 2
        return np.argsort(half - q @ self.coarse[:, :-1].T, axis=1, kind="stable")

    def probes(self, q: np.ndarray, least: int, counts: np.ndarray, wanted: int) -> list[np.ndarray]:
        """Cells for each query, nearest first: ``least`` of them, or more until they hold ``wanted`` vectors."""
        order = self.cell_order(q)
        filled = np.cumsum(counts[order], axis=1)
        need = np.maximum((filled < wanted).sum(axis=1) + 1, least)
        return [o[:n][counts[o[:n]] > 0] for o, n in zip(order, need, strict=True)]

    def needed_probes(self, sample: np.ndarray, k: int, recall: float, asked: int = 256) -> int:
        """Cells to probe so that the sample's own nearest rows are in them with the given share.

        The sample is thinner than the whole, so its neighbours lie farther
        away and the number errs on the large side.
        """
        cells = _nearest(self.lifted(sample), self.coarse)
        q = np.linspace(0, len(sample) - 1, min(asked, len(sample))).astype(int)
        near = sample[q] @ sample.T
        near[np.arange(len(q)), q] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return 1
        true = np.argpartition(-near, k - 1, axis=1)[:, :k]
        order = self.cell_order(sample[q])
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        ranks = np.sort(np.take_along_axis(place, cells[true], axis=1).ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))]) + 1


def bins_of(counts: np.ndarray, block: int) -> list[list[int]]:
    """Bins of each cell: small cells share bins of about ``block`` vectors, large ones are spread over several."""
    out, current, filled = [], 0, 0
    for count in counts.tolist():
        if count > block:
            pieces = -(-count // block)
            out.append(list(range(current + 1, current + 1 + pieces)))
            current, filled = current + 1 + pieces, 0
            continue
        if filled + count > block and filled:
            current, filled = current + 1, 0
        out.append([current])
        filled += count
    return out


def train(sample: np.ndarray, lift: float, cells: int, parts: int, seed: int = 9) -> Quantiser:
    random = np.random.default_rng(seed)
    made = Quantiser(lift, np.zeros((1, sample.shape[1] + 1)), [], [])
    made.coarse = _lloyd(made.lifted(sample), min(cells, len(sample)), 8, random)
    rest = sample - made.coarse[_nearest(made.lifted(sample), made.coarse), :-1]
    edges = np.linspace(0, sample.shape[1], min(parts, sample.shape[1]) + 1).astype(int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        made.spans.append((int(a), int(b)))
        made.codebooks.append(_lloyd(rest[:, a:b], min(256, len(rest)), 6, random))
    return made


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _indexer(model, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            cells, codes = model.value.encode(_matrix(batch.column("embedding"), dim))
            width = codes.shape[1]
            at = (np.arange(len(batch) + 1) * width).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(codes))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(cells.astype(np.int32)), batch.column("vec_id"), batch.column("times"), packed, batch.column("embedding")],
                ["cell", "vec_id", "times", "codes", "embedding"],
            )

    return run


def _prober(model, dim: int, least: int, counts: np.ndarray, wanted: int, bins: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 1024):
                part = batch.slice(begin, 1024)
                rows, places, cells = [], [], []
                for r, probed in enumerate(model.value.probes(_matrix(part.column("embedding"), dim), least, counts, wanted)):
                    by_bin: dict[int, list[int]] = {}
                    for cell in probed.tolist():
                        for place in bins[cell]:
                            by_bin.setdefault(place, []).append(cell)
                    rows += [r] * len(by_bin)
                    places += by_bin
                    cells += by_bin.values()
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(places, pa.int32()), part.column("query_id").take(taken), pa.array(cells, pa.list_(pa.int32())), part.column("embedding").take(taken)],
                    ["bin", "query_id", "cells", "embedding"],
                )

    return run


def _inner(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in one order for every row, so equal vectors score equally."""
    out = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        out += vectors[:, d] * query[d]
    return out


def _searcher(model, dim: int, keep: int, rerank: int):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list] = {"query_id": [], "vec_id": [], "times": [], "score": []}
        if vectors.num_rows and queries.num_rows:
            m = model.value
            ids, times = vectors.column("vec_id").to_numpy(), vectors.column("times").to_numpy()
            x = _matrix(vectors.column("embedding").combine_chunks(), dim)
            codes = np.frombuffer(b"".join(vectors.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
            q = _matrix(queries.column("embedding").combine_chunks(), dim)
            known, cell = np.unique(vectors.column("cell").to_numpy(), return_inverse=True)
            probed = np.zeros((len(q), len(known)), bool)
            for r, cells in enumerate(queries.column("cells").to_pylist()):
                probed[r, np.searchsorted(known, cells)[np.isin(cells, known)]] = True
            centres = m.coarse[known, :-1]
            for begin in range(0, len(q), 64):
                part = q[begin : begin + 64]
                near = (part @ centres.T).astype(np.float32)[:, cell]
                for j, ((a, b), book) in enumerate(zip(m.spans, m.codebooks, strict=True)):
                    near += (part[:, a:b] @ book.T).astype(np.float32)[:, codes[:, j]]
                near[~probed[begin : begin + 64][:, cell]] = -np.inf
                for r, row in enumerate(near):
                    least = np.partition(row, len(row) - rerank)[len(row) - rerank] if len(ids) > rerank else -np.inf
                    some = np.flatnonzero((row >= least) & (row > -np.inf))
                    scores = _inner(x[some], part[r])
                    best = np.lexsort((ids[some], -scores))[:keep]
                    found["query_id"].append(np.full(len(best), queries.column("query_id")[begin + r].as_py()))
                    found["vec_id"].append(ids[some[best]])
                    found["times"].append(times[some[best]])
                    found["score"].append(scores[best])
        kinds = {"query_id": np.int64, "vec_id": np.int64, "times": np.int64, "score": np.float64}
        return pa.table({k: np.concatenate([np.zeros(0, kinds[k]), *v]).astype(kinds[k]) for k, v in found.items()})

    return search


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    cell_size: int = 256,
    probe: int = 8,
    recall: float = 0.97,
    rerank: int = 768,
    parts: int = 16,
    max_sample: int = 32768,
    block: int = 8192,
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner product for each row of ``queries``, but itself.

    Both have vec_id and embedding; a query leaves out the vector of its own
    id. The quantiser is fitted on at most ``max_sample`` rows (least hash of
    vec_id); every row is indexed. There are n / ``cell_size`` cells, an
    eighth of the sample at most. A query reads ``probe`` cells, or as many
    as the sample's own neighbours need for the wanted ``recall``, and more
    until they hold enough rows. Cells are searched in bins of about
    ``block`` vectors: in a bin, asymmetric distance tables pick the
    ``rerank`` best codes of the query's cells and all that tie with the last
    of them; these are scored on the original vectors in double precision.

    Equal query vectors are searched once. A cell of more than ``block``
    vectors is spread over bins, and a bin's queries are split into blocks,
    so no task holds more, whatever the skew. To the driver come the sample
    and counts by cell and by bin.

    Vectors that are null, zero, of another length than most, or hold null
    or non-finite parts take no part, as rows or queries; nor do null ids.
    Ties go to the smaller vec_id. A repeated row is searched once and counts
    once for each time; those of the query's own id take no neighbour's place.
    Further columns are not read; empty tables give an empty result.

    Returns query_id, rank (from 1), vec_id and score, at most ``k`` rows a query.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    found = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if found is None or found["dim"] < 1:
        return spark.createDataFrame([], schema)
    dim = found["dim"]

    def valid(df: DataFrame) -> DataFrame:
        parts_ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
        some = F.exists("embedding", lambda v: v != 0)
        return df.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
            F.col("vec_id").isNotNull() & (F.size("embedding") == dim) & parts_ok & some
        )

    rows = valid(vectors)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    total = rows.agg(F.count("*").alias("n"), F.max(norm).alias("lift")).first()
    n = total["n"]
    if not n:
        return spark.createDataFrame([], schema)
    sample_rows = min(max_sample, max(1024, (128 << 20) // (8 * dim)))
    draw = F.pmod(F.xxhash64("vec_id", F.lit("draw")), F.lit(1 << 40))
    drawn = rows.where(draw < F.lit(int((1 << 40) * min(1.0, sample_rows / n)))).orderBy(draw, "vec_id").limit(sample_rows).select("embedding").toArrow()
    if not drawn.num_rows:
        drawn = rows.limit(1).select("embedding").toArrow()
    sample = _matrix(drawn.column(0).combine_chunks(), dim)
    made = train(sample, total["lift"], max(1, min(n // cell_size, len(sample) // 8)), parts)
    probe = max(probe, made.needed_probes(sample, k, recall))
    model = spark.sparkContext.broadcast(made)

    once = rows.groupBy("vec_id", "embedding").agg(F.count("*").alias("times")).select("vec_id", "times", "embedding")
    index = materialize(once.mapInArrow(_indexer(model, dim), "cell int, vec_id long, times long, codes binary, embedding array<double>"), "index")
    counts = np.zeros(len(made.coarse), np.int64)
    for row in index.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    bins = bins_of(counts, block)

    asked = materialize(valid(queries), "asked")
    # an id may stand on several vectors; a query leaves out all of its own
    own = index.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").groupBy("vec_id").count().agg(F.max("count").alias("most")).first()["most"]
    keep = k + (own or 0)
    distinct = asked.select("embedding").distinct().withColumn("query_id", F.xxhash64("embedding"))
    prober = _prober(model, dim, probe, counts, keep, bins)
    probes = materialize(distinct.select("query_id", "embedding").mapInArrow(prober, "bin int, query_id long, cells array<int>, embedding array<double>"), "probes")
    asks = {row["bin"]: -(-row["count"] // block) for row in probes.groupBy("bin").count().collect()}
    cells = spark.createDataFrame([(c, places) for c, places in enumerate(bins)], "cell int, bins array<int>")
    split = spark.createDataFrame([(b, asks.get(b, 0)) for b in sorted({x for places in bins for x in places})], "bin int, asks int").where("asks > 0")
    piece = F.pmod(F.xxhash64("vec_id"), F.size("bins")).cast("int")
    left = (
        index.join(F.broadcast(cells), "cell")
        .withColumn("bin", F.element_at("bins", piece + 1))
        .join(F.broadcast(split), "bin")
        .withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("asks") - 1)))
        .select("bin", "ask", "cell", "vec_id", "times", "codes", "embedding")
    )
    right = probes.join(F.broadcast(split), "bin").withColumn("ask", F.pmod(F.xxhash64("query_id"), F.col("asks")).cast("int")).select("bin", "ask", "query_id", "cells", "embedding")
    key = ["bin", "ask"]
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_searcher(model, dim, keep, max(rerank, keep)), "query_id long, vec_id long, times long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= keep)

    members = asked.join(distinct.withColumnRenamed("query_id", "group"), "embedding").select("group", F.col("vec_id").alias("query_id"))
    each = members.distinct().join(top.withColumnRenamed("query_id", "group"), "group").where("query_id != vec_id")
    rank = F.row_number().over(best)
    each = each.withColumn("time", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)).cast("int"))))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
