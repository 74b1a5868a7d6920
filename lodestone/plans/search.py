"""Search over one or many indexes: what is asked, and the plan that answers it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.fts import fts_topk, like_topk, uses_fallback
from lodestone.operators.vector import knn_topk, lexical_order, nearest_numbered, rerank_by_text, rerank_by_vector, vector_then_fts
from lodestone.plans import lookup
from lodestone.plans.lookup import TextIndex

MODES = ("fts", "vec", "fts-vec", "vec-fts")
LIMIT, CANDIDATES = 10, 50


@dataclass(frozen=True)
class Resolved:
    """The logical plan of a search: a mode and what each side looks for."""

    mode: str
    vector_query: str | None
    fts_query: str | None
    is_pattern: bool


def resolve(query: str | None = None, pattern: str | None = None, mode: str | None = None) -> Resolved:
    """Trim and check the arguments. Without a mode, a query is for vectors, a pattern for text, both for both."""
    query, pattern = ((t or "").strip() or None for t in (query, pattern))
    if query is None and pattern is None:
        raise ValueError("a query or a pattern is needed")
    mode = mode or ("vec" if pattern is None else "fts" if query is None else "vec-fts")
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode != "fts" and query is None:
        raise ValueError(f"mode {mode} needs a query")
    return Resolved(mode, query if mode != "fts" else None, (pattern or query) if mode != "vec" else None, mode != "vec" and pattern is not None)


def _lexical(chunks: DataFrame, text: TextIndex | None, asked: Resolved, k: int) -> DataFrame:
    """The best ``k`` chunks by text, through the posting table if there is one."""
    if uses_fallback(asked.fts_query, asked.is_pattern):
        return like_topk(chunks, asked.fts_query, k)
    return lookup.topk(text, asked.fts_query, k, asked.is_pattern) if text else fts_topk(chunks, asked.fts_query, k, asked.is_pattern)


def search(
    chunks: DataFrame,
    vectors: DataFrame | None,
    asked: Resolved,
    vector: list[float] | None = None,
    limit: int = LIMIT,
    candidates: int = CANDIDATES,
    text: TextIndex | None = None,
) -> DataFrame:
    """Top ``limit`` chunks of one index with score, fts_rank, vec_distance, source and place.

    With a ``text`` index, lexical parts are read from its postings; without,
    all chunks are scanned. Both give the same rows.
    """
    source, candidates = asked.mode, max(candidates, limit)
    if asked.mode == "fts":
        short = uses_fallback(asked.fts_query, asked.is_pattern)
        found = _lexical(chunks, text, asked, limit).withColumn("vec_distance", F.lit(None).cast("double"))
        source, order = ("like" if short else "fts"), ([F.length("text")] if short else [F.desc("score")])
    elif asked.mode == "vec":
        near = knn_topk(vectors, vector, limit).select("chunk_id", "vec_distance", "score")
        found = chunks.join(F.broadcast(near), "chunk_id").withColumn("fts_rank", F.lit(None).cast("double"))
        order = [F.desc("score")]
    else:
        if asked.mode == "fts-vec":
            found = rerank_by_vector(_lexical(chunks, text, asked, candidates), lexical_order(asked.fts_query, asked.is_pattern), vectors, vector, limit)
        elif text and not uses_fallback(asked.fts_query, asked.is_pattern):
            # ``candidates`` rows, a parameter, are broadcast
            top = F.broadcast(nearest_numbered(vectors, vector, candidates))
            ranks = lookup.ranked(text, asked.fts_query, asked.is_pattern).join(top.select("chunk_id"), "chunk_id", "left_semi")
            found = rerank_by_text(chunks.join(top, "chunk_id").join(ranks, "chunk_id", "left"), limit)
        else:
            found = vector_then_fts(chunks, vectors, asked.fts_query, vector, limit, candidates, asked.is_pattern)
        order = [F.desc("score"), F.col("prior")]
    # at most ``limit`` rows by now
    place = F.row_number().over(Window.orderBy(*order, "chunk_id"))
    return found.withColumn("source", F.lit(source)).withColumn("place", place).drop("prior")


def search_many(
    indexes: dict[str, tuple], asked: Resolved, vector: list[float] | None = None, limit: int = LIMIT, candidates: int = CANDIDATES
) -> DataFrame:
    """Top ``limit`` over all indexes by score, ties by index path and place there.

    An index is its chunks, its vectors or none, and its text index if it has
    one. Each answers by its own statistics, so lexical scores of different
    indexes are not on one scale. If all have postings, one aggregation
    counts and one scores for all of them.
    """
    each = max(candidates, limit)
    texts = {path: found[2] for path, found in indexes.items() if len(found) > 2 and found[2]}
    if asked.mode == "fts" and len(texts) == len(indexes) and not uses_fallback(asked.fts_query, asked.is_pattern):
        best = lookup.topk_each(texts, asked.fts_query, each, asked.is_pattern).orderBy(F.asc("fts_rank"), "name", "place").limit(limit)
        # ``limit`` rows, a parameter; texts are fetched for these alone
        kept = best.sparkSession.createDataFrame(best.collect(), best.schema)
        parts = [
            index.chunks.join(F.broadcast(kept.where(F.col("name") == path)), "chunk_id")
            .withColumns({"score": -F.col("fts_rank"), "vec_distance": F.lit(None).cast("double"), "source": F.lit("fts")})
            .withColumnRenamed("name", "db_path")
            for path, index in sorted(texts.items())
        ]
    else:
        parts = [search(*found[:2], asked, vector, each, each, *found[2:]).withColumn("db_path", F.lit(path)) for path, found in sorted(indexes.items())]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.orderBy(F.desc("score"), "db_path", "place").limit(limit)
