"""Exact nearest neighbours and the two hybrid rerankers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import contains_ascii
from lodestone.functions.vectors import distance_to_score, hybrid_score, l2_distance, literal_vector, require_distance
from lodestone.operators.fts import fts_topk, like_topk, scored, tree_of, uses_fallback


def knn_topk(vectors: DataFrame, query: list[float], k: int, id_column: str = "chunk_id") -> DataFrame:
    """The ``k`` nearest rows by Euclidean distance over a full scan, ties to the smaller id."""
    near = vectors.withColumn("vec_distance", l2_distance(F.col("embedding"), literal_vector(query)))
    return near.orderBy("vec_distance", id_column).limit(k).withColumn("score", distance_to_score(F.col("vec_distance")))


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    return found.withColumn("score", hybrid_score(F.col("fts_rank"), F.col("vec_distance"))).orderBy(F.desc("score"), "prior").limit(limit)


def rerank_by_vector(top: DataFrame, order: list, vectors: DataFrame, vector: list[float], limit: int) -> DataFrame:
    """Lexical candidates, a few rows with fts_rank, by the hybrid score; ties keep their ``order``, and one without a vector its text part."""
    placed = _numbered(top, order)
    # the candidates are broadcast, as their number is a parameter
    near = vectors.join(F.broadcast(placed.select("chunk_id")), "chunk_id", "left_semi")
    near = near.select("chunk_id", l2_distance(F.col("embedding"), literal_vector(vector)).alias("vec_distance"))
    return _ranked(placed.join(near, "chunk_id", "left"), limit)


def lexical_order(query: str, is_pattern: bool) -> list:
    return [F.length("text"), F.col("chunk_id")] if uses_fallback(query, is_pattern) else [F.col("fts_rank"), F.col("chunk_id")]


def fts_then_vector(
    chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int, candidates: int, is_pattern: bool = False
) -> DataFrame:
    """Lexical candidates reranked by the hybrid score; ties keep the lexical order.

    A candidate without a vector keeps its text part. Short literals have no
    lexical rank, so only their vector part counts.
    """
    top = like_topk(chunks, query, candidates) if uses_fallback(query, is_pattern) else fts_topk(chunks, query, candidates, is_pattern)
    return rerank_by_vector(top, lexical_order(query, is_pattern), vectors, vector, limit)


def nearest_numbered(vectors: DataFrame, vector: list[float], candidates: int) -> DataFrame:
    return _numbered(knn_topk(vectors, vector, candidates).select("chunk_id", "vec_distance"), [F.col("vec_distance"), F.col("chunk_id")])


def rerank_by_text(mine: DataFrame, limit: int) -> DataFrame:
    """Vector candidates with fts_rank (null where the text does not match) by the hybrid score; a candidate must have its distance."""
    return _ranked(mine.withColumn("vec_distance", require_distance(F.col("vec_distance"))), limit)


def vector_then_fts(
    chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], limit: int, candidates: int, is_pattern: bool = False
) -> DataFrame:
    """Vector candidates reranked by the hybrid score; those that do not match the text stay, without a text part.

    Lexical statistics are those of all chunks. A short literal ranks -1 where it occurs.
    """
    top = nearest_numbered(vectors, vector, candidates)
    if uses_fallback(query, is_pattern):
        found = chunks.withColumns({"_hit": contains_ascii(F.col("text"), query), "fts_rank": F.lit(-1.0)})
    else:
        found = scored(chunks, tree_of(query, is_pattern))
    mine = found.withColumn("fts_rank", F.when(F.col("_hit"), F.col("fts_rank"))).drop("_hit").join(F.broadcast(top), "chunk_id")
    return rerank_by_text(mine, limit)


def _numbered(top: DataFrame, order: list) -> DataFrame:
    """``top``, a few rows, with their place as ``prior``."""
    from pyspark.sql import Window

    return top.withColumn("prior", F.row_number().over(Window.orderBy(*order)))
