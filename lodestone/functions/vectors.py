"""Column functions over vectors and scores."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F

VECTOR_WEIGHT, TEXT_WEIGHT = 0.7, 0.3


def float32(vector: list[float]) -> list[float]:
    """The values as an index holds them."""
    return list(struct.unpack(f"<{len(vector)}f", struct.pack(f"<{len(vector)}f", *vector)))


def l2_distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))


def literal_vector(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in float32(vector)])


def is_finite(vector: Column) -> Column:
    return F.forall(vector, lambda v: ~F.isnan(v) & (F.abs(v) != float("inf")))


def require_finite(vector: Column) -> Column:
    """The vector, or an error that stops the query if a part of it is not finite."""
    return F.when(is_finite(vector), vector).otherwise(F.raise_error(F.lit("embedding contains non-finite values")).cast("array<float>"))


def normalize(vector: Column) -> Column:
    """Unit length in double precision; a zero vector stays as it is."""
    wide = F.transform(vector, lambda v: v.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(norm > 0, F.transform(wide, lambda v: v / norm)).otherwise(wide)


def distance_to_score(distance: Column) -> Column:
    """1 / (1 + distance); 0 for NaN, null for null (``greatest`` would pass over a null)."""
    return F.when(distance.isNull(), F.lit(None).cast("double")).when(F.isnan(distance), F.lit(0.0)).otherwise(1 / (1 + F.greatest(distance, F.lit(0.0))))


def require_distance(distance: Column) -> Column:
    """The distance, or an error that stops the query if it is null: the index lacks a vector and must be rebuilt."""
    return F.when(distance.isNotNull(), distance).otherwise(F.raise_error(F.lit("a chunk has no vector distance: rebuild the index")).cast("double"))


def hybrid_score(fts_rank: Column, vec_distance: Column) -> Column:
    """Weighted sum of the vector score and the clamped lexical score; a missing part counts 0."""
    vec = F.coalesce(distance_to_score(vec_distance), F.lit(0.0))
    text = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), -fts_rank)), F.lit(0.0))
    return VECTOR_WEIGHT * vec + TEXT_WEIGHT * text
