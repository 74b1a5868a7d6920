"""Catalog, statistics and maintenance operators over files and chunks tables."""

from __future__ import annotations

import hashlib
import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What indexes must agree in to be searched together by vector.
COMPATIBLE_KEYS = ("embedding_model", "embedding_dim", "embedding_backend", "embedding_prefix_policy")
STATE = ("path", "root_path", "relative_path", "size", "mtime_ns", "content_hash")


def files_list(files: DataFrame) -> DataFrame:
    return files.select(*STATE).orderBy("relative_path", "path")


def roots_summary(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Files and chunks of every root; a root without chunks has 0."""
    per_file = chunks.groupBy("path").agg(F.count("*").alias("c"))
    joined = files.select("root_path", "path").join(per_file, "path", "left")
    return joined.groupBy("root_path").agg(F.count("*").alias("files"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("chunks")).orderBy("root_path")


def index_info(files: DataFrame, chunks: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files")).crossJoin(chunks.agg(F.count("*").alias("chunks")))


def removed_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Indexed files that the scan did not see."""
    return files.join(seen.select("path"), "path", "left_anti")


def remaining_files(files: DataFrame, seen: DataFrame) -> DataFrame:
    return files.join(seen.select("path").distinct(), "path", "left_semi")


def changed_files(scanned: DataFrame, files: DataFrame, columns: tuple[str, ...] = STATE) -> DataFrame:
    """Scanned files that differ from the index in any of the columns, or are new; nulls compare as values."""
    old = files.select(*[F.col(c).alias(f"old_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    return scanned.join(old, same, "left_anti")


def index_stats(scanned: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row of counters of an incremental run: scanned, changed, unchanged and removed files, and new chunks."""
    changed = changed_files(scanned, files).select("path")
    counts = scanned.agg(F.count("*").alias("scanned")).crossJoin(changed.agg(F.count("*").alias("indexed")))
    gone = removed_files(files, scanned).agg(F.count("*").alias("removed"))
    made = chunks.join(changed, "path", "left_semi").agg(F.count("*").alias("chunks"))
    return counts.crossJoin(gone).crossJoin(made).withColumn("unchanged", F.col("scanned") - F.col("indexed"))


def upsert_metadata(metadata: DataFrame, changes: DataFrame) -> DataFrame:
    """Key-value rows with ``changes`` put in."""
    return metadata.join(changes.select("key"), "key", "left_anti").unionByName(changes)


def summarize_timings(timings: DataFrame) -> DataFrame:
    """Mean, median, least and greatest seconds, and throughputs by mean."""
    mean = F.avg("seconds")
    return timings.groupBy("name").agg(
        mean.alias("mean"), F.median("seconds").alias("median"), F.min("seconds").alias("min"), F.max("seconds").alias("max"),
        (F.avg("vectors") / mean).alias("vectors_per_second"), (F.avg("chars") / mean).alias("chars_per_second"),
    )


def check_compatible(metadata: list[dict[str, str]]) -> None:
    """Raise unless all indexes have the same embedding, all parts of it named."""
    for key in COMPATIBLE_KEYS:
        values = {m.get(key, "") for m in metadata}
        if "" in values or len(values) > 1:
            raise ValueError(f"indexes differ in {key}: {sorted(values)}")


def normalized_paths(paths: list[str]) -> list[str]:
    """Index paths in order, each once: local ones are expanded and resolved, those of a named file system stay as they are."""
    return sorted({p if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", p) else os.path.realpath(os.path.expanduser(p)) for p in paths})


def set_hash(paths: list[str]) -> str:
    """A short name of a set of indexes, however their paths are written."""
    return hashlib.sha256("\n".join(normalized_paths(paths)).encode()).hexdigest()[:24]


def as_json(rows: list[dict] | dict) -> str:
    return json.dumps(rows, ensure_ascii=False, indent=2, sort_keys=True)
