"""Removal of repeated runs of lines, found in a suffix array of line ids built by prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import join_counted, materialize, row_key
from lodestone.llm.textarrays import slices, span_digests, text_bytes, words

_POSITION = ("doc_id", "_k1", "_k2", "start")


def _line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line, and the first line of each row; a text of n line feeds has n + 1 lines."""
    feeds = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], feeds + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], feeds]), kind="stable")
    first = np.append(0, np.searchsorted(feeds, offsets[1:]) + np.arange(1, len(offsets)))
    return starts, ends, first


def _windows(counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the lines of the shortest run of ``least`` words that begins there, and that ends there (0: none)."""
    total = np.append(0, np.cumsum(counts))
    n = len(counts)
    end = np.searchsorted(total, total[:-1] + least)
    begin = np.searchsorted(total, total[1:] - least, "right") - 1
    return np.where(end <= n, end - np.arange(n), 0), np.where(begin >= 0, np.arange(1, n + 1) - begin, 0)


def _reader(least: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for begin, end in slices(offsets):
                here = offsets[begin : end + 1] - offsets[begin]
                part = data[offsets[begin] : offsets[end]]
                starts, ends, first = _line_spans(part, here)
                at = words(part, here).starts
                counts = np.searchsorted(at, ends) - np.searchsorted(at, starts)
                forward, backward = np.zeros(len(starts), np.int32), np.zeros(len(starts), np.int32)
                for r in range(end - begin):
                    rows = slice(first[r], first[r + 1])
                    forward[rows], backward[rows] = _windows(counts[rows], least)
                owner = np.repeat(np.arange(begin, end), np.diff(first))
                rows = pa.array(owner)
                digests = span_digests(part, starts, ends)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(rows) for c in ("doc_id", "_k1", "_k2")),
                        pa.array((np.arange(len(starts)) - first[owner - begin]).astype(np.int32)),
                        pa.array(np.ascontiguousarray(digests[:, 0])),
                        pa.array(np.ascontiguousarray(digests[:, 1])),
                        pa.array(forward),
                        pa.array(backward),
                    ],
                    ["doc_id", "_k1", "_k2", "start", "h1", "h2", "forward", "backward"],
                )

    return read


def _ranked(rows: DataFrame, names: list[str]) -> DataFrame:
    """Ranks, in sorted order, of the values of ``names`` that several rows share, and how many rows (``n``).

    Only distinct shared values are sorted, by range, so a value that a third
    of all rows has is one row here.
    """
    shared = rows.groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")
    return materialize(shared.orderBy(*names).withColumn("next", F.monotonically_increasing_id()), "ranks")


def repeated_windows(docs: DataFrame, least_words: int) -> DataFrame:
    """Shortest line runs of ``least_words`` words that stand earlier too: doc_id, _k1, _k2, start and lines.

    Suffixes of the sequence of line ids are ranked by their first 1, 2, 4, ...
    lines: each round joins a suffix to the one that begins where its known
    prefix ends and sorts the distinct pairs of ranks. A suffix whose prefix
    no other has is settled and leaves, so a round holds repeated text only,
    and rounds end with the longest run asked for. The suffixes that agree in
    m lines are an interval of the suffix array whose longest common prefix
    is at least m; two ranks of overlapping powers of two name it. All but
    the earliest suffix of such an interval are later copies.
    """
    keyed = docs.select("doc_id", "text", *row_key("doc_id", "text"))
    lines = materialize(
        keyed.mapInArrow(_reader(least_words), "doc_id long, _k1 long, _k2 long, start int, h1 long, h2 long, forward int, backward int"), "lines"
    )
    first = join_counted(lines, _ranked(lines.select("h1", "h2"), ["h1", "h2"]), ["h1", "h2"]).drop("h1", "h2").withColumnRenamed("next", "rank")
    # a row that is there several times over is one document
    level = materialize(first.dropDuplicates(["_k1", "_k2", "start"]), "suffixes")
    forward = level.where("forward > 0").select(*_POSITION, F.col("forward").alias("lines"))
    backward = level.where("backward > 0").select("doc_id", "_k1", "_k2", (F.col("start") - F.col("backward") + 1).alias("start"), F.col("backward").alias("lines"))
    asked = materialize(forward.unionByName(backward).distinct(), "asked")
    longest = asked.agg(F.max("lines")).first()[0] or 0
    found, power = [], 1
    level = level.select(*_POSITION, "rank")
    while power <= longest:
        ends = level.select("_k1", "_k2", F.col("start").alias("_tail"), F.col("rank").alias("tail"))
        named = (
            asked.where((F.col("lines") >= power) & (F.col("lines") < 2 * power))
            .join(level.select("_k1", "_k2", "start", "rank"), ["_k1", "_k2", "start"])
            .withColumn("_tail", F.col("start") + F.col("lines") - power)
            .join(ends, ["_k1", "_k2", "_tail"])
        )
        named = materialize(named.select(*_POSITION, "lines", "rank", "tail"), "named")
        earliest = named.groupBy("lines", "rank", "tail").agg(F.count("*").alias("n"), F.min(F.struct(*_POSITION)).alias("least")).where("n > 1")
        later = join_counted(named, materialize(earliest, "earliest"), ["lines", "rank", "tail"]).where(F.struct(*_POSITION) > F.col("least"))
        found.append(materialize(later.select(*_POSITION, "lines"), "later"))
        if 2 * power <= longest:
            pairs = level.withColumn("_tail", F.col("start") + power).join(ends, ["_k1", "_k2", "_tail"]).select(*_POSITION, "rank", "tail")
            pairs = materialize(pairs, "pairs")
            ranks = _ranked(pairs, ["rank", "tail"])
            level = materialize(join_counted(pairs, ranks, ["rank", "tail"]).select(*_POSITION, F.col("next").alias("rank")), "suffixes")
        power *= 2
    if not found:
        return asked.limit(0)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _cleaner(names: list[str]):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column("_runs").to_pylist()
            texts = batch.column("text").to_pylist()
            total, gone = [], []
            for r, text in enumerate(texts):
                lines = [] if text is None else text.split("\n")
                total.append(len(lines))
                edge = np.zeros(len(lines) + 1, np.int64)
                for run in runs[r] or ():
                    edge[run["start"]] += 1
                    edge[run["start"] + run["lines"]] -= 1
                drop = np.cumsum(edge)[:-1] > 0
                gone.append(np.flatnonzero(drop).tolist())
                if gone[-1]:
                    texts[r] = "\n".join(line for line, out in zip(lines, drop, strict=True) if not out)
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(total, pa.int32()), pa.array(gone, pa.list_(pa.int32()))], [*names, "n_lines", "removed_lines"]
            )

    return clean


def dedup_lines(docs: DataFrame, least_words: int = 50) -> DataFrame:
    """Delete the later copies of repeated runs of lines that have ``least_words`` words or more.

    A line goes if some run of whole lines around it, with that many words,
    stands at an earlier place too, in the order of doc_id, text hash and
    line; the first copy of a run stays. Runs do not cross documents; copies
    within one document count. Words are runs of non-white-space.

    Every such run is covered by the shortest runs of ``least_words`` words
    that begin or end at its lines, which occur earlier as well; so those
    windows are enough, and their union is the maximal runs.

    A null text stays null, with no lines; an empty one has one empty line.
    Rows with the same id and text are one document and get the same result.
    Null ids come first. All columns of ``docs`` are kept (but ``n_lines``
    and ``removed_lines`` are replaced, and ``_k1``, ``_k2`` and ``_runs`` dropped).
    An empty table gives an empty result. Lines of any length work; a
    document's lines are held at once.

    Returns ``docs`` with the remaining text, n_lines and removed_lines
    (numbers of the lines that went, from 0).
    """
    names = [f for f in docs.schema.names if f not in ("n_lines", "removed_lines", "_k1", "_k2", "_runs")]
    windows = repeated_windows(docs, least_words)
    runs = windows.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("start", "lines")).alias("_runs"))
    keyed = docs.select(*names, *row_key("doc_id", "text"))
    joined = keyed.join(runs, ["_k1", "_k2"], "left").select(*names, "_runs")
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return joined.mapInArrow(_cleaner(names), f"{schema}, n_lines int, removed_lines array<int>")
