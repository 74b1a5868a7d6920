"""Concatenate-and-cut packing of tokenised documents into fixed windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import materialize
from lodestone.llm.textarrays import slices, text_bytes
from lodestone.llm.wordbpe import encoder


def _tokenizer(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, before = TaskContext.get().partitionId(), 0
        bpe = encoder(path)
        kind = np.dtype("<u2" if bpe.size <= 1 << 16 else "<u4")
        for batch in batches:
            texts = batch.column("text")
            _, offsets = text_bytes(texts)
            for begin, end in slices(offsets, 2 << 20):
                ids, counts = bpe.encode(texts[begin:end])
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id).astype(kind)
                counts = counts + 1
                ends = np.cumsum(counts)
                at = np.append(0, ends * kind.itemsize).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), end - begin, [None, pa.py_buffer(at), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[begin:end],
                        pa.array(np.full(end - begin, task, np.int64)),
                        pa.array(before + ends - counts),
                        pa.array(counts),
                        packed,
                        pa.array(np.full(end - begin, kind.itemsize, np.int32)),
                    ],
                    ["doc_id", "task", "before", "doc_tokens", "ids", "width"],
                )
                before += int(ends[-1])

    return run


def tokenize(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """First pass: every document's ids, its task and the ids before it within that task, as a written table."""
    return materialize(
        docs.select("doc_id", "text").mapInArrow(
            _tokenizer(vocabulary, end_id), "doc_id long, task long, before long, doc_tokens long, ids binary, width int"
        ),
        "tokens",
    )


def _cutter(bases, window: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = bases.value
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "start", "length", "crc", "at", "ids")}
            tasks, before, counts, widths = (batch.column(c).to_numpy() for c in ("task", "before", "doc_tokens", "width"))
            for row, raw in enumerate(batch.column("ids")):
                ids = np.frombuffer(raw.as_buffer(), f"<u{widths[row]}").astype("<u4")
                here, done = int(base[tasks[row]] + before[row]), 0
                while done < counts[row]:
                    take = min(int(counts[row]) - done, window - (here + done) % window)
                    piece = ids[done : done + take]
                    out["row"].append(row)
                    out["start"].append(done)
                    out["length"].append(take)
                    out["crc"].append(zlib.crc32(piece))
                    out["at"].append(here + done)
                    if with_ids:
                        out["ids"].append(piece.tolist())
                    done += take
            at = np.array(out["at"], np.int64)
            rows = pa.array(out["row"], pa.int64())
            columns = [
                batch.column("doc_id").take(rows),
                pa.array(out["start"], pa.int64()),
                pa.array(out["length"], pa.int64()),
                pa.array(out["crc"], pa.int64()),
                batch.column("doc_tokens").take(rows),
                pa.array(at // window),
                pa.array(at % window),
            ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                columns.append(pa.array(out["ids"], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return cut


def pack(docs: DataFrame, vocabulary: str, window: int = 4096, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Lay all documents' ids in one line and cut it into windows of ``window`` ids.

    The first pass tokenises each document once and writes its ids beside
    the count of ids before it in its task. Summed by task and prefix-summed,
    those counts give each document's place in the line; the second pass
    cuts at multiples of ``window``. Every window but the last is full, so
    padding is below one window in all. Windows do not mind where a document
    begins: one that crosses a border leaves a record on either side.

    Only one number a task of the first pass reaches the driver and goes to
    the workers, as many as the scan has splits.

    A null text is empty: its one id is ``end_id``. Rows with the same id and
    text are packed once each. Null ids are carried along. Further columns
    are not read. An empty table gives no pieces. Texts of any length work,
    one document at a time.

    Returns a row a piece: doc_id, start (ids of its document before it),
    length, ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens
    (with the end id), sequence_id, offset and, if ``with_ids``, the ids.
    """
    tokens = tokenize(docs, vocabulary, end_id)
    totals = {r["task"]: r["n"] for r in tokens.groupBy("task").agg(F.sum("doc_tokens").alias("n")).collect()}
    sums = np.zeros(max(totals, default=0) + 2, np.int64)
    for task, n in totals.items():
        sums[task + 1] = n
    shared = docs.sparkSession.sparkContext.broadcast(np.cumsum(sums))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return tokens.mapInArrow(_cutter(shared, window, with_ids), schema + ", ids array<int>" * with_ids)
