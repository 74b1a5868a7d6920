"""Lexical search through a persisted posting table: only the buckets and terms of a query are read.

A posting table has a row for each trigram of each block of some thousand
chunks: which of the block's chunks have it and how often, as bytes. Rows are
in buckets by term and sorted by term within files, so that a query prunes by
partition and by row group. A row without a term holds the ids and lengths of
a block's chunks. Scores of trigrams come from these rows alone: those of a
block meet in one task, which hands on no more than the best of the block.
Phrases of more than three characters are looked up in the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import fts

BUCKETS = 64
#: Chunks and characters of a block; one text alone may be longer.
BLOCK_CHUNKS, BLOCK_CHARS = 4096, 2_500_000
POSTING = "term string, block long, n int, places binary, tfs binary, bucket int"
#: No trigram: ids and lengths of a block's chunks, and places of those that no longer count.
IDS, GONE = "", "-"
_NULL_ID = -(1 << 63)
#: So many chunk ids at most are handed to all tasks.
FEW = 20_000


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def pack(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Numbers below 2^32 in bytes of seven bits, low ones first, as one binary for each run; ``ends`` are the ends of the runs."""
    values = values.astype(np.uint32)
    width = np.ones(len(values), np.int64)
    for bits in (7, 14, 21, 28):
        width += values >= 1 << bits
    stop = np.cumsum(width)
    out = np.zeros(stop[-1], np.uint8)
    for k in range(int(width.max())):
        here = width > k
        out[(stop - width)[here] + k] = (values[here] >> np.uint32(7 * k)) & 127 | ((width[here] > k + 1) * 128).astype(np.uint32)
    offsets = np.concatenate([[0], stop[ends - 1]]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = raw < 128
    if last.all():
        return raw.astype(np.int64)
    begin = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    place = np.arange(len(raw)) - begin[np.cumsum(last) - last]
    return np.add.reduceat((raw & 127).astype(np.int64) << (7 * place), begin)


def _block(shard: str, block: int, ids: list[int], texts: list[str]) -> pa.RecordBatch:
    """The posting rows of one block."""
    tokens = np.array([max(0, len(t) - 2) for t in texts], np.int32)
    row, number, terms, tf = fts.distinct_grams(texts)
    heads = [pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([tokens.tobytes()], pa.binary())]
    counts = np.array([len(ids)], np.int32)
    if terms:
        begin = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
        ends = np.append(begin[1:], len(row))
        gaps = np.diff(row, prepend=0)
        gaps[begin] = row[begin]
        heads = [pa.concat_arrays([head, pack(values, ends)]) for head, values in zip(heads, (gaps, tf), strict=True)]
        counts = np.append(counts, ends - begin).astype(np.int32)
    names = pa.array([IDS, *terms], pa.string())
    columns = [pa.array([shard] * len(names), pa.string()), names, pa.array(np.full(len(names), block)), pa.array(counts), *heads]
    return pa.RecordBatch.from_arrays(columns, ["shard", "term", "block", "n", "places", "tfs"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks as posting rows; blocks are numbered by the task and their order in it."""
    number = TaskContext.get().partitionId() << 24
    held: dict[str, tuple[list[int], list[str], list[int]]] = {}
    for batch in batches:
        for shard, chunk_id, text in zip(*(batch.column(c).to_pylist() for c in ("shard", "chunk_id", "text")), strict=True):
            ids, texts, size = held.setdefault(shard, ([], [], [0]))
            ids.append(_NULL_ID if chunk_id is None else chunk_id)
            texts.append(fts.fold_text(text or ""))
            size[0] += len(texts[-1])
            if len(ids) >= BLOCK_CHUNKS or size[0] >= BLOCK_CHARS:
                yield _block(shard, number, ids, texts)
                number += 1
                del held[shard]
    for shard, (ids, texts, _) in held.items():
        yield _block(shard, number, ids, texts)
        number += 1


def write_postings(chunks: DataFrame, path: str, rows_per_file: int = 32_000_000, size: int | None = None, by: str | None = None) -> None:
    """The posting table of ``chunks`` (chunk_id, text) as a folder a bucket, or with ``by`` one such table for each value of a column.

    Rows of a bucket are dealt over files by block, so a term that every
    chunk has is written by many tasks; about ``rows_per_file`` pairs of
    chunk and trigram go into one, at one or two bytes each. A text has at
    most as many pairs as trigrams; ``size`` is their number if it is known.
    ``chunks`` must come in the same partitions if a task is run again, as a
    stored table does.
    """
    if size is None:
        size = chunks.agg(F.sum(fts.token_count(F.col("text")).cast("long"))).first()[0] or 0
    files = max(1, -(-size // (BUCKETS * rows_per_file)))
    named = chunks.select((F.col(by) if by else F.lit("")).alias("shard"), "chunk_id", "text")
    made = named.mapInArrow(_blocks, "shard string, term string, block long, n int, places binary, tfs binary")
    folders = ["shard", "bucket"] if by else ["bucket"]
    rows = made.withColumn("bucket", bucket_of(F.col("term")))
    dealt = rows.repartition(BUCKETS * files, "bucket", F.pmod(F.xxhash64("block"), F.lit(files))).sortWithinPartitions(*folders, "term", "block")
    (dealt if by else dealt.drop("shard")).write.partitionBy(*folders).parquet(path)


@dataclass(frozen=True)
class TextIndex:
    """What lexical search needs of an index: its postings, its chunks, and how many chunks and trigrams it has.

    ``gone`` takes rows with a chunk_id to those of chunks that no longer count, if there may be such.
    """

    postings: DataFrame
    chunks: DataFrame
    n: int
    tokens: int
    gone: Callable[[DataFrame], DataFrame] | None = None

    @property
    def mean(self) -> float:
        return fts.mean_of(self.n, self.tokens)


def _rows(index: TextIndex, terms: list[str]) -> DataFrame:
    """Posting rows of the terms; the buckets are literals, so other partitions are not listed."""
    buckets = [r[0] for r in index.postings.sparkSession.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"))).distinct().collect()]
    return index.postings.where(F.col("bucket").isin(*buckets) & F.col("term").isin(*terms)).select("block", "term", "n", "places", "tfs")


def _gone(index: TextIndex) -> DataFrame:
    """A row for each block with chunks that no longer count."""

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, found in zip(batch.column("block").to_pylist(), batch.column("places").to_pylist(), strict=True):
                known = np.frombuffer(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), block)), pa.array(np.arange(len(known))), pa.array(known)], ["block", "place", "chunk_id"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.array(places, np.int64).tobytes() for places in batch.column("places").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(packed, pa.binary())], ["block", "places"])

    every = _rows(index, [IDS]).select("block", "places").mapInArrow(ids, "block long, place long, chunk_id long")
    packed = index.gone(every).groupBy("block").agg(F.collect_list("place").alias("places")).mapInArrow(joined, "block long, places binary")
    return packed.select("block", F.lit(GONE).alias("term"), F.lit(0).alias("n"), "places", F.lit(b"").alias("tfs"))


class _BlockSeen(fts.Seen):
    """Counts of trigrams in the chunks of one block, from its rows."""

    def __init__(self, rows: dict[str, tuple[bytes, bytes]]):
        self.ids = np.frombuffer(rows[IDS][0], np.int64)
        self.tokens = np.frombuffer(rows[IDS][1], np.int32)
        self.size = len(self.ids)
        self.alive = np.ones(self.size, bool)
        if GONE in rows:
            self.alive[np.frombuffer(rows[GONE][0], np.int64)] = False
        self._rows = rows
        self._known = {}

    def gram(self, term: str) -> np.ndarray:
        if term not in self._known:
            found = np.zeros(self.size)
            if term in self._rows:
                places, tfs = self._rows[term]
                found[np.cumsum(unpack(places))] = unpack(tfs)
            self._known[term] = np.where(self.alive, found, 0.0)
        return self._known[term]

    def count(self, phrase: fts.Phrase) -> np.ndarray:
        return self.gram(phrase.text)

    def may(self, tree) -> np.ndarray:
        """Chunks that can match: phrases are read as the set of their trigrams."""
        if isinstance(tree, fts.Either):
            return np.logical_or.reduce([self.may(part) for part in tree.parts])
        if isinstance(tree, fts.Both):
            return np.logical_and.reduce([self.may(part) for part in tree.parts])
        if isinstance(tree, fts.Without):
            return self.may(tree.left)
        return np.logical_and.reduce([self.gram(g) > 0 for phrase in _phrases(tree) for g in phrase.grams])


def _by_block(indexes: dict[str, TextIndex], terms: list[str], found: Callable[[str, _BlockSeen], tuple], schema: str) -> DataFrame:
    """Rows of ``schema`` that ``found`` makes of each block, as arrays; the rows of a block for these terms meet by one exchange."""
    rows = None
    for name, index in sorted(indexes.items()):
        mine = _rows(index, [IDS, *terms])
        mine = mine.unionByName(_gone(index)) if index.gone else mine
        mine = mine.drop("n").withColumn("name", F.lit(name))
        rows = mine if rows is None else rows.unionByName(mine)
    names = [c.split()[0] for c in schema.split(", ")]

    def made(name: str, block: dict) -> Iterator[pa.RecordBatch]:
        columns = found(name, _BlockSeen(block))
        if len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, {}
        for batch in batches:
            for name, number, term, places, tfs in zip(*(batch.column(c).to_pylist() for c in ("name", "block", "term", "places", "tfs")), strict=True):
                if (name, number) != at:
                    if block:
                        yield from made(at[0], block)
                    at, block = (name, number), {}
                block[term] = (places, tfs)
        if block:
            yield from made(at[0], block)

    return rows.repartition("name", "block").sortWithinPartitions("name", "block").mapInArrow(run, schema)


def _counts(indexes: dict[str, TextIndex], terms: list[str]) -> dict[tuple[str, str], int]:
    """Chunks that have each of the terms, by index and term; at most 128 a name."""

    def count(name: str, seen: _BlockSeen) -> tuple:
        return [name] * len(terms), terms, [int(np.count_nonzero(seen.gram(t))) for t in terms]

    rows = None
    for name, index in sorted(indexes.items()) if terms else ():
        if index.gone:
            mine = _by_block({name: index}, terms, count, "name string, term string, n long")
        else:
            mine = _rows(index, terms).select(F.lit(name).alias("name"), "term", F.col("n").cast("long"))
        rows = mine if rows is None else rows.unionByName(mine)
    return {(r["name"], r["term"]): r["df"] for r in rows.groupBy("name", "term").agg(F.sum("n").alias("df")).collect()} if rows else {}


def _phrases(tree, every: bool = False) -> list[fts.Phrase]:
    """Phrases of a tree; what a match must not have only with ``every``."""
    if isinstance(tree, fts.Phrase):
        return [tree]
    if isinstance(tree, fts.Near):
        return tree.phrases
    inner = [tree.left, *([tree.right] if every else [])] if isinstance(tree, fts.Without) else tree.parts
    return [p for part in inner for p in _phrases(part, every)]


def _has_near(tree) -> bool:
    inner = [tree.left, tree.right] if isinstance(tree, fts.Without) else getattr(tree, "parts", [])
    return isinstance(tree, fts.Near) or any(map(_has_near, inner))


def _texts(index: TextIndex, tree) -> DataFrame:
    """Chunks among which are all that match.

    If the postings leave few, their ids are handed to all tasks. If not, all
    chunks are scanned where they are stored, as a scan costs less than
    moving the texts to the ids; the texts decide in both cases.
    """

    def count(name: str, seen: _BlockSeen) -> tuple:
        return ([int(np.count_nonzero(seen.may(tree)))],)

    def candidates(name: str, seen: _BlockSeen) -> tuple:
        return (seen.ids[seen.may(tree)],)

    grams = sorted({g for phrase in _phrases(tree) for g in phrase.grams})
    if (_by_block({"": index}, grams, count, "n long").agg(F.sum("n")).first()[0] or 0) > FEW:
        return index.chunks
    found = _by_block({"": index}, grams, candidates, "chunk_id long").collect()
    return index.chunks.join(F.broadcast(index.chunks.sparkSession.createDataFrame(found, "chunk_id long")), "chunk_id", "left_semi")


def _stats(indexes: dict[str, TextIndex], phrases: list[fts.Phrase]) -> dict[str, dict]:
    """For each index the chunks of each phrase: from the postings for trigrams, else from the texts, which are read once for all."""
    counts = _counts(indexes, sorted({p.text for p in phrases if p.is_gram}))
    longer = {(p.text, p.anchored): p for p in phrases if not p.is_gram}
    out = {}
    for name, index in indexes.items():
        known = {(term, False): n for (mine, term), n in counts.items() if mine == name}
        if longer:
            found = fts.statistics(_texts(index, fts.Either(list(longer.values()))), list(longer.values()))
            known |= {key: found[f"n{i}"] for i, key in enumerate(longer)}
        out[name] = {"n": index.n, "tokens": index.tokens} | {f"n{i}": known.get((p.text, p.anchored), 0) for i, p in enumerate(phrases)}
    return out


def _scored(indexes: dict[str, TextIndex], query: str, is_pattern: bool, k: int | None = None) -> DataFrame:
    """name, chunk_id and fts_rank of all matching chunks; with ``k`` of the best ``k`` of each index at least."""
    tree = fts.tree_of(query, is_pattern)
    if tree is fts.NOTHING:
        first = next(iter(indexes.values()))
        return first.chunks.limit(0).select(F.lit("").alias("name"), "chunk_id", F.lit(0.0).alias("fts_rank"))
    phrases = fts.scored_phrases(tree)
    stats = _stats(indexes, phrases)
    every = _phrases(tree, every=True)
    if all(p.is_gram for p in every) and not _has_near(tree):
        idfs = {name: [fts.idf_of(s["n"], s[f"n{i}"]) for i in range(len(phrases))] for name, s in stats.items()}
        means = {name: index.mean for name, index in indexes.items()}

        def best(name: str, seen: _BlockSeen) -> tuple:
            hit = np.flatnonzero(fts.matches(tree, seen))
            ids, rank = seen.ids[hit], fts.ranks(tree, seen, seen.tokens, idfs[name], means[name])[hit]
            kept = np.lexsort((ids, rank))[:k]
            return [name] * len(kept), ids[kept], rank[kept]

        return _by_block(indexes, sorted({p.text for p in every}), best, "name string, chunk_id long, fts_rank double")
    out = None
    for name, index in sorted(indexes.items()):
        found = fts.scored(_texts(index, tree).select("chunk_id", "text"), tree, stats[name])
        mine = found.where("_hit").select(F.lit(name).alias("name"), "chunk_id", "fts_rank")
        out = mine if out is None else out.unionByName(mine)
    return out


def ranked(index: TextIndex, query: str, is_pattern: bool = False) -> DataFrame:
    """chunk_id and fts_rank of all chunks of an index that match."""
    return _scored({"": index}, query, is_pattern).drop("name")


def topk(index: TextIndex, query: str, k: int, is_pattern: bool = False) -> DataFrame:
    """The best ``k`` chunks by BM25, ties to the smaller chunk_id: the index's chunks with fts_rank and score."""
    best = _scored({"": index}, query, is_pattern, k).drop("name").orderBy("fts_rank", "chunk_id").limit(k)
    # ``k`` rows, a parameter, are broadcast
    return index.chunks.join(F.broadcast(best), "chunk_id").withColumn("score", -F.col("fts_rank"))


def topk_each(indexes: dict[str, TextIndex], query: str, k: int, is_pattern: bool = False) -> DataFrame:
    """name, chunk_id, fts_rank and place of the best ``k`` of every index, by one plan."""
    place = F.row_number().over(Window.partitionBy("name").orderBy("fts_rank", "chunk_id"))
    return _scored(indexes, query, is_pattern, k).withColumn("place", place).where(F.col("place") <= k)
