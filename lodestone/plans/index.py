"""Index folders: segments of Parquet tables that are only ever added, and manifests that say which of them count.

A run writes one segment: the files that are new or changed, their chunks and
postings, and the ids of the files that no longer count. What an older
segment holds is never written again, so a run costs what has changed. Reads
leave out the files that later segments name as gone. Once there are more
than ``SEGMENTS`` of them, a run merges all into one.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import catalog
from lodestone.operators.chunking import chunk_documents
from lodestone.operators.embedding import Embedder, embed
from lodestone.operators.fts import token_count
from lodestone.plans.lookup import POSTING, TextIndex, write_postings
from lodestone.plans.store import Store
from lodestone.sources import files as file_source
from lodestone.sources import sessions

SCHEMA_VERSION = "3"
SEGMENTS = 16
#: Ids of files that are broadcast at most, at 8 bytes each.
MOST_GONE = 2_000_000
#: A chunk's id is its file's id and its place there, so no two chunks share one.
PLACE_BITS = 24
_FILES = "path string, root_path string, relative_path string, size long, mtime_ns long, content_hash string, file_id long, n_chunks long, n_tokens long"
_CHUNKS = (
    "path string, chunk_index int, start_offset int, end_offset int, start_line int, end_line int, text string, session_id string, cwd string, role string, "
    "turn_id string, timestamp string, session_path string, line_no int, embedding array<float>, chunk_id long, file_id long"
)
SESSION = {"session_id": "string", "cwd": "string", "role": "string", "turn_id": "string", "timestamp": "string", "session_path": "string", "line_no": "int"}
CHUNK_COLUMNS = [c.split()[0] for c in _CHUNKS.split(", ")]
Progress = Callable[[str, int], None]


@dataclass
class Stats:
    scanned: int = 0
    excluded: int = 0
    indexed: int = 0
    skipped: int = 0
    chunks: int = 0
    removed: int = 0


@dataclass
class Index:
    """An index folder. A reader keeps the version it opened; ``refresh`` moves on to the current one."""

    spark: SparkSession
    path: str
    version: int = 0
    metadata: dict[str, str] = field(default_factory=dict)
    segments: list[int] = field(default_factory=list)
    next_file: int = 0

    @property
    def store(self) -> Store:
        return Store(self.spark, self.path)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Index:
        found = cls._latest(spark, path)
        if found is None:
            raise FileNotFoundError(f"no index at {path}")
        return found

    @classmethod
    def _latest(cls, spark: SparkSession, path: str) -> Index | None:
        store = Store(spark, path)
        versions = [int(n[len("manifest-") : -len(".json")]) for n in store.names() if n.startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return None
        found = json.loads(store.read(f"manifest-{max(versions)}.json"))
        return cls(spark, path, found["version"], found["metadata"], found["segments"], found["next_file"])

    def refresh(self) -> bool:
        """Whether there is a newer version; one with another embedding is an error."""
        now = Index.open(self.spark, self.path)
        if now.version == self.version:
            return False
        catalog.check_compatible([self.metadata, now.metadata])
        self.version, self.metadata, self.segments, self.next_file = now.version, now.metadata, now.segments, now.next_file
        return True

    def fingerprint(self) -> dict:
        """What tells two states of an index apart: its path, version, size and metadata."""
        row = self.files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.max("mtime_ns").alias("mtime_ns")).first()
        return {"path": self.path, "version": self.version, "files": row["n"], "size": row["size"], "mtime_ns": row["mtime_ns"], "metadata": dict(self.metadata)}

    def _live(self, name: str, schema: str, file_id: F.Column) -> DataFrame:
        """Rows of all segments but those of files that a later segment says are gone; ids are never used again."""
        if not self.segments:
            return self.spark.createDataFrame([], schema)
        paths = [self.store.at(f"segment-{s}", name) for s in self.segments]
        rows = self.spark.read.schema(schema).parquet(*paths)
        return self._without_gone(rows, file_id)

    def _gone(self) -> DataFrame | None:
        """Ids of files that later segments say are gone."""
        # the first segment names none, and one of an older version has no such table
        paths = [self.store.at(f"segment-{s}", "gone") for s in self.segments[1:]]
        return self.spark.read.schema("gone_id long").parquet(*paths) if paths else None

    def _without_gone(self, rows: DataFrame, file_id: F.Column) -> DataFrame:
        gone = self._gone()
        if gone is None:
            return rows
        # so many ids are handed to all tasks, and chunks stay where they are; more are joined by an exchange
        gone = F.broadcast(gone) if gone.count() <= MOST_GONE else gone
        return rows.join(gone, file_id == F.col("gone_id"), "left_anti")

    @property
    def files(self) -> DataFrame:
        """Files; tables of an older version lack the paths below the root, which are then whole."""
        found = self._live("files", _FILES, F.col("file_id"))
        return found.withColumns({"root_path": F.coalesce("root_path", F.lit("")), "relative_path": F.coalesce("relative_path", "path")})

    @property
    def chunks(self) -> DataFrame:
        """Chunks with their files; tables of an older version have nulls for columns they lack."""
        found = self._live("chunks", _CHUNKS, F.col("file_id"))
        return found.withColumns({"start_line": F.coalesce("start_line", F.lit(1)), "end_line": F.coalesce("end_line", F.lit(1))})

    @property
    def vectors(self) -> DataFrame:
        return self.chunks.select("chunk_id", "embedding")

    @property
    def text(self) -> TextIndex | None:
        """Postings with the counts that scores need; none for an index of an older version, whose chunks are scanned instead."""
        if not self.segments or self.metadata.get("schema_version") != SCHEMA_VERSION:
            return None
        sums = self.files.agg(F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).first()
        # bucket folders are partitions of each segment's table
        parts = []
        for place, s in enumerate(self.segments):
            rows = self.spark.read.schema(POSTING).parquet(self.store.at(f"segment-{s}", "postings"))
            # each segment numbers its blocks by itself, in fewer than 48 bits
            parts.append(rows.withColumn("block", F.col("block") + F.lit(place << 48)))
        postings = parts[0]
        for more in parts[1:]:
            postings = postings.unionByName(more)
        gone = self._gone()
        taken = None if gone is None else lambda rows: rows.join(gone, F.shiftright("chunk_id", PLACE_BITS) == F.col("gone_id"), "left_semi")
        return TextIndex(postings, self.chunks.drop("embedding"), sums["n"], sums["tokens"], taken)

    def commit(self, files: DataFrame, chunks: DataFrame, gone: DataFrame, metadata: dict[str, str], fresh: bool, next_file: int) -> None:
        """Write a segment and then the manifest that counts it in, alone if ``fresh``; two writers cannot publish one version."""
        version = self.version + 1
        name = f"segment-{version}"
        self.store.delete(name)
        chunks.write.parquet(self.store.at(name, "chunks"))
        chunks = self.spark.read.schema(_CHUNKS).parquet(self.store.at(name, "chunks"))
        per = chunks.groupBy("file_id").agg(F.count("*").alias("n_chunks"), F.sum(token_count(F.col("text")).cast("long")).alias("n_tokens"))
        counted = files.join(per, "file_id", "left").fillna(0, ["n_chunks", "n_tokens"]).select(*[c.split()[0] for c in _FILES.split(", ")])
        counted.write.parquet(self.store.at(name, "files"))
        gone.select(F.col("file_id").alias("gone_id")).write.parquet(self.store.at(name, "gone"))
        size = self.spark.read.schema(_FILES).parquet(self.store.at(name, "files")).agg(F.sum("n_tokens")).first()[0]
        write_postings(chunks, self.store.at(name, "postings"), size=size or 0)
        segments = [version] if fresh else [*self.segments, version]
        manifest = {"version": version, "metadata": metadata, "segments": segments, "next_file": next_file}
        self.store.publish(f"manifest-{version}.json", json.dumps(manifest))
        self.version, self.metadata, self.segments, self.next_file = version, metadata, segments, next_file

    def merge(self) -> None:
        """Write all that counts into one segment."""
        self.commit(self.files.drop("n_chunks", "n_tokens"), self.chunks, self.files.limit(0), self.metadata | {"schema_version": SCHEMA_VERSION}, True, self.next_file)

    def vacuum(self) -> None:
        """Delete segments and manifests that the current version does not name; readers of older versions must be gone."""
        keep = {f"manifest-{self.version}.json", *(f"segment-{s}" for s in self.segments)}
        for name in self.store.names():
            if name.startswith(("manifest-", "segment-", ".manifest-")) and name not in keep:
                self.store.delete(name)


def check_session_index(metadata: dict[str, str]) -> None:
    """Raise unless an index is one of session logs."""
    if metadata.get("index_kind") != sessions.INDEX_KIND:
        raise ValueError(f"not an index of session logs: its kind is {metadata.get('index_kind')!r}")


def _begin(spark: SparkSession, path: str, model: Embedder, rebuild: bool, offline: bool, kind: str) -> tuple[Index, dict[str, str]]:
    if rebuild and offline:
        raise ValueError("rebuild and offline rebuild exclude each other")
    index = Index._latest(spark, path) or Index(spark, path)
    config = model.config
    now = {
        "schema_version": SCHEMA_VERSION, "index_kind": kind, "embedding_model": config.model, "embedding_dim": str(config.dim), "embedding_backend": config.backend,
        "embedding_device": config.device, "embedding_batch_size": str(config.batch), "embedding_prefix_policy": config.prefixes,
    }
    if index.version and not (rebuild or offline):
        catalog.check_compatible([index.metadata, now])
        if index.segments:
            # its postings stay as that version wrote them, so searches scan until a merge or a rebuild
            now["schema_version"] = index.metadata.get("schema_version", "1")
    now["created_at"] = index.metadata.get("created_at") or datetime.datetime.now(datetime.UTC).isoformat()
    if offline and index.segments:
        # readers find an empty index until the first files are there
        empty = index.files.limit(0)
        index.commit(empty.drop("n_chunks", "n_tokens"), index.chunks.limit(0), empty, now, True, index.next_file)
    return index, now


def _write(index: Index, metadata: dict[str, str], states: DataFrame, fresh: DataFrame, ids: DataFrame, gone: DataFrame, model: Embedder, alone: bool, taken: int) -> int:
    """One segment of the files in ``ids`` (path, file_id), whose chunks are ``fresh``; how many chunks it has."""
    # the listing is as long as the run's files, so the join shuffles if it is long
    placed = fresh.join(ids, "path").withColumn("chunk_id", F.shiftleft("file_id", PLACE_BITS) + F.col("chunk_index"))
    made = embed(placed, model)
    for name, kind in SESSION.items():
        if name not in made.columns:
            made = made.withColumn(name, F.lit(None).cast(kind))
    files = states.select(*catalog.STATE).join(ids, "path")
    index.commit(files, made.select(*CHUNK_COLUMNS), gone, metadata, alone, taken)
    rows = index.spark.read.schema(_CHUNKS).parquet(index.store.at(f"segment-{index.version}", "chunks"))
    return rows.count()


def _numbered(spark: SparkSession, paths: list[str], first: int) -> DataFrame:
    """Ids for files in the order of the scan, on from ``first``."""
    return spark.createDataFrame([(p, first + i) for i, p in enumerate(paths)], "path string, file_id long")


def _batches(changed: list[str], size: int | None) -> list[list[str]]:
    return [changed[a : a + size] for a in range(0, len(changed), size)] if size and changed else [changed]


def index_paths(
    spark: SparkSession,
    path: str,
    roots: list[str],
    model: Embedder,
    extensions: list[str] | None = None,
    excludes: list[str] | None = None,
    rebuild: bool = False,
    offline: bool = False,
    batch_files: int | None = None,
    by_stat: bool = False,
    progress: Progress | None = None,
) -> Stats:
    """Bring an index up to date with its roots; only new and changed files are read as text, chunked and embedded.

    All files are read once for their hashes, unless ``by_stat`` takes size
    and time for enough. Files that are gone, newly excluded, below roots not
    named, or no longer UTF-8 leave the index. A reader sees the old version
    until all is written, or until a batch of ``batch_files`` is; with
    ``rebuild`` it sees the old index to the end, with ``offline`` an empty
    one from the start. ``progress`` is told of each step and a number.
    """
    tell = progress or (lambda step, number: None)
    candidates, excluded = file_source.scan(roots, extensions, excludes)
    tell("scanned", len(candidates))
    index, metadata = _begin(spark, path, model, rebuild, offline, "files")
    known = index.files.limit(0) if rebuild else index.files
    columns = [c for c in catalog.STATE if c != "content_hash" or not by_stat]
    states = (file_source.stat_files if by_stat else file_source.hash_files)(spark, candidates).persist()
    changed = {r["path"] for r in catalog.changed_files(states, known, tuple(columns)).select("path").collect()}
    seen = states.count()
    left = catalog.removed_files(known, states)
    removed = left.count()
    wanted = [c for c in candidates if c.path in changed]
    chunks, indexed, skipped = 0, 0, len(candidates) - seen
    for turn, batch in enumerate(_batches([c.path for c in wanted], batch_files)):
        mine = set(batch)
        texts = file_source.read_files(spark, [c for c in wanted if c.path in mine]).persist()
        ids = _numbered(spark, batch, index.next_file)
        suffix = F.regexp_extract("path", r"(\.[^./]*)$", 1)
        fresh = chunk_documents(texts, ["path"], F.col("text"), suffix)
        gone = known.join(ids.select("path"), "path", "left_semi").select("file_id")
        gone = gone.unionByName(left.select("file_id")) if turn == 0 else gone
        if batch or removed or not index.version or (rebuild and turn == 0):
            chunks += _write(index, metadata, texts.drop("text"), fresh, ids, gone, model, rebuild and turn == 0, index.next_file + len(batch))
            read = texts.count()
            # a file that could be hashed and yet not decoded
            indexed, skipped = indexed + read, skipped + len(batch) - read
            tell("indexed", indexed)
        texts.unpersist()
    states.unpersist()
    if len(index.segments) > SEGMENTS:
        index.merge()
    return Stats(len(candidates), excluded, indexed, skipped, chunks, removed)


def index_sessions(
    spark: SparkSession, path: str, roots: list[str], model: Embedder, rebuild: bool = False, offline: bool = False, progress: Progress | None = None
) -> Stats:
    """The same for session logs; files whose size and time are known are not read, and those without a turn are skipped."""
    tell = progress or (lambda step, number: None)
    candidates = sessions.candidates(roots)
    tell("scanned", len(candidates))
    index, metadata = _begin(spark, path, model, rebuild, offline, sessions.INDEX_KIND)
    known = index.files.limit(0) if rebuild else index.files
    by_stat = tuple(c for c in catalog.STATE if c != "content_hash")
    stats = file_source.stat_files(spark, candidates)
    changed = {r["path"] for r in catalog.changed_files(stats, known, by_stat).select("path").collect()}
    scanned = file_source.read_files(spark, [c for c in candidates if c.path in changed]).persist()
    lines = scanned.select("path", F.posexplode(F.split("text", "\r\n|\r|\n")).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")
    fresh = sessions.turn_chunks(sessions.turns(lines)).withColumn("path", F.col("session_path"))
    with_turns = {r["path"] for r in fresh.select("path").distinct().collect()}
    listed = spark.createDataFrame([(c.path,) for c in candidates], "path string")
    left = catalog.removed_files(known, listed)
    removed = left.count()
    order = [c.path for c in candidates if c.path in with_turns]
    again = spark.createDataFrame([(p,) for p in sorted(changed)], "path string")
    gone = known.join(again, "path", "left_semi").select("file_id").unionByName(left.select("file_id"))
    chunks = 0
    if changed or removed or not index.version or rebuild:
        ids = _numbered(spark, order, index.next_file)
        chunks = _write(index, metadata, scanned.drop("text"), fresh, ids, gone, model, rebuild, index.next_file + len(order))
        tell("indexed", len(order))
    scanned.unpersist()
    if len(index.segments) > SEGMENTS:
        index.merge()
    return Stats(len(candidates), 0, len(order), len(candidates) - len(order), chunks, removed)
