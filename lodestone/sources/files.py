"""Scan of directories of text files, with the rules of the index."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes read by default and folders never entered.
EXTENSIONS = (".txt", ".md", ".markdown", ".rst")
PRUNED = {".git", ".venv", "__pycache__"}
FILE_SCHEMA = "path string, root_path string, relative_path string, size long, mtime_ns long, content_hash string, text string"


@dataclass(frozen=True)
class Candidate:
    path: str
    root_path: str
    relative_path: str


def extensions_of(wanted: list[str] | None) -> set[str]:
    """Suffixes with their dots; the defaults if none is given."""
    return {e if e.startswith(".") else f".{e}" for e in wanted or EXTENSIONS}


def scan(roots: list[str], extensions: list[str] | None = None, excludes: list[str] | None = None) -> tuple[list[Candidate], int]:
    """Files below the roots in order of path, and how many an exclusion removed.

    Folders that begin with a dot are not entered; files that do are read.
    The suffix is case-sensitive. Exclusions are regular expressions searched
    in the path below the root; one that is not valid raises ``re.error``. A
    root that is a file has its folder as its root. A file below several
    roots belongs to the first; a file named itself wins over a folder. A
    link to a file outside its root is passed over.
    """
    suffixes = extensions_of(extensions)
    patterns = [re.compile(p) for p in excludes or ()]
    found: dict[str, Candidate] = {}
    excluded = 0

    def offer(path: str, root: str, force: bool) -> None:
        nonlocal excluded
        real = os.path.realpath(path)
        if os.path.splitext(path)[1] not in suffixes or os.path.commonpath([real, root]) != root:
            return
        relative = os.path.relpath(real, root).replace(os.sep, "/")
        if any(p.search(relative) for p in patterns):
            excluded += 1
        elif force or real not in found:
            found[real] = Candidate(real, root, relative)

    for root in map(os.path.realpath, roots):
        if os.path.isfile(root):
            offer(root, os.path.dirname(root), True)
            continue
        for folder, inner, names in os.walk(root):
            inner[:] = sorted(d for d in inner if d not in PRUNED and not d.startswith("."))
            for name in sorted(names):
                offer(os.path.join(folder, name), root, False)
    return [found[p] for p in sorted(found, key=lambda p: p.split(os.sep))], excluded


def _reader(content: bool, text: bool):
    """Rows of files that can be read: with hashes if ``content`` is read, and texts if they are UTF-8 and wanted."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = _one(row, content, text)
                if found:
                    yield pa.RecordBatch.from_pylist([found], schema=_ARROW if text else _ARROW.remove(len(_ARROW) - 1))

    return read


_ARROW = pa.schema([(n, pa.int64() if n in ("size", "mtime_ns") else pa.string()) for n in ("path", "root_path", "relative_path", "size", "mtime_ns", "content_hash", "text")])


def _one(row: dict, content: bool, text: bool) -> dict | None:
    try:
        stat = os.stat(row["path"])
        found = dict(row, size=stat.st_size, mtime_ns=stat.st_mtime_ns, content_hash=None)
        if content:
            with open(row["path"], "rb") as file:
                raw = file.read()
            decoded = raw.decode("utf-8")
            found["content_hash"] = hashlib.sha256(raw).hexdigest()
            if text:
                found["text"] = decoded
    except (OSError, UnicodeDecodeError):
        return None
    return found


def _listed(spark: SparkSession, candidates: list[Candidate], per_task: int) -> DataFrame:
    rows = [(c.path, c.root_path, c.relative_path) for c in candidates]
    listed = spark.createDataFrame(rows, "path string, root_path string, relative_path string")
    return listed.repartition(max(1, len(rows) // per_task), "path")


def stat_files(spark: SparkSession, candidates: list[Candidate], per_task: int = 4096) -> DataFrame:
    """The files' states without a hash: no byte of them is read."""
    return _listed(spark, candidates, per_task).mapInArrow(_reader(False, False), FILE_SCHEMA.removesuffix(", text string"))


def hash_files(spark: SparkSession, candidates: list[Candidate], per_task: int = 256) -> DataFrame:
    """The files' states; those that are not UTF-8 or cannot be read are left out."""
    return _listed(spark, candidates, per_task).mapInArrow(_reader(True, False), FILE_SCHEMA.removesuffix(", text string"))


def read_files(spark: SparkSession, candidates: list[Candidate], per_task: int = 256) -> DataFrame:
    """The files' states and texts; those that are not UTF-8 or cannot be read are left out.

    Every executor must see the paths, as with any file source.
    """
    return _listed(spark, candidates, per_task).mapInArrow(_reader(True, True), FILE_SCHEMA)


def suffix_filter(path: Column, extensions: list[str] | None = None) -> Column:
    """Whether a path has one of the suffixes."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1).isin(*sorted(extensions_of(extensions)))
