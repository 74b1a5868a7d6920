"""Agent-session logs (JSON lines) as turns, by window functions over the lines of each file."""

from __future__ import annotations

import glob
import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.operators.chunking import MAX_CHARS, chunk_documents
from lodestone.sources.files import Candidate

#: Fixed value: the kind that an index of session logs names itself.
INDEX_KIND = "codex-history"

#: User messages that begin with, or contain, these are not the user's.
SKIPPED_HEADS = ("# AGENTS.md instructions", "The following is the Codex agent history")
SKIPPED_PART = "<environment_context>"


def session_files(roots: list[str]) -> list[str]:
    """JSON-lines files below the roots, or an error that names the root that is none."""
    if not roots:
        raise ValueError("no session root given")
    for root in roots:
        if not os.path.exists(root):
            raise ValueError(f"session root does not exist: {root}")
        if os.path.isfile(root) and not root.endswith(".jsonl"):
            raise ValueError(f"not a .jsonl file: {root}")
    found = {os.path.realpath(p) for r in roots for p in ([r] if os.path.isfile(r) else glob.glob(f"{r}/**/*.jsonl", recursive=True, include_hidden=True))}
    return sorted(found)


def candidates(roots: list[str]) -> list[Candidate]:
    """The session files with the root they are below: of several, the one of the shortest path."""
    folders = sorted((os.path.dirname(r) if os.path.isfile(r) else r for r in map(os.path.realpath, roots)), key=lambda r: (len(r), r))
    out = []
    for path in session_files(roots):
        root = next((r for r in folders if os.path.commonpath([path, r]) == r), os.path.dirname(path))
        out.append(Candidate(path, root, os.path.relpath(path, root).replace(os.sep, "/")))
    return out


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, line_no (from 1) and line of every line of the files."""
    whole = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/").alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", "\r\n|\r|\n")).alias("p", "line")).select("path", (F.col("p") + 1).alias("line_no"), "line")


def _text_of(content: Column) -> Column:
    """A message's text: a string as it is, or the text parts of a list, one below the other; stripped."""
    parts = F.from_json(content, "array<struct<text:string>>")
    texts = F.filter(F.transform(parts, lambda p: p["text"]), lambda t: t.isNotNull() & (t != ""))
    joined = F.when(F.startswith(F.ltrim(content), F.lit("[")), F.array_join(texts, "\n")).otherwise(content)
    return strip(F.coalesce(joined, F.lit("")))


def turns(lines: DataFrame) -> DataFrame:
    """User and final assistant messages with the session they belong to.

    ``lines`` has path, line_no and line. A session's id, directory and kind
    hold from its meta line to the next, a turn's id from its start on,
    across metas. A session is a subagent's if its source is an object with that key. Lines of subagent sessions and lines before any meta are
    passed over, and so are lines that are no JSON object.
    """
    of = lambda path: F.get_json_object("line", path)
    kind, inner = of("$.type"), of("$.payload.type")
    source = F.ltrim(F.coalesce(of("$.payload.source"), F.lit("")))
    by_line = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parsed = lines.where(F.startswith(F.ltrim("line"), F.lit("{")) & F.startswith(F.ltrim(of("$.payload")), F.lit("{"))).select(
        "path", "line_no", kind.alias("kind"), inner.alias("inner"),
        F.when(kind == "session_meta", F.struct(of("$.payload.id").alias("id"), of("$.payload.cwd").alias("cwd"), F.coalesce(F.array_contains(F.json_object_keys(source), "subagent"), F.lit(False)).alias("sub"))).alias("meta"),
        of("$.payload.turn_id").alias("turn"), of("$.payload.role").alias("role"), of("$.payload.phase").alias("phase"),
        of("$.payload.content").alias("content"), of("$.timestamp").alias("timestamp"),
    )
    # structs are carried, so that a null id within a meta line is a value too
    known = parsed.withColumn("session", F.last("meta", ignorenulls=True).over(by_line))
    started = F.when((F.col("kind") == "event_msg") & (F.col("inner") == "task_started") & ~F.coalesce("session.sub", F.lit(False)), F.struct("turn"))
    placed = known.withColumn("task", F.last(started, ignorenulls=True).over(by_line))
    text = _text_of(F.col("content"))
    said = placed.where((F.col("kind") == "response_item") & (F.col("inner") == "message") & F.col("session.id").isNotNull() & ~F.col("session.sub")).select(
        F.col("session.id").alias("session_id"), F.coalesce("session.cwd", F.lit("")).alias("cwd"), "role", "phase", text.alias("text"),
        F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.col("task.turn").alias("turn_id"), F.col("path").alias("session_path"), "line_no",
    )
    own = ~(F.startswith("text", F.lit(SKIPPED_HEADS[0])) | F.startswith("text", F.lit(SKIPPED_HEADS[1])) | F.contains("text", F.lit(SKIPPED_PART)))
    wanted = ((F.col("role") == "user") & own) | ((F.col("role") == "assistant") & (F.col("phase") == "final_answer"))
    return said.where(wanted & (F.col("text") != "")).drop("phase")


def turn_chunks(found: DataFrame, size: int = MAX_CHARS) -> DataFrame:
    """Turns in chunks numbered through their file; a turn that fits is one chunk as it stands."""
    keys = ["session_id", "cwd", "role", "turn_id", "timestamp", "session_path", "line_no"]
    short = found.where(F.length("text") <= size).select(
        *keys, F.lit(0).alias("chunk_index"), F.lit(0).alias("start_offset"), F.length("text").alias("end_offset"), F.lit(1).alias("start_line"),
        (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("int").alias("end_line"), "text",
    )
    long = chunk_documents(found.where(F.length("text") > size), keys, F.col("text"), F.lit(""), size)
    order = Window.partitionBy("session_path").orderBy("line_no", "chunk_index")
    return short.unionByName(long).withColumn("chunk_index", F.row_number().over(order) - 1)
