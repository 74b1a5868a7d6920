"""Chunking of documents: overlapping windows, paragraph packing and Markdown sections.

All run in Arrow batch functions, row by row without a shuffle: packing and
sections keep state from line to line, and a window is a slice of its text,
which column functions could only reach from the text's begin.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP = 600, 120
#: About so many characters of windows are handed on at once.
WINDOW_CHARS = 4_000_000
MARKDOWN = (".md", ".markdown")
CHUNK_SCHEMA = "chunk_index int, start_offset int, end_offset int, start_line int, end_line int, text string"


@dataclass(frozen=True)
class Chunk:
    start: int
    end: int
    text: str
    start_line: int = 1
    end_line: int = 1


@dataclass(frozen=True)
class _Line:
    start: int
    end: int
    text: str

    @property
    def blank(self) -> bool:
        return not self.text.strip()


def _lines(text: str) -> list[_Line]:
    out, at = [], 0
    for piece in text.splitlines(keepends=True):
        out.append(_Line(at, at + len(piece), piece))
        at += len(piece)
    return out


def _fence_of(line: _Line) -> str:
    found = re.match(r"\s*(`{3,}|~{3,})", line.text)
    return found[1] if found else ""


def _outside_fences(lines: list[_Line]) -> Iterator[tuple[_Line, bool]]:
    """Each line and whether it is outside fenced code; the fences themselves are inside."""
    fence = ""
    for line in lines:
        if fence:
            yield line, False
            if line.text.lstrip().startswith(fence):
                fence = ""
        else:
            fence = _fence_of(line)
            yield line, not fence


def _paragraphs(lines: list[tuple[_Line, bool]]) -> list[Chunk]:
    """Runs of lines that are neither blank nor fenced, stripped; each ends after its last line."""
    out = []
    for wanted, run in groupby(lines, key=lambda item: item[1] and not item[0].blank):
        if wanted:
            members = [line for line, _ in run]
            out.append(Chunk(members[0].start, members[-1].end, "".join(m.text for m in members).strip()))
    return out


def windows(length: int, size: int = MAX_CHARS) -> list[tuple[int, int]]:
    """Windows of ``size`` with an overlap of 120, up to the one that reaches the end."""
    stride = max(1, size - OVERLAP)
    count = 1 + max(0, -(-(length - size) // stride))
    return [(k * stride, min(length, k * stride + size)) for k in range(count)]


def _pack(paragraphs: list[Chunk], size: int, carry: bool) -> list[Chunk]:
    """Fill chunks with whole paragraphs, a blank line between; with ``carry`` the last one opens the next chunk if it fits.

    A paragraph that is too long is cut into windows and nothing is carried over it.
    """
    out: list[Chunk] = []
    held: list[Chunk] = []

    def joined(parts: list[Chunk]) -> str:
        return "\n\n".join(p.text for p in parts)

    def close() -> None:
        if held:
            out.append(Chunk(held[0].start, held[-1].end, joined(held)))

    for paragraph in paragraphs:
        if len(paragraph.text) > size:
            close()
            held = []
            out += [Chunk(paragraph.start + a, paragraph.start + b, paragraph.text[a:b]) for a, b in windows(len(paragraph.text), size)]
            continue
        if held and len(joined([*held, paragraph])) > size:
            close()
            held = held[-1:] if carry else []
            if held and len(joined([*held, paragraph])) > size:
                held = []
        held.append(paragraph)
    close()
    return out


def _sections(lines: list[tuple[_Line, bool]]) -> Iterator[tuple[tuple[str, ...], list[tuple[_Line, bool]]]]:
    """Lines from heading to heading, with the path of headings they stand under."""
    path: list[str] = []
    body: list[tuple[_Line, bool]] = []
    for line, outside in lines:
        heading = re.fullmatch(r"(#{1,6})\s+\S.*", line.text.strip()) if outside else None
        if heading:
            if body:
                yield tuple(path), body
            path, body = [*path[: len(heading[1]) - 1], heading[0]], []
        body.append((line, outside))
    if body:
        yield tuple(path), body


def _with_path(chunk: Chunk, path: tuple[str, ...]) -> Chunk:
    """The chunk under its headings, which are taken off its own head first."""
    if not path:
        return chunk
    rest = chunk.text.splitlines()
    for heading in path:
        if rest and rest[0].strip() == heading:
            rest = rest[1:]
            while rest and not rest[0].strip():
                rest = rest[1:]
    body = "\n".join(rest).strip()
    return replace(chunk, text="\n".join([*path, body] if body else path))


def chunk_text(text: str, suffix: str = "", size: int = MAX_CHARS) -> list[Chunk]:
    """Chunks of a text by the rules of its file suffix; blank ones are left out."""
    lines = _lines(text)
    if suffix.lower() in MARKDOWN:
        found = [
            _with_path(chunk, path) for path, body in _sections(list(_outside_fences(lines))) for chunk in _pack(_paragraphs(body), size, carry=False)
        ]
    else:
        found = _pack(_paragraphs([(line, True) for line in lines]), size, carry=True)
    feeds = [m.start() for m in re.finditer("\n", text)]
    number = lambda offset: bisect.bisect_left(feeds, offset) + 1
    return [replace(c, start_line=number(c.start), end_line=number(max(c.start, c.end - 1))) for c in found if c.text.strip()]


def _runner(keys: list[str], size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chunks = [], []
            for r, (text, suffix) in enumerate(zip(batch.column("_text").to_pylist(), batch.column("_suffix").to_pylist(), strict=True)):
                found = chunk_text(text or "", suffix or "", size)
                rows += [r] * len(found)
                chunks += enumerate(found)
            taken = pa.array(rows, pa.int64())
            numbers = [[k for k, _ in chunks], *([getattr(c, f) for _, c in chunks] for f in ("start", "end", "start_line", "end_line"))]
            columns = [batch.column(k).take(taken) for k in keys] + [pa.array(n, pa.int32()) for n in numbers]
            columns.append(pa.array([c.text for _, c in chunks], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*keys, "chunk_index", "start_offset", "end_offset", "start_line", "end_line", "text"])

    return run


def chunk_documents(docs: DataFrame, keys: list[str], text: Column, suffix: Column, size: int = MAX_CHARS) -> DataFrame:
    """Chunks of every document: the ``keys`` and the columns of a chunk. A null text has none."""
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, text.alias("_text"), suffix.alias("_suffix")).mapInArrow(_runner(keys, size), f"{schema}, {CHUNK_SCHEMA}")


def _window_runner(keys: list[str], size: int):
    stride = max(1, size - OVERLAP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chunks, held = [], [], 0
            for r, text in enumerate(batch.column("_text").to_pylist()):
                if not text or text.isspace():
                    continue
                feeds, multiline = 0, "\n" in text
                for k, (a, b) in enumerate(windows(len(text), size)):
                    feeds += text.count("\n", max(0, a - stride), a) if multiline else 0
                    more = text.count("\n", a, b - 1) if multiline else 0
                    rows.append(r)
                    chunks.append((k, a, b, feeds + 1, feeds + more + 1, text[a:b]))
                    held += b - a
                    if held > WINDOW_CHARS:
                        yield made(batch, rows, chunks)
                        rows, chunks, held = [], [], 0
            yield made(batch, rows, chunks)

    def made(batch: pa.RecordBatch, rows: list, chunks: list) -> pa.RecordBatch:
        taken = pa.array(rows, pa.int64())
        *numbers, texts = zip(*chunks, strict=True) if chunks else [[]] * 6
        columns = [batch.column(k).take(taken) for k in keys] + [pa.array(n, pa.int32()) for n in numbers] + [pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, [*keys, "chunk_index", "start_offset", "end_offset", "start_line", "end_line", "text"])

    return run


def window_chunks(docs: DataFrame, keys: list[str], size: int = MAX_CHARS) -> DataFrame:
    """Overlapping windows of each text as one paragraph, in time linear in the text: for texts without blank lines. A null or blank text has none."""
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return docs.select(*keys, F.col("text").alias("_text")).mapInArrow(_window_runner(keys, size), f"{schema}, {CHUNK_SCHEMA}")
