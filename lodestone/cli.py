"""Command line over the engine: index, search, info, files, benchmark and services, for files and session logs."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import snippet
from lodestone.operators import catalog
from lodestone.operators.embedding import Embedder, HashingProvider, SentenceTransformerProvider
from lodestone.plans.index import Index, check_session_index, index_paths, index_sessions
from lodestone.plans.search import CANDIDATES, LIMIT, MODES, resolve, search_many
from lodestone.plans.service import Service
from lodestone.sources.texts import timing_texts


def provider_of(model: str, dim: int | None, device: str) -> Embedder:
    return HashingProvider(dim=dim or 64) if model == "hashing" else SentenceTransformerProvider(model, dim, device)


def search_indexes(
    spark: SparkSession, paths: list[str], query: str | None, pattern: str | None, mode: str | None, limit: int, candidates: int, provider: Embedder | None, sessions_only: bool = False
) -> list[dict]:
    """Top rows of all indexes as dictionaries; the query is embedded once."""
    asked = resolve(query, pattern, mode)
    indexes = {path: Index.open(spark, path) for path in catalog.normalized_paths(paths)}
    if sessions_only:
        for index in indexes.values():
            check_session_index(index.metadata)
    vector = None
    if asked.mode != "fts":
        catalog.check_compatible([i.metadata for i in indexes.values()])
        vector = provider.embed([asked.vector_query], "query")[0]
    found = search_many({p: (i.chunks.drop("embedding"), i.vectors, i.text) for p, i in indexes.items()}, asked, vector, limit, candidates)
    return [r.asDict() for r in found.drop("place").withColumn("snippet", snippet(F.col("text"))).collect()]


def line_of(row: dict, many: bool, explain: bool) -> str:
    """A row of an answer on one line, with its index if there are several, its session if it has one, and its score's parts if asked for."""
    parts = [f"{row['score']:.4f}", f"{row['path']}:{row['start_line']}-{row['end_line']}"]
    parts += [row["db_path"]] if many else []
    parts += [f"{row['role']} {row['timestamp']} {row['session_id']}:{row['line_no']}"] if row.get("session_id") is not None else []
    parts += [f"fts_rank={row['fts_rank']} vec_distance={row['vec_distance']} source={row['source']}"] if explain else []
    return "  ".join([*parts, row["snippet"]])


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestone")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, many: bool = False) -> argparse.ArgumentParser:
        found = commands.add_parser(name)
        found.add_argument("--index", required=True, action="append" if many else "store")
        found.add_argument("--json", action="store_true")
        found.add_argument("--model", default="hashing")
        found.add_argument("--dim", type=int)
        found.add_argument("--device", default="cpu", choices=("auto", "cpu", "mps"))
        return found

    for name in ("index", "index-sessions"):
        found = command(name)
        found.add_argument("--root", required=True, action="append")
        found.add_argument("--rebuild", action="store_true")
        found.add_argument("--rebuild-offline", action="store_true")
        if name == "index":
            found.add_argument("--ext", action="append")
            found.add_argument("--exclude", action="append")
    for name in ("search", "search-sessions"):
        found = command(name, many=True)
        found.add_argument("--query")
        found.add_argument("--pattern")
        found.add_argument("--mode", choices=MODES)
        found.add_argument("--limit", type=int, default=LIMIT)
        found.add_argument("--candidates", type=int, default=CANDIDATES)
        found.add_argument("--explain", action="store_true")
    found = command("server", many=True)
    found.add_argument("--host", default="127.0.0.1")
    found.add_argument("--port", type=int, default=8765)
    command("mcp", many=True)
    for name in ("info", "files"):
        command(name)
    found = command("benchmark")
    found.add_argument("--repeat", type=int, default=3)
    found.add_argument("--documents", type=int, default=32)
    found.add_argument("--input")
    return parser


def _tell(step: str, number: int) -> None:
    print(f"{step}: {number}", file=sys.stderr)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = _parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    provider = provider_of(args.model, args.dim, args.device)
    if args.command == "index":
        out = vars(index_paths(spark, args.index, args.root, provider, args.ext, args.exclude, args.rebuild, args.rebuild_offline, progress=_tell))
    elif args.command == "index-sessions":
        out = vars(index_sessions(spark, args.index, args.root, provider, args.rebuild, args.rebuild_offline, _tell))
    elif args.command in ("search", "search-sessions"):
        out = search_indexes(spark, args.index, args.query, args.pattern, args.mode, args.limit, args.candidates, provider, args.command == "search-sessions")
    elif args.command == "server":
        Service(spark, args.index, provider).http(args.host, args.port).serve_forever()
    elif args.command == "mcp":
        Service(spark, args.index, provider).serve(sys.stdin.buffer, sys.stdout.buffer)
        return 0
    elif args.command == "info":
        index = Index.open(spark, args.index)
        out = dict(index.metadata, **catalog.index_info(index.files, index.chunks).first().asDict())
        out["roots"] = [r.asDict() for r in catalog.roots_summary(index.files, index.chunks).collect()]
    elif args.command == "files":
        out = [r.asDict() for r in catalog.files_list(Index.open(spark, args.index).files).collect()]
    else:
        texts = timing_texts(args.input, args.documents)
        runs = []
        for _ in range(args.repeat):
            began = time.perf_counter()
            provider.embed(texts)
            runs.append((provider.config.model, time.perf_counter() - began, float(len(texts)), float(sum(map(len, texts)))))
        timings = spark.createDataFrame(runs, "name string, seconds double, vectors double, chars double")
        out = catalog.summarize_timings(timings).first().asDict()
    if args.json or not isinstance(out, list):
        print(catalog.as_json(out))
    else:
        for row in out:
            print(line_of(row, len(set(args.index)) > 1, args.explain) if "snippet" in row else row["path"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
