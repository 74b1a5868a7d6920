"""Search as a service: requests and answers as dictionaries, over HTTP or as JSON-RPC tools on standard input."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import BinaryIO

from pyspark.sql import SparkSession

from lodestone.operators import catalog
from lodestone.operators.embedding import Embedder
from lodestone.plans.index import Index, check_session_index
from lodestone.plans.search import CANDIDATES, LIMIT, resolve, search_many

#: Fields of an answer's row, those of session logs only, and those that explain a score.
FIELDS = ("score", "db_path", "path", "relative_path", "start_line", "end_line", "chunk_index", "start_offset", "end_offset", "source", "text")
SESSION_FIELDS = ("session_id", "cwd", "role", "turn_id", "timestamp", "session_path", "line_no")
SCORE_FIELDS = ("fts_rank", "vec_distance")
#: JSON-RPC's codes for a method that is not there and for an error of the server's.
NO_METHOD, SERVER_ERROR = -32601, -32000


def project(row: dict, explain: bool) -> dict:
    """Fields of a row that an answer shows: a session's only where there is one, parts of the score only if asked for."""
    names = FIELDS + (SESSION_FIELDS if row.get("session_id") is not None else ()) + (SCORE_FIELDS if explain else ())
    return {name: row.get(name) for name in names}


@dataclass
class Service:
    """A fixed set of indexes and one model for all requests; each request sees their current versions."""

    spark: SparkSession
    paths: list[str]
    model: Embedder | None = None
    _open: dict[str, Index] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.paths = catalog.normalized_paths(self.paths)

    def health(self) -> dict:
        return {"status": "ok", "db_paths": self.paths, "set": catalog.set_hash(self.paths), "model": self.model.config.model if self.model else None}

    def _indexes(self, wanted: list[str] | None) -> dict[str, Index]:
        chosen = catalog.normalized_paths(wanted) if wanted else self.paths
        if strange := [p for p in chosen if p not in self.paths]:
            raise ValueError(f"not served: {strange}")
        for path in chosen:
            if path in self._open:
                self._open[path].refresh()
            else:
                self._open[path] = Index.open(self.spark, path)
        return {path: self._open[path] for path in chosen}

    def search(self, request: dict, sessions_only: bool = False, mode: str | None = "fts-vec") -> list[dict]:
        """Rows for a request of query, pattern, mode, limit, candidates, db_paths and explain."""
        query, pattern = request.get("query"), request.get("pattern")
        asked = resolve(query, pattern, request.get("mode") or (mode if query else None))
        indexes = self._indexes(request.get("db_paths"))
        if sessions_only:
            for index in indexes.values():
                check_session_index(index.metadata)
        limit = int(request.get("limit") or LIMIT)
        candidates = max(int(request.get("candidates") or CANDIDATES), limit)
        vector = None
        if asked.mode != "fts":
            catalog.check_compatible([i.metadata for i in indexes.values()])
            if self.model is None:
                raise ValueError(f"mode {asked.mode} needs a model")
            vector = self.model.embed([asked.vector_query], "query")[0]
        found = search_many({p: (i.chunks.drop("embedding"), i.vectors, i.text) for p, i in indexes.items()}, asked, vector, limit, candidates)
        return [project(r.asDict(), bool(request.get("explain"))) for r in found.collect()]

    def roots(self, request: dict) -> list[dict]:
        """Roots of every index with their files and chunks."""
        return [dict(r.asDict(), db_path=p) for p, i in self._indexes(request.get("db_paths")).items() for r in catalog.roots_summary(i.files, i.chunks).collect()]

    # -- HTTP ------------------------------------------------------------------

    def handle(self, method: str, path: str, body: bytes) -> tuple[int, dict]:
        """Status and answer of GET /health and POST /search; whatever is wrong with a request is its own fault (400)."""
        if (method, path) == ("GET", "/health"):
            return 200, self.health()
        if (method, path) != ("POST", "/search"):
            return 404, {"error": f"no {method} {path}"}
        try:
            return 200, {"results": self.search(json.loads(body or b"{}"))}
        except Exception as error:
            return 400, {"error": str(error)}

    def http(self, host: str, port: int) -> ThreadingHTTPServer:
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self) -> None:
                status, found = service.handle(self.command, self.path, self.rfile.read(int(self.headers.get("Content-Length") or 0)))
                data = json.dumps(found, ensure_ascii=False).encode()
                self.send_response(status)
                self.send_header("Content-Type", "application/json; charset=utf-8")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = _answer

            def log_message(self, *_: object) -> None:
                pass

        return ThreadingHTTPServer((host, port), Handler)

    # -- JSON-RPC tools ----------------------------------------------------------

    def tools(self) -> dict[str, Callable[[dict], list[dict]]]:
        return {
            "search": self.search,
            "codex_session_search": lambda request: self.search(request, sessions_only=True),
            "roots": self.roots,
        }

    def call(self, message: dict) -> dict | None:
        """The answer to a message; a notification has none."""
        if "id" not in message:
            return None
        answer = {"jsonrpc": "2.0", "id": message["id"]}
        method, params = message.get("method"), message.get("params") or {}
        try:
            if method == "initialize":
                return answer | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "0"}}}
            if method == "ping":
                return answer | {"result": {}}
            if method == "tools/list":
                return answer | {"result": {"tools": [{"name": n, "description": _ABOUT[n], "inputSchema": _SCHEMA[n]} for n in self.tools()]}}
            if method == "tools/call" and params.get("name") in self.tools():
                found = self.tools()[params["name"]](params.get("arguments") or {})
                return answer | {"result": {"content": [{"type": "text", "text": catalog.as_json(found)}]}}
        except Exception as error:
            return answer | {"error": {"code": SERVER_ERROR, "message": str(error)}}
        return answer | {"error": {"code": NO_METHOD, "message": f"no method {params.get('name') if method == 'tools/call' else method}"}}

    def serve(self, source: BinaryIO, sink: BinaryIO) -> None:
        """Answer messages until the source ends, each in the framing it came in."""
        for message, framed in messages(source):
            if (found := self.call(message)) is not None:
                data = json.dumps(found, ensure_ascii=False, separators=(",", ":")).encode()
                sink.write(b"Content-Length: %d\r\n\r\n%s" % (len(data), data) if framed else data + b"\n")
                sink.flush()


def messages(source: BinaryIO) -> Iterator[tuple[dict, bool]]:
    """Messages of a stream, one a line or behind a Content-Length header, and whether they had one."""
    while line := source.readline():
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"content-length":
            while source.readline().strip():
                pass
            yield json.loads(source.read(int(value))), True
        elif line.strip():
            yield json.loads(line), False


_ASK = {
    "query": {"type": "string"}, "pattern": {"type": "string"}, "mode": {"type": "string", "enum": ["fts", "vec", "fts-vec", "vec-fts"]},
    "limit": {"type": "integer"}, "candidates": {"type": "integer"}, "explain": {"type": "boolean"}, "db_paths": {"type": "array", "items": {"type": "string"}},
}
_SCHEMA = {
    "search": {"type": "object", "properties": _ASK},
    "codex_session_search": {"type": "object", "properties": _ASK},
    "roots": {"type": "object", "properties": {"db_paths": _ASK["db_paths"]}},
}
_ABOUT = {
    "search": "Chunks of documents by meaning, by words, or by both.",
    "codex_session_search": "The same over indexes of session logs.",
    "roots": "Indexed folders with their files and chunks.",
}
