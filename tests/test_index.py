from __future__ import annotations

import io
import json
import os
import re
import threading
import urllib.request

import pytest

from lodestone.operators import embedding, fts
from lodestone.operators.embedding import HashingProvider
from lodestone.plans import lookup, queries
from lodestone.plans.index import Index, check_session_index, index_paths, index_sessions
from lodestone.plans.search import resolve, search_many
from lodestone.plans.service import Service, messages
from lodestone.sources import files, sessions, texts


def put(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, **({} if "b" in mode else {"encoding": "utf-8"})) as file:
        file.write(text)


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "docs")
    put(f"{root}/a.md", "# A\n\nalpha text")
    put(f"{root}/b.txt", "beta text")
    put(f"{root}/.dot.md", "dot file")
    put(f"{root}/_dir/x.md", "under")
    put(f"{root}/.hid/x.md", "hidden")
    put(f"{root}/c.log", "log")
    put(f"{root}/shelf/late.md", "late")
    put(f"{root}/bad.txt", b"\xff\xfe\xfa", "wb")
    return root


def test_scan_rules(tree):
    found, excluded = files.scan([tree], None, ["^shelf/", r"\.draft\.md$"])
    assert sorted(c.relative_path for c in found) == [".dot.md", "_dir/x.md", "a.md", "b.txt", "bad.txt"] and excluded == 1
    only, _ = files.scan([f"{tree}/a.md", tree], ["md"])
    assert [c.root_path for c in only if c.relative_path == "a.md"] == [os.path.realpath(tree)]
    with pytest.raises(re.error):
        files.scan([tree], None, ["["])


def test_incremental_index(spark, tree, tmp_path):
    path, provider = str(tmp_path / "index"), HashingProvider(dim=8)
    first = index_paths(spark, path, [tree], provider)
    assert (first.scanned, first.indexed, first.skipped, first.removed) == (6, 5, 1, 0) and first.chunks == 5
    reader = Index.open(spark, path)
    again = index_paths(spark, path, [tree], provider)
    assert (again.indexed, again.chunks) == (0, 0)
    put(f"{tree}/b.txt", "beta text, changed")
    os.remove(f"{tree}/shelf/late.md")
    third = index_paths(spark, path, [tree], provider)
    assert (third.indexed, third.removed, third.chunks) == (1, 1, 1)
    assert reader.chunks.where("text = 'late'").count() == 1
    assert reader.refresh() and not reader.refresh()
    assert sorted(r.text for r in reader.chunks.collect()) == ["# A\nalpha text", "beta text, changed", "dot file", "under"]
    assert all(len(r.embedding) == 8 for r in reader.vectors.collect())
    with pytest.raises(ValueError):
        index_paths(spark, path, [tree], HashingProvider(dim=4))
    rebuilt = index_paths(spark, path, [tree], HashingProvider(dim=4), rebuild=True)
    assert rebuilt.chunks == 4


def test_segments(spark, tmp_path):
    """Each run adds one segment; files that change or go are left out of older ones; merging and vacuuming keep what counts."""
    root, path, provider = str(tmp_path / "r"), str(tmp_path / "i"), HashingProvider(dim=4)
    told = []
    want = {}
    for turn in range(4):
        for k in range(turn, turn + 3):
            want[f"{k}.txt"] = f"file {k} of turn {turn} common words"
            put(f"{root}/{k}.txt", want[f"{k}.txt"])
        if turn == 2:
            os.remove(f"{root}/0.txt")
            del want["0.txt"]
        index_paths(spark, path, [root], provider, progress=lambda *what: told.append(what))
        index = Index.open(spark, path)
        assert index.segments == list(range(1, turn + 2))
        assert {r.relative_path for r in index.files.collect()} == set(want)
        rows = index.chunks.collect()
        assert sorted(r.text for r in rows) == sorted(want.values()) and len({r.chunk_id for r in rows}) == len(rows)
        assert all(r.chunk_id >> 24 == r.file_id for r in rows)
        by_text = lookup.topk(index.text, "common words", 50).collect()
        by_scan = fts.fts_topk(index.chunks.drop("embedding"), "common words", 50).collect()
        assert sorted((r.chunk_id, round(r.fts_rank, 12)) for r in by_text) == sorted((r.chunk_id, round(r.fts_rank, 12)) for r in by_scan) and len(by_text) == len(want)
    assert ("scanned", 3) in told and ("indexed", 3) in told
    marks = index.fingerprint()
    index.merge()
    assert index.segments == [5] and index.fingerprint() == dict(marks, version=5)
    index.vacuum()
    again = Index.open(spark, path)
    assert sorted(r.text for r in again.chunks.collect()) == sorted(want.values())
    assert sorted(os.listdir(path)) == ["manifest-5.json", "segment-5"] or {n for n in os.listdir(path) if not n.startswith(".")} == {"manifest-5.json", "segment-5"}


def test_chunks_are_not_moved_to_tombstones(spark, tmp_path, monkeypatch):
    """Few ids of files that are gone reach the chunks by broadcast, whatever Spark's own limit is; more by an exchange, with the same rows."""
    from lodestone.plans import index as module

    rows = [(k, f"text {k} of a file", "en", f"s{k % 2}", 20) for k in range(40)] + [(40, None, "en", "s0", 0), (41, " ", None, "s1", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((f"/s{k % 2}/{k:09}.txt", ("New " if k % 7 == 2 else "") + text) for k, text, *_ in rows[:40] if k % 5 != 1)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most in (module.MOST_GONE, 0):
            monkeypatch.setattr(module, "MOST_GONE", most)
            found = queries.index_segments(spark, str(tmp_path))
            assert ("SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()) == (most == 0)
            assert sorted((r.path, r.text) for r in found.collect()) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_an_older_version_is_scanned_until_it_is_merged(spark, tmp_path):
    """A run that adds to segments whose postings are of an older version does not read these as new ones."""
    root, path, provider = str(tmp_path / "r"), str(tmp_path / "i"), HashingProvider(dim=4)
    put(f"{root}/a.txt", "first words")
    index_paths(spark, path, [root], provider)
    manifest = json.load(open(f"{path}/manifest-1.json"))
    manifest["metadata"]["schema_version"] = "2"
    put(f"{path}/manifest-1.json", json.dumps(manifest))
    os.remove(f"{path}/.manifest-1.json.crc")
    put(f"{root}/b.txt", "second words")
    index_paths(spark, path, [root], provider)
    index = Index.open(spark, path)
    assert index.segments == [1, 2] and index.text is None
    index.merge()
    assert lookup.topk(Index.open(spark, path).text, "words", 5).count() == 2


def test_two_writers_cannot_publish_one_version(spark, tmp_path):
    from lodestone.plans.store import Store

    store = Store(spark, str(tmp_path))
    store.publish("manifest-1.json", "é")
    assert store.read("manifest-1.json") == "é"
    with pytest.raises(FileExistsError):
        store.publish("manifest-1.json", "b")
    assert store.read("manifest-1.json") == "é"


def test_by_stat_reads_no_unchanged_file(spark, tmp_path):
    root, path, provider = str(tmp_path / "r"), str(tmp_path / "i"), HashingProvider(dim=4)
    put(f"{root}/a.txt", "one")
    index_paths(spark, path, [root], provider)
    stamp = os.stat(f"{root}/a.txt")
    put(f"{root}/a.txt", "two")
    os.utime(f"{root}/a.txt", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    assert index_paths(spark, path, [root], provider, by_stat=True).indexed == 0
    assert index_paths(spark, path, [root], provider).indexed == 1
    os.utime(f"{root}/a.txt", ns=(1, 1))
    assert index_paths(spark, path, [root], provider, by_stat=True).indexed == 1


def test_rebuilding_offline_and_in_batches(spark, tmp_path):
    root, path, provider = str(tmp_path / "r"), str(tmp_path / "i"), HashingProvider(dim=4)
    for k in range(5):
        put(f"{root}/{k}.txt", f"text {k}")
    index_paths(spark, path, [root], provider, batch_files=2)
    assert Index.open(spark, path).segments == [1, 2, 3]
    seen = []
    index_paths(spark, path, [root], provider, offline=True, batch_files=3, progress=lambda step, n: seen.append((step, n, Index.open(spark, path).files.count())))
    assert seen == [("scanned", 5, 5), ("indexed", 3, 3), ("indexed", 5, 5)]
    with pytest.raises(ValueError):
        index_paths(spark, path, [root], provider, rebuild=True, offline=True)
    os.remove(f"{root}/0.txt")
    assert index_paths(spark, path, [root], HashingProvider(dim=8), rebuild=True).indexed == 4
    assert len(Index.open(spark, path).segments) == 1


def test_older_tables_are_read_with_defaults(spark, tmp_path):
    """Files without paths below a root, chunks without lines and sessions, and no postings: search works all the same."""
    path = str(tmp_path / "old")
    spark.createDataFrame([("/x/a.txt", 3, 5, "h", 0)], "path string, size long, mtime_ns long, content_hash string, file_id long").write.parquet(f"{path}/segment-1/files")
    spark.createDataFrame([("/x/a.txt", 0, 0, 9, "old words", [1.0, 0.0], 0, 0)], "path string, chunk_index int, start_offset int, end_offset int, text string, embedding array<float>, chunk_id long, file_id long").write.parquet(f"{path}/segment-1/chunks")
    put(f"{path}/manifest-1.json", json.dumps({"version": 1, "metadata": {"schema_version": "1"}, "segments": [1], "next_file": 1}))
    index = Index.open(spark, path)
    file, chunk = index.files.first(), index.chunks.first()
    assert (file.root_path, file.relative_path) == ("", "/x/a.txt") and (chunk.start_line, chunk.end_line, chunk.session_id) == (1, 1, None)
    assert index.text is None
    found = search_many({path: (index.chunks.drop("embedding"), index.vectors, index.text)}, resolve(pattern="words")).collect()
    assert [r.text for r in found] == ["old words"]


def test_retries_and_devices(monkeypatch):
    calls = []

    def load(name, device):
        def run(texts):
            calls.append(texts)
            return [[float("nan") if len(calls) < 3 else 3.0, 4.0] for _ in texts]

        return {"passage": run, "query": run}

    model = embedding.CustomModelProvider("pfnet/plamo-embedding-1b", 2, load, device="cpu", attempts=4)
    with pytest.warns(RuntimeWarning, match="attempt 2 of 4"):
        assert [[round(x, 6) for x in v] for v in model.embed(["t"])] == [[0.6, 0.8]] and len(calls) == 3
    embedding._loaded.cache_clear()
    never = embedding.CustomModelProvider("m", 1, lambda n, d: {"passage": lambda texts: [[float("inf")]] * len(texts)}, device="cpu", attempts=2)
    with pytest.warns(RuntimeWarning), pytest.raises(embedding.NonFinite):
        never.embed(["t"])
    embedding._loaded.cache_clear()
    broken = embedding.CustomModelProvider("b", 1, lambda n, d: {"passage": lambda texts: 1 / 0}, device="cpu")
    with pytest.raises(ZeroDivisionError):
        broken.embed(["t"])
    for there, wanted, got in ((True, "auto", "mps"), (True, "cpu", "cpu"), (True, "mps", "mps"), (False, "auto", "cpu")):
        monkeypatch.setattr(embedding, "has_mps", lambda there=there: there)
        assert embedding.resolve_device(wanted) == got
    for wrong in ("mps", "cuda"):
        with pytest.raises(ValueError):
            embedding.resolve_device(wrong)
    assert embedding.load_arguments("sbintuitions/sarashina-embedding-v2-1b", "cpu")["model_kwargs"] == {"torch_dtype": "bfloat16"}
    assert "model_kwargs" not in embedding.load_arguments("sbintuitions/sarashina-embedding-v2-1b", "mps")
    assert embedding.load_arguments("pfnet/plamo-embedding-1b", "cpu")["trust_remote_code"] and embedding.load_arguments("x", "cpu") == {"device": "cpu"}
    assert embedding.SentenceTransformerProvider("BAAI/bge-m3", device="cpu").config.dim == 1024


def test_texts_to_time(tmp_path):
    path = str(tmp_path / "t.txt")
    for text, want in (("apple\n\n  pear \n\n\n\nquince", ["apple", "pear", "quince"]), ("apple\n pear\n", ["apple", "pear"]), ("one\n\n", ["one"])):
        put(path, text)
        assert texts.timing_texts(path, 5) == (want * 5)[:5]
    assert len(texts.timing_texts(None, 7)) == 7
    put(path, " \n")
    for wrong in ((path, 3), (None, 0)):
        with pytest.raises(ValueError):
            texts.timing_texts(*wrong)


def test_service(spark, tree, tmp_path):
    path, provider = str(tmp_path / "s"), HashingProvider(dim=8)
    index_paths(spark, path, [tree], provider)
    service = Service(spark, [path], provider)
    assert service.handle("GET", "/health", b"")[1]["db_paths"] == [path] and service.handle("GET", "/x", b"")[0] == 404
    status, found = service.handle("POST", "/search", json.dumps({"pattern": "beta", "explain": True}).encode())
    assert status == 200 and [r["text"] for r in found["results"]] == ["beta text"] and {"fts_rank", "vec_distance"} <= found["results"][0].keys() and "session_id" not in found["results"][0]
    status, found = service.handle("POST", "/search", json.dumps({"query": "alpha", "mode": "fts", "limit": 1}).encode())
    assert status == 200 and len(found["results"]) == 1 and "fts_rank" not in found["results"][0]
    put(f"{tree}/b.txt", "beta, later")
    index_paths(spark, path, [tree], provider)
    assert service.handle("POST", "/search", b'{"query": "beta"}')[1]["results"][0]["text"] == "beta, later"
    for wrong in (b"{}", b"[", b'{"query": "x", "db_paths": ["/other"]}', b'{"query": "x", "mode": "no"}'):
        assert service.handle("POST", "/search", wrong)[0] == 400
    asked = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "tools/call", "params": {"name": "roots"}},
        {"id": 4, "method": "tools/call", "params": {"name": "codex_session_search", "arguments": {"pattern": "beta"}}}, {"id": 5, "method": "none"}, {"id": 6, "method": "tools/call", "params": {"name": "none"}},
        {"id": 7, "method": "tools/call", "params": {"name": "search", "arguments": {"pattern": "beta"}}},
    ]
    for framed in (False, True):
        lines = [json.dumps(a).encode() for a in asked]
        sink = io.BytesIO()
        service.serve(io.BytesIO(b"".join(b"Content-Length: %d\r\n\r\n%s" % (len(x), x) if framed else x + b"\n" for x in lines)), sink)
        sink.seek(0)
        answers = {m["id"]: m for m, kind in messages(sink) if kind == framed}
        assert sorted(answers) == [1, 2, 3, 4, 5, 6, 7] and len(answers[2]["result"]["tools"]) == 3
        assert json.loads(answers[3]["result"]["content"][0]["text"])[0]["root_path"] == os.path.realpath(tree)
        assert answers[4]["error"]["code"] == -32000 and answers[5]["error"]["code"] == answers[6]["error"]["code"] == -32601
        assert "beta, later" in answers[7]["result"]["content"][0]["text"]


def test_http(spark, tree, tmp_path):
    path = str(tmp_path / "h")
    index_paths(spark, path, [tree], HashingProvider(dim=8))
    server = Service(spark, [path]).http("127.0.0.1", 0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        address = f"http://127.0.0.1:{server.server_address[1]}"
        assert json.load(urllib.request.urlopen(f"{address}/health"))["status"] == "ok"
        found = json.load(urllib.request.urlopen(f"{address}/search", json.dumps({"query": "beta", "mode": "fts"}).encode()))
        assert [r["text"] for r in found["results"]] == ["beta text"]
    finally:
        server.shutdown()


def test_opening_nothing_is_an_error(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        Index.open(spark, str(tmp_path / "none"))


def event(kind, payload):
    return json.dumps({"timestamp": "t", "type": kind, "payload": payload})


def message(role, text, **more):
    return event("response_item", {"type": "message", "role": role, "content": [{"type": "text", "text": text}], **more})


def test_session_turns(spark, tmp_path):
    root = str(tmp_path / "s")
    long = "word " * 160
    put(f"{root}/a.jsonl", "\n".join([
        event("session_meta", {"id": "s1", "cwd": "/w", "source": "cli"}), event("event_msg", {"type": "task_started", "turn_id": "t1"}),
        message("user", "# AGENTS.md instructions for x"), message("user", " hello "), message("assistant", "thinking", phase="commentary"),
        message("assistant", long, phase="final_answer"), "not json", message("system", "no"),
        event("session_meta", {"id": None, "cwd": "/w"}), message("user", "without a session"),
    ]))
    put(f"{root}/b.jsonl", "\n".join([message("user", "too early"), event("session_meta", {"id": "s2", "cwd": "/", "source": {"subagent": "x"}}), message("user", "no")]))
    lines = sessions.read_lines(spark, sessions.session_files([root]))
    found = sessions.turns(lines).orderBy("line_no").collect()
    assert [(r.session_id, r.role, r.text, r.turn_id, r.line_no) for r in found] == [("s1", "user", "hello", "t1", 4), ("s1", "assistant", long.strip(), "t1", 6)]
    chunks = sessions.turn_chunks(sessions.turns(lines)).orderBy("chunk_index").collect()
    assert [(r.start_offset, r.end_offset, r.line_no) for r in chunks] == [(0, 5, 4), (0, 600, 6), (480, 799, 6)]
    path = str(tmp_path / "i")
    stats = index_sessions(spark, path, [root], HashingProvider(dim=4))
    assert (stats.scanned, stats.indexed, stats.skipped, stats.chunks) == (2, 1, 1, 3)
    index = Index.open(spark, path)
    check_session_index(index.metadata)
    assert index.files.first().root_path == os.path.realpath(root)
    again = index_sessions(spark, path, [root], HashingProvider(dim=4))
    assert (again.indexed, again.skipped, again.chunks) == (0, 2, 0) and again.scanned == 2
    put(f"{root}/a.jsonl", message("user", "no session any more"))
    assert index_sessions(spark, path, [root], HashingProvider(dim=4)).indexed == 0 and Index.open(spark, path).chunks.count() == 0
    for metadata in ({}, {"index_kind": "files"}):
        with pytest.raises(ValueError):
            check_session_index(metadata)


def test_sources_and_white_space_of_sessions(spark):
    """Only an object with the key is a subagent's; white space is Unicode's."""
    rows = []
    for k, source in enumerate(["cli", {"subagent": None}, {"subagent": "x"}, {"kind": "subagent"}, "subagent", None, ["subagent"]]):
        rows += [(f"/{k}", 1, event("session_meta", {"id": f"s{k}", "source": source})), (f"/{k}", 2, message("user", "\u3000 hi\u00a0\n"))]
    found = sessions.turns(spark.createDataFrame(rows, "path string, line_no int, line string")).collect()
    assert sorted((r.session_id, r.text) for r in found) == [(f"s{k}", "hi") for k in (0, 3, 4, 5, 6)]


def test_session_roots(tmp_path):
    put(str(tmp_path / "x.txt"), "")
    for roots in ([], [str(tmp_path / "none")], [str(tmp_path / "x.txt")]):
        with pytest.raises(ValueError):
            sessions.session_files(roots)


def test_command_line(spark, tree, tmp_path, capsys):
    from lodestone import cli

    path = str(tmp_path / "cli")
    assert cli.main(["index", "--index", path, "--root", tree, "--exclude", "^shelf/", "--dim", "8"], spark) == 0
    assert json.loads(capsys.readouterr().out)["excluded"] == 1
    cli.main(["search", "--index", path, "--pattern", "beta", "--json"], spark)
    found = json.loads(capsys.readouterr().out)
    assert [r["snippet"] for r in found] == ["beta text"] and found[0]["source"] == "fts"
    cli.main(["search", "--index", path, "--query", "alpha", "--dim", "8", "--limit", "2"], spark)
    assert len(capsys.readouterr().out.strip().splitlines()) == 2
    cli.main(["info", "--index", path], spark)
    assert json.loads(capsys.readouterr().out)["files"] == 4
    cli.main(["files", "--index", path], spark)
    assert "a.md" in capsys.readouterr().out
