"""Mixing, sharding, packing, secrets, fixity, neighbours and language identification."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, language_id, merkle, mixing, packing, secrets, sharding
from lodestone.llm._shared import materialize, running_sum
from lodestone.llm.queries import vocabulary
from lodestone.llm.wordbpe import encoder

WORD = "[^\x20\x09-\x0d]+"


def test_mixing(docs, none):
    rows = docs.select("doc_id", "text", "source").collect()
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(7)).collect()
    key = lambda r: (repr(r.doc_id), r.size, r.copies)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(r.doc_id), len(re.findall(WORD, r.text or ""))) for r in rows)
    taken, sizes, goal = defaultdict(int), defaultdict(int), {}
    for r in got:
        taken[r.source] += r.taken
        sizes[r.source] += r.size
        goal[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    assert goal == mixing.targets(dict(sizes), (5, 2, 1), 1.5, 2.0)
    for s in goal:
        own = [r.size for r in got if r.source == s and r.size]
        # where one document is most of a source, whole copies can be half of it off
        slack = max(own) / 2 if max(own) > goal[s] / 4 else max(min(own), 0.02 * goal[s])
        assert abs(taken[s] - goal[s]) <= slack
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).count() == 0
    copies = mixing.mixed(docs)
    assert copies.columns == [c for c in docs.columns if c != "_k1"]
    assert copies.count() == sum(r.copies for r in got)


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}, (5, 2, 1), 1.5, 2.0) == {"a": 200.0, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)}
    assert mixing.targets({"a": 10, "b": 0}, (5, 2, 1), 3.0, 2.0) == {"a": 20.0, "b": 0.0}
    assert mixing.targets({}, (1,), 1.0, 2.0) == {}


def test_sharding(docs, none):
    shards = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(shards, 251)
    counts = Counter(table.tolist())
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 251)
    stayed = [a == b for a, b in zip(table, fewer, strict=True) if a < 6]
    assert sum(stayed) / len(stayed) > 0.7
    got = sharding.place(docs, shards, size=251).collect()
    assert len(got) == docs.count() and all(r.shard == table[r.slot] and r.shard_name == shards[r.shard] for r in got)
    assert len({r.shard for r in got if r.doc_id is None}) == 1
    assert sharding.place(none, shards).count() == 0
    for wrong in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*wrong)


def test_table_is_filled_by_turns():
    shards, size = ["x", "y", "z"], 13
    prefer = {}
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        at, skip = int.from_bytes(digest[:8], "big") % size, int.from_bytes(digest[8:16], "big") % (size - 1) + 1
        prefer[name] = [(at + k * skip) % size for k in range(size)]
        assert sorted(prefer[name]) == list(range(size))
    table = {}
    for turn in range(size):
        name = shards[turn % 3]
        table[next(s for s in prefer[name] if s not in table)] = turn % 3
    assert [table[s] for s in range(size)] == sharding.lookup_table(shards, size).tolist()


def test_written_shards(docs, spark, tmp_path):
    placed = sharding.place(docs.select("doc_id", "text"), ["a", "b", "c"], size=31)
    sharding.write_shards(placed, str(tmp_path / "out"), files_per_shard=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((repr(r.doc_id), r.shard) for r in back.collect()) == sorted((repr(r.doc_id), r.shard) for r in placed.collect())


@pytest.fixture(scope="module")
def bpe():
    return encoder(vocabulary())


def test_encoder_equals_the_library(bpe):
    rng = random.Random(1)
    letters = list("abcdefsS'tTmMdDrReEvVlL'' \n\t.,!?-0123éÉßŒœÿŸŁł€—’“") + ["'ll", "日", "\x1e", "\xa0", "İ", "Σ"]
    texts = ["", None, "it's DON'T 'story x's's", "<|endoftext|> x", "a" * 500, "İstanbul Σας", "😀"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    ids, counts = bpe.encode(pa.array(texts))
    got = np.split(ids, np.cumsum(counts)[:-1])
    want = [e.ids for e in bpe.library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert [g.tolist() for g in got] == want


@pytest.mark.parametrize("window", [64, 4096])
def test_packing(docs, none, bpe, window):
    pieces = packing.pack(docs, vocabulary(), window, 2).collect()
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r.doc_id].append([*bpe.library.encode(r.text or "", add_special_tokens=False).ids, 2])
    sequences = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes())
        assert any(p.doc_tokens == len(t) and t[p.start : p.start + p.length] == p.ids for t in texts[p.doc_id])
        sequences[p.sequence_id].append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for number, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or number == len(sequences) - 1
    assert sum(p.length for p in pieces) == sum(len(t) for ts in texts.values() for t in ts)
    starts = Counter((p.doc_id, p.start) for p in pieces)
    assert all(starts[(d, 0)] == len(ts) for d, ts in texts.items())
    assert packing.pack(none, vocabulary()).count() == 0


def test_secrets(spark, docs, none):
    key, blob = "AKIA" + "Q" * 16, "Ab1" + "xY9" * 12
    texts = [
        'Password = "hunter22" and token:abc', f"{key} ok {'0af9' * 8}", "secret=token: abcdefgh", f"user=alice {blob}", f"{blob} alone here", f"see https://h.example/x {blob}",
        f"user=alice {'. ' * 400}{blob}", f"😀 api-key=zzzzzzzz apikey: yyyyyyyy É {key}", "", None, f"{key} {blob}", f"user=bob and password=topsecret1 {blob}",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.scan(rows).collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for k, text in enumerate(texts):
        spans = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(text or "") if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text or "") if len(m[0]) >= 24]
        written = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in sorted(spans))
        assert got[k].base_sha256 == hashlib.sha256(written.encode()).hexdigest(), k
        assert (got[k].n_assign, got[k].n_access, got[k].n_hex) == tuple(sum(s[1] == kind for s in spans) for kind in range(3))
        assert set(written.split(",")) - {""} <= set(got[k].spans.split(","))
    assert got[3].spans == f"linked_id:0:10,linked_secret:11:{11 + len(blob)}"
    assert got[4].spans == "" and got[6].spans == ""
    assert "linked_endpoint" in got[5].spans and "linked_secret" in got[5].spans
    assert "linked_secret" in got[10].spans and "linked_id" in got[11].spans
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(none).count() == 0


def test_long_parts_are_linked_at_every_alignment(spark):
    """Against linking by distance alone: a long part and its complement after or before it, about the scope apart."""
    scope, rows = 64, []
    for size in (40, 100, 347, 2000):
        blob = ("Ab1xY9" * size)[:size]
        url = "https://h.example/" + "p/" * (size // 2)
        for pad in range(scope):
            for gap in (1, scope // 2, scope - 1, scope, scope + 1):
                dots = ". " * (pad // 2) + "." * (pad % 2) + " "
                space = " " * gap
                texts = (f"{dots}{blob}{space}user=alice1", f"{dots}user=alice1{space}{blob}", f"{dots}{url}{space}{blob[:40]}", f"{dots}{blob}{space}AKIA{'Q' * 16}")
                rows += [(len(rows) + k, text, gap <= scope) for k, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near boolean")
    got = {r.doc_id: r for r in secrets.scan(docs.select("doc_id", "text"), scope=scope).collect()}
    for k, text, near in rows:
        weak = 1 if "AKIA" in text else 2
        assert got[k].n_linked == (weak if near else 0), (text[:80], len(text), got[k].spans)
        assert got[k].spans.count("linked") == got[k].n_linked


def test_fixity(spark):
    rows = [(k, f"http://h/{k}", None if k == 5 else f"<p>{k}</p>" * (k % 900)) for k in range(400)] + [(7, "http://h/7", "again"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("level", F.lit("clash"))
    whole = merkle.manifest(pages, archive_bytes=200_000)
    assert {r.state for r in merkle.audit(whole, whole).collect()} == {"intact"}
    rotten = pages.withColumn("html", F.when(F.col("page_id").isin(9, 200), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
    replica = merkle.manifest(rotten, archive_bytes=200_000).where("NOT page_id <=> 33")
    got = merkle.audit(whole, replica).collect()
    assert Counter(r.state for r in got) == {"intact": len(rows) - 3, "corrupt": 2, "missing": 1}
    assert {r.page_id for r in got if r.state == "corrupt"} == {9, 200} and {r.page_id for r in got if r.state == "missing"} == {33}
    assert any(r.replica_sha256 is None and r.state == "intact" for r in got)
    assert Counter(r.state for r in merkle.audit(replica, whole).collect())["extra"] == 1
    for r in whole.collect():
        assert r.length > 0
    places = sorted((r.archive, r.offset, r.length) for r in whole.collect())
    assert all(b[1] == a[1] + a[2] if a[0] == b[0] else b[1] == 0 for a, b in zip(places, places[1:], strict=False))
    empty = merkle.manifest(pages.limit(0))
    assert merkle.audit(empty, empty).count() == 0
    assert {r.state for r in merkle.audit(whole, empty).collect()} == {"missing"}


def test_records_behind_one_of_another_length_have_moved(spark):
    rows = [(k, f"http://h/{k}", f"<p>{k}</p>" * (1 + k % 90)) for k in range(600)] + [(None, "http://h/n", "<p>copy</p>" * 400)] * 50
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    longer = pages.withColumn("html", F.when(F.col("page_id").isin(10, 200), F.concat("html", F.lit("more"))).otherwise(F.col("html")))
    whole = merkle.manifest(pages, archive_bytes=1 << 30)
    replica = merkle.manifest(longer.where("NOT page_id <=> 300"), archive_bytes=1 << 30)
    got = merkle.audit(whole, replica).collect()
    states = {k: {r.page_id for r in got if r.state == k} for k in ("corrupt", "missing", "extra")}
    assert states == {"corrupt": {10, 200}, "missing": {300}, "extra": set()}
    mine, theirs = ({r.page_id: (r.offset, r.sha256) for r in m.collect()} for m in (whole, replica))
    assert {r.page_id for r in got if r.state == "moved"} == {k for k in range(600) if k != 300 and mine[k][0] != theirs[k][0] and mine[k][1] == theirs[k][1]}
    assert Counter(r.state for r in got if r.page_id is None) == {"intact": 50}
    fewer = merkle.audit(whole, whole.orderBy("offset").limit(640 - 30)).collect()
    assert Counter(r.state for r in fewer) == {"intact": 610, "missing": 40}
    later = whole.withColumn("offset", F.col("offset") + 7)
    assert Counter(r.state for r in merkle.audit(whole, later).collect()) == {"moved": 650}


def test_running_sums_of_a_hot_key_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", "", "c" * 40]), rng.choice([None, 1, 2, 3]), 0) for _ in range(3000)]
    rows = [(k, o, 0 if o is None else o * 7 + len(k)) for k, o, _ in rows]
    table = materialize(spark.createDataFrame(rows, "k string, o long, v long").repartition(5), "rows")
    got = running_sum(table, F.col("k"), ["o"], F.col("v"), "before").collect()
    want, upto = [], Counter()
    for k, o, v in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        want.append((k, o, v, upto[k]))
        upto[k] += v
    assert Counter(map(tuple, got)) == Counter(want)
    assert running_sum(table.limit(0), F.col("k"), ["o"], F.col("v"), "before").collect() == []


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 12)) * rng.uniform(0.5, 2, size=(1500, 1))
    x[700:1000] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    broken = [(5000, None), (5020, [0.0] * 12), (5040, [float("nan")] * 12), (5060, [float("inf")] + [1.0] * 11), (5080, [1.0, None] + [1.0] * 10), (5100, [1.0] * 3), (None, [1.0] * 12)]
    vectors = spark.createDataFrame(rows + broken, "vec_id long, embedding array<double>").withColumn("cell", F.lit("clash"))
    got = defaultdict(list)
    for r in ann.search(vectors, vectors.where("vec_id % 20 = 0"), 20, cell_size=64, probe=12, block=128).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 20):
        scores = x @ x[q]
        order = [v for v in np.lexsort((np.arange(1500), -np.round(scores, 9))) if v != q][:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and q not in [m[1] for m in mine]
        assert all(abs(m[2] - scores[m[1]]) < 1e-9 for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hits += len(set(order) & {m[1] for m in mine})
    assert set(got) == set(range(0, 1500, 20)) and hits / (75 * 20) > 0.9
    few = vectors.where("vec_id < 5")
    assert ann.search(few, few, 20).count() == 5 * 4
    assert ann.search(few.limit(0), few, 20).count() == 0 and ann.search(few, few.limit(0), 20).count() == 0


def test_repeated_query_rows_leave_room_for_neighbours(spark):
    """Rows of a query's own id, as copies and on other vectors, against all inner products."""
    x = np.random.default_rng(8).normal(size=(200, 8))
    rows = [(v, x[v]) for v in range(200)] + [(0, x[0])] * 50 + [(20, x[20] + 0.01 * t) for t in range(30)] + [(7, x[7])] * 3
    vectors = spark.createDataFrame([(v, e.tolist()) for v, e in rows], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(vectors, vectors.where("vec_id IN (0, 7, 40)"), 20, probe=64).collect():
        got[r.query_id].append((r.rank, r.vec_id, round(r.score, 9)))
    for q in (0, 7, 40):
        scores = sorted(((-float(x[q] @ e), v) for v, e in rows if v != q))[:20]
        assert sorted(got[q]) == [(i, v, round(-s, 9)) for i, (s, v) in enumerate(scores, 1)], q
    twice = ann.search(vectors, vectors.where("vec_id = 20"), 20, probe=64).groupBy("rank").count().count()
    assert twice == 20


def test_language(spark, none):
    rng = random.Random(4)
    parts = {"en": ["the", "ing", "tion", "of"], "de": ["sch", "ung", "der", "ü"], "fr": ["eau", "é", "oi", "que"]}
    rows = []
    for k in range(600):
        lang = rng.choice(list(parts))
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60))]
        rows.append((k, " ".join(words), None if k % 50 == 0 else lang, lang))
    rows += [(1000, None, "en", "en"), (1001, "", "en", "en"), (1002, "12 34 !!", "de", "de"), (None, "the thing", "en", "en"), (1003, "schung " * 30000, None, "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash"))
    model = language_id.fit(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(600)) and not got[None].held_out
    held = [(got[k].lang_pred, rows[k][3]) for k in range(600) if got[k].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    assert [got[k].lang_pred for k in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = language_id.identify(docs, model, keep_text=True)
    assert sorted(kept.columns) == sorted(docs.columns) and kept.count() == len(rows)
    empty = docs.limit(0)
    assert language_id.identify(empty, language_id.fit(empty)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, language_id.fit(empty)).collect()} == {"und"}


def test_held_out_rows_teach_nothing(spark):
    rows = [(k, "abc def" if zlib.crc32(str(k).encode()) % 4 == 2 else "xyz uvw", "no" if zlib.crc32(str(k).encode()) % 4 == 2 else "yes") for k in range(80)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["yes"]


def test_kernel_is_the_presence_kernel():
    """Folded weights score as kernel values against landmarks do."""
    texts, labels = ["abcabc", "abd", "xyzx", "xyy"], ["a", "a", "b", "b"]
    model = language_id.train(texts, labels, ["a", "b"], 4, 3, 1e-2)
    marks = [np.flatnonzero(m).copy() for m, _ in ((m.copy(), x) for m, x in language_id.presence(texts, 3))]
    expected = [len({t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}) for t in texts]
    assert [len(m) for m in marks] == expected
    assert [p for p, _ in model.predict(["abc", "xy"])] == ["a", "b"]
