from __future__ import annotations

import math
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators import catalog, fts, vector
from lodestone.plans import lookup, queries
from lodestone.plans import search as plan


@pytest.fixture(scope="module")
def corpus():
    random.seed(3)
    alphabet = "abcd "
    return ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(150)] + ["", "ab", "ABC dda", "aaaa aaaa"]


@pytest.fixture(scope="module")
def chunks(spark, corpus):
    return spark.createDataFrame(list(enumerate(corpus)), "chunk_id long, text string").cache()


@pytest.fixture(scope="module")
def fts5(corpus):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(path UNINDEXED, text, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no trigram index")
    con.executemany("INSERT INTO t(rowid, path, text) VALUES (?, '', ?)", enumerate(corpus))
    return con


PATTERNS = [
    "abc", '"abc" OR "bcd"', "abc AND bcd", "abc bcd", "abc NOT bcd", "(abc OR bcd) AND dda", "abc OR (bcd AND dda)", '"abca"', "ab abc", "ab OR abc", "abc NOT ab",
    "abc*", "abc + bca", "NEAR(abc dda, 3)", "NEAR(aab abb, 20)", "^abc", "text:abc", "aaa", '"abc" OR "ABC"', "abc bcd NOT dda",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_score_as_an_fts5_index_does(chunks, fts5, pattern):
    want = dict(fts5.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (pattern,)).fetchall())
    got = {r.chunk_id: r.fts_rank for r in fts.fts_topk(chunks, pattern, 1000, is_pattern=True).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-12) for k in got)


@pytest.mark.parametrize("pattern", ["ab", "ab AND abc", "path:abc", "ab*"])
def test_patterns_without_a_match(chunks, pattern):
    assert fts.fts_topk(chunks, pattern, 10, is_pattern=True).count() == 0


@pytest.mark.parametrize("pattern", ["", '"abc', "a-b", "abc AND", "(abc", "nope:abc"])
def test_bad_patterns_raise(pattern):
    with pytest.raises(fts.PatternError):
        fts.parse(pattern)


def test_literal_queries_become_trigrams():
    for query in (" rosé 葡萄酒 ", 'x"y"z"', "ooooooo", "Mm mM", "".join(map(chr, range(0x3041, 0x3041 + 200))), "zz"):
        bare = query.strip()
        want = []
        for at in range(len(bare) - 2):
            if bare[at : at + 3] not in want and len(want) < 128:
                want.append(bare[at : at + 3])
        assert fts.query_terms(query) == want
        parts = [] if not want else fts.parse(fts.match_query(query))
        parts = getattr(parts, "parts", [parts]) if want else []
        assert [p.text for p in parts] == [w.lower() for w in want]


def test_literal_search_and_fallback(chunks, fts5):
    want = fts5.execute("SELECT rowid FROM t WHERE t MATCH ? ORDER BY bm25(t), rowid LIMIT 5", (fts.match_query("abcd"),)).fetchall()
    assert [r.chunk_id for r in fts.fts_topk(chunks, "abcd", 5).collect()] == [w[0] for w in want]
    short = fts.like_topk(chunks, "BC", 3).collect()
    assert all("bc" in r.text.lower() for r in short) and [len(r.text) for r in short] == sorted(len(r.text) for r in short)


def test_fallback_folds_ascii_only(spark):
    rows = spark.createDataFrame([(1, "ÉTÉ"), (2, "été"), (3, "100%_x")], "chunk_id long, text string")
    assert [r.chunk_id for r in fts.like_topk(rows, "é", 9).collect()] == [2]
    assert [r.chunk_id for r in fts.like_topk(rows, "%_", 9).collect()] == [3]


@pytest.fixture(scope="module")
def index(spark, corpus, chunks, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookup") / "postings")
    lookup.write_postings(chunks, path, rows_per_file=50)
    return lookup.TextIndex(spark.read.schema(lookup.POSTING).parquet(path), chunks, len(corpus), sum(max(0, len(t) - 2) for t in corpus))


@pytest.mark.parametrize("pattern", [*PATTERNS, "abcd OR bcda", "NEAR(abc dda, 3) OR ccc", "(abcd AND bcd) NOT (dda OR abca)", "ab", "path:abc", "abc + dda"])
def test_lookups_equal_scans(chunks, index, pattern):
    """Through the posting table every pattern gives what a scan of all chunks does, rank for rank."""
    want = [(r.chunk_id, r.text, pytest.approx(r.fts_rank, rel=1e-12)) for r in fts.fts_topk(chunks, pattern, 40, is_pattern=True).collect()]
    got = lookup.topk(index, pattern, 40, is_pattern=True).orderBy("fts_rank", "chunk_id").collect()
    assert sorted((r.chunk_id, r.text, r.fts_rank) for r in got) == sorted(want, key=lambda w: w[0])


@pytest.mark.parametrize("pattern", ['"abca" OR (dda AND bcd)', "NEAR(abc dda, 3)", "abcd NOT dda"])
def test_texts_of_candidates_are_not_moved(spark, chunks, index, pattern, monkeypatch, tmp_path):
    """Few candidates are handed to the texts; with many the texts are scanned in place, with the same ranks. Neither exchanges texts."""
    want = [(r.chunk_id, pytest.approx(r.fts_rank, rel=1e-12)) for r in fts.fts_topk(chunks, pattern, 40, is_pattern=True).collect()]
    chunks.write.parquet(f"{tmp_path}/chunks")
    stored = lookup.TextIndex(index.postings, spark.read.parquet(f"{tmp_path}/chunks"), index.n, index.tokens)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (lookup.FEW, 0):
            monkeypatch.setattr(lookup, "FEW", few)
            found = lookup.ranked(stored, pattern, is_pattern=True)
            assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
            assert sorted((r.chunk_id, r.fts_rank) for r in found.orderBy("fts_rank", "chunk_id").limit(40).collect()) == sorted(want, key=lambda w: w[0])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_posting_rows_are_blocks(spark, tmp_path):
    """A trigram that every chunk has is one row for some thousand chunks, and its bytes give the chunks back."""
    texts = ["the thing " + "x" * (k % 300) for k in range(9000)] + ["", "th", "葡萄酒 the " + "é\U0001f600" * 3]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").coalesce(1)
    lookup.write_postings(rows, f"{tmp_path}/p")
    index = lookup.TextIndex(spark.read.schema(lookup.POSTING).parquet(f"{tmp_path}/p"), rows, len(texts), sum(max(0, len(t) - 2) for t in texts))
    blocks = index.postings.where("term = ''").count()
    assert 3 <= blocks <= 4 and index.postings.where("term = 'the'").count() <= blocks
    for query in ("the thing", "xxx", "葡萄酒", "é\U0001f600é"):
        want = [(r.chunk_id, r.fts_rank) for r in fts.fts_topk(rows, query, 30).collect()]
        assert [(r.chunk_id, r.fts_rank) for r in lookup.topk(index, query, 30).orderBy("fts_rank", "chunk_id").collect()] == want and want
    values = lookup.np.array([1, 127, 128, 16383, 16384, 2**21, 2**28, 2**32 - 1, 5])
    packed = lookup.pack(values, lookup.np.array([2, 8, 9])).to_pylist()
    assert [lookup.unpack(b).tolist() for b in packed] == [[1, 127], values[2:8].tolist(), [5]]


def _stages(spark) -> list:
    """What Spark still knows of its stages; it forgets the oldest first."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    none = jvm.java.util.ArrayList()
    found = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return [found.apply(i) for i in range(found.size())]


def test_what_a_literal_search_moves_follows_the_texts(spark, tmp_path):
    """With the build of its index a search shuffles, spills and writes a few bytes for each character, at four times the table too."""
    random.seed(11)
    words = ["".join(random.choice("etaoinshrdlu") for _ in range(random.randint(2, 9))) for _ in range(3000)] + ["the", "thing", "that"] * 50
    texts = [" ".join(random.choices(words, k=random.randint(20, 300))) for _ in range(800)]
    moved = []
    for copies in (1, 4):
        rows = [(i * len(texts) + k, text, "en", "s", len(text)) for i in range(copies) for k, text in enumerate(texts)]
        table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
        table.write.parquet(f"{tmp_path}/{copies}/documents.parquet")
        want = queries.fts_scan_topk(spark, f"{tmp_path}/{copies}").collect()
        last = max(s.stageId() for s in _stages(spark))
        assert sorted(queries.fts_literal_topk(spark, f"{tmp_path}/{copies}").collect()) == sorted(want) and len(want) == 10
        moved.append(sum(s.shuffleWriteBytes() + s.diskBytesSpilled() + s.outputBytes() for s in _stages(spark) if s.stageId() > last))
        assert moved[-1] < 6 * copies * sum(map(len, texts))
    assert moved[1] < 4.2 * moved[0]


def test_lookups_prune_buckets(index):
    plan_ = index.postings.where((F.col("bucket") == 3) & (F.col("term") == "abc"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan_ and "PushedFilters: [IsNotNull(term), EqualTo(term,abc)]" in plan_


def test_searches_with_and_without_postings_agree(chunks, vectors, index):
    q = [0.1, 0.2, -0.3, 0.4]
    for mode, query in [("fts", "abcd"), ("fts", "bc"), ("fts-vec", "abcd"), ("vec-fts", "abcd"), ("vec-fts", "bc"), ("fts-vec", "bc")]:
        asked = plan.resolve(query=query, mode=mode)
        rows = [plan.search(chunks, vectors, asked, q, 8, 20, text).orderBy("place").collect() for text in (None, index)]
        assert [(r.chunk_id, round(r.score, 12), r.source) for r in rows[0]] == [(r.chunk_id, round(r.score, 12), r.source) for r in rows[1]] and rows[0]
        many = [plan.search_many({"x": (chunks, vectors, *more), "y": (chunks, vectors, *more)}, asked, q, 6, 20).collect() for more in ((), (index,))]
        assert [(r.db_path, r.chunk_id, round(r.score, 12)) for r in many[0]] == [(r.db_path, r.chunk_id, round(r.score, 12)) for r in many[1]]


def test_postings_count_overlapping_trigrams(chunks, corpus):
    got = {(r.chunk_id, r.term): r.tf for r in fts.postings(chunks).collect()}
    want = {}
    for i, text in enumerate(corpus):
        for k in range(len(text) - 2):
            key = (i, text[k : k + 3].lower())
            want[key] = want.get(key, 0) + 1
    assert got == want


def test_postings_cross_over_as_lists(spark):
    """A slice of texts gives one row for each of its trigrams, not one for each text that has it."""
    texts = ["the thing that", None, "ab", "THE", "İΣσ the", "\U0001f600ab\U0001f600ab"] * 50
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string").coalesce(1)
    batch = lookup.pa.RecordBatch.from_pylist([r.asDict() for r in rows.collect()])
    lists = [r for made in fts._count_grams([batch]) for r in made.to_pylist()]
    assert len(lists) == len({r["term"] for r in lists}) and sum(len(r["ids"]) for r in lists) > 10 * len(lists)
    want = {}
    for i, text in enumerate(texts):
        folded = fts.fold_text(text or "")
        for k in range(len(folded) - 2):
            want[i, folded[k : k + 3]] = want.get((i, folded[k : k + 3]), 0) + 1
    assert {(r.chunk_id, r.term): r.tf for r in fts.postings(rows).collect()} == want


def test_a_scan_judges_each_text_once(chunks):
    """The filter on matches does not run the judging function a second time."""
    plan_ = fts.fts_topk(chunks, "abcd", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan_.count("ArrowEvalPython") == 1 and "lower(" not in plan_


@pytest.fixture(scope="module")
def vectors(spark, corpus):
    random.seed(5)
    rows = [(i, [random.gauss(0, 1) for _ in range(4)]) for i in range(0, len(corpus), 2)]
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>").cache()


def test_nearest_neighbours(vectors):
    rows = vectors.collect()
    q = vx.float32([0.1, 0.2, -0.3, 0.4])
    want = sorted((math.dist(r.embedding, q), r.chunk_id) for r in rows)[:5]
    got = vector.knn_topk(vectors, q, 5).collect()
    assert [r.chunk_id for r in got] == [w[1] for w in want]
    assert all(math.isclose(r.score, 1 / (1 + w[0])) for r, w in zip(got, want, strict=True))


def test_hybrids_keep_candidates_that_lack_a_part(chunks, vectors):
    q = [0.1, 0.2, -0.3, 0.4]
    first = vector.fts_then_vector(chunks, vectors, "abc", q, 50, 50).collect()
    assert any(r.vec_distance is None for r in first) and any(r.vec_distance is not None for r in first)
    assert [r.score for r in first] == sorted((r.score for r in first), reverse=True)
    second = vector.vector_then_fts(chunks, vectors, "abc", q, 20, 20).collect()
    assert len(second) == 20 and any(r.fts_rank is None for r in second)
    for r in first + second:
        vec = 0 if r.vec_distance is None else 1 / (1 + r.vec_distance)
        text = 0 if r.fts_rank is None else min(1, max(0, -r.fts_rank))
        assert math.isclose(r.score, 0.7 * vec + 0.3 * text)


def test_short_queries_differ_by_direction(chunks, vectors):
    q = [0.1, 0.2, -0.3, 0.4]
    assert {r.fts_rank for r in vector.fts_then_vector(chunks, vectors, "bc", q, 5, 50).collect()} == {None}
    assert {r.fts_rank for r in vector.vector_then_fts(chunks, vectors, "bc", q, 50, 50).collect()} == {None, -1.0}


def test_resolution():
    assert plan.resolve("a").mode == "vec" and plan.resolve(pattern="a").mode == "fts" and plan.resolve("a", "b").mode == "vec-fts"
    assert plan.resolve("  q ", mode="fts") == plan.Resolved("fts", None, "q", False)
    for wrong in ({"query": " "}, {"pattern": "x", "mode": "vec"}, {"query": "x", "mode": "?"}):
        with pytest.raises(ValueError):
            plan.resolve(**wrong)


def test_many_indexes_merge_by_score(chunks, vectors):
    q = [0.1, 0.2, -0.3, 0.4]
    halves = {name: (chunks.where(F.col("chunk_id") % 4 == k), vectors) for name, k in (("b", 0), ("a", 2))}
    whole = vector.knn_topk(vectors, q, 6).collect()
    got = plan.search_many(halves, plan.resolve("x"), q, limit=6).collect()
    assert [r.chunk_id for r in got] == [r.chunk_id for r in whole]
    assert {r.source for r in got} == {"vec"}


def test_rows_of_any_language_are_in_an_index(spark, tmp_path):
    langs = ["de", "en", None, "ja", "", "fr", None, "EN"]
    rows = [(k, f"text {k} has the thing that is asked for", lang, "a", 40) for k, lang in enumerate(langs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.multi_index_merge(spark, str(tmp_path)).collect()
    assert len(found) == len(langs) and len({r.chunk_id for r in found}) == len(langs)
    assert sorted(r.db_path for r in found) == ["de", "en", "fr"] + ["other"] * 5


def test_text_functions(spark):
    spaces = [c for c in map(chr, range(0x3001)) if c.isspace()]
    texts = ["p" + c + c + "q" for c in spaces] + [c + "r" + c for c in spaces] + ["s \n t" + "\u3000u" * 100, "v\u200bw", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    for r in rows.select("k", tx.snippet(F.col("t")).alias("short"), tx.strip(F.col("t")).alias("bare"), tx.is_blank(F.col("t")).alias("blank")).collect():
        flat = " ".join(texts[r.k].split())
        assert r.short == (flat if len(flat) <= 160 else flat[:157] + "...") and r.bare == texts[r.k].strip() and r.blank == (not flat)
    families = {"cl-nagoya/ruri-v3-30m": "ruri-v3", "BAAI/bge-m3": "bge-m3", "BAAI/bge-m3-unsupervised": "e5", "my/model": "e5", "pfnet/plamo-embedding-1b": "plamo", "pfnet/plamo-embedding-1b-x": "e5"}
    assert {m: tx.prefix_policy(m) for m in families} == families


def test_a_missing_distance_stops_the_query(spark):
    rows = spark.createDataFrame([(1.0,), (None,)], "d double")
    with pytest.raises(Exception, match="rebuild the index"):
        rows.select(vx.require_distance(F.col("d"))).collect()
    assert rows.where("d > 0").select(vx.require_distance(F.col("d"))).first()[0] == 1.0


def test_finite_guard(spark):
    rows = spark.createDataFrame([([1.0, float("nan")],)], "embedding array<float>")
    with pytest.raises(Exception, match="non-finite"):
        rows.select(vx.require_finite(F.col("embedding"))).collect()


def test_compatibility():
    one = {k: "x" for k in catalog.COMPATIBLE_KEYS}
    catalog.check_compatible([one, dict(one, embedding_device="mps")])
    for other in (dict(one, embedding_dim="3"), dict(one, embedding_model="")):
        with pytest.raises(ValueError):
            catalog.check_compatible([one, other])


def test_paths_of_indexes(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    (tmp_path / "link").symlink_to(tmp_path / "real")
    real = str((tmp_path / "real").resolve())
    paths = ["s3a://store/b/../idx", "link", "real", "./real/", "~/idx"]
    assert catalog.normalized_paths(paths) == sorted(["s3a://store/b/../idx", real, str(tmp_path.resolve() / "home/idx")])
    assert catalog.set_hash(["link", "real"]) == catalog.set_hash([real])
