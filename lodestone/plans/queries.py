"""The engine's registered queries, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions import vectors as vx
from lodestone.operators import catalog, fts, vector
from lodestone.operators.chunking import chunk_documents, window_chunks
from lodestone.plans import lookup
from lodestone.plans import search as plan
from lodestone.plans.index import CHUNK_COLUMNS, PLACE_BITS, SESSION, Index
from lodestone.plans.lookup import POSTING, TextIndex, write_postings
from lodestone.plans.store import Store, index_folder
from lodestone.sources import files as file_source
from lodestone.sources import sessions

Query = Callable[[SparkSession, str], DataFrame]

LITERAL = "the thing that"
PATTERNS = {
    "and": "the AND ing",
    "or": '"tion the" OR (enn AND shn)',
    "not": "ation NOT ing",
    "phrase": '"of the"',
    "near": "NEAR(ing the, 5)",
}
SHORT = "Zu"
VECTOR_ID = 0


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window chunks of all documents, with ids in order of document and place."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    found = window_chunks(docs, ["doc_id", "source", "lang"])
    return found.withColumn("chunk_id", F.col("doc_id") * 1_000_000 + F.col("chunk_index"))


_built: dict[tuple, dict[str, TextIndex]] = {}
LANGUAGES = ("de", "en", "es", "fr")


def _language() -> F.Column:
    """The index that a chunk is in: one a language that is named, and one for all others and for none."""
    return F.when(F.col("lang").isin(*LANGUAGES), F.col("lang")).otherwise("other")


def text_indexes(spark: SparkSession, sf_dir: str, by_language: bool = False) -> dict[str, TextIndex]:
    """Persisted chunks and postings of the documents, built when first asked for and used again while the table is the same."""
    stamp = (spark.sparkContext.applicationId, sf_dir, by_language, *Store(spark, f"{sf_dir}/documents.parquet").stat())
    if stamp not in _built:
        root = index_folder(spark)
        _chunks(spark, sf_dir).withColumn("shard", _language() if by_language else F.lit("all")).write.parquet(f"{root}/chunks")
        chunks = spark.read.parquet(f"{root}/chunks")
        # a window is as long as its text
        tokens = F.sum(F.greatest(F.lit(0), F.col("end_offset") - F.col("start_offset") - 2))
        sums = chunks.groupBy("shard").agg(F.count("*").alias("n"), tokens.alias("tokens")).collect()
        write_postings(chunks, f"{root}/postings", size=sum(row["tokens"] for row in sums), by="shard")
        found = {}
        for row in sums:
            postings = spark.read.schema(POSTING).parquet(f"{root}/postings/shard={row['shard']}")
            found[row["shard"]] = TextIndex(postings, chunks.where(F.col("shard") == row["shard"]).drop("shard"), row["n"], row["tokens"])
        _built[stamp] = found
    return _built[stamp]


def _text_index(spark: SparkSession, sf_dir: str) -> TextIndex:
    found = text_indexes(spark, sf_dir)
    return found["all"] if found else TextIndex(spark.createDataFrame([], POSTING), _chunks(spark, sf_dir).limit(0), 0, 0)


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """One vector by its id: what a provider returns for a query."""
    return list(_table(spark, sf_dir, "embeddings").where(F.col("vec_id") == VECTOR_ID).first()["embedding"])


def _chunk_vectors(spark: SparkSession, sf_dir: str, chunks: DataFrame) -> DataFrame:
    """Chunks carry the vector of their document, where it has one."""
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return chunks.select("chunk_id", "doc_id").join(vectors, "doc_id").select("chunk_id", "embedding")


def _files(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Documents as indexed files below one root a source, with ``more`` of their columns."""
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".txt"))
    return _table(spark, sf_dir, "documents").select(
        F.concat(F.lit("/"), F.col("source"), F.lit("/"), name).alias("path"), F.concat(F.lit("/"), F.col("source")).alias("root_path"), name.alias("relative_path"),
        F.octet_length("text").cast("long").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ns"), tx.content_hash(F.col("text")).alias("content_hash"),
        "doc_id", *more,
    )


def _previous(files: DataFrame) -> DataFrame:
    """An earlier state of the files: some not there yet, some with other contents, some that are gone now."""
    old = files.where("doc_id % 7 != 0").withColumn("content_hash", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("content_hash")))
    gone = files.where("doc_id % 11 = 3").withColumn("path", F.concat("path", F.lit(".gone")))
    return old.unionByName(gone)


def _score(name: str) -> F.Column:
    return F.round(name, 9).alias(name)


# -- queries ---------------------------------------------------------------------


def chunk_long_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", "start_offset", "end_offset", "text")


def chunk_line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("chunk_id", "start_line", "end_line")


def _conversations(spark: SparkSession, sf_dir: str, text) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    parts = F.sort_array(F.collect_list(F.struct("turn", text.alias("t"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("text"))


def chunk_paragraph_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _conversations(spark, sf_dir, F.col("text"))
    return chunk_documents(docs, ["conv_id"], F.col("text"), F.lit(".txt"))


def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("turn") % 3 == 2, F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```"))).otherwise(F.col("text"))
    docs = _conversations(spark, sf_dir, F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), body))
    return chunk_documents(docs, ["conv_id"], F.col("text"), F.lit(".md"))


def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.postings(_chunks(spark, sf_dir)).select("term", "chunk_id", "tf")


def trigram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.postings(_chunks(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.corpus_stats(_chunks(spark, sf_dir))


def fts_literal_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.topk(_text_index(spark, sf_dir), LITERAL, 10).select("chunk_id", _score("score"))


def fts_scan_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without an index, by a scan of all chunks."""
    return fts.fts_topk(_chunks(spark, sf_dir), LITERAL, 10).select("chunk_id", _score("score"))


def _pattern(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return lookup.topk(_text_index(spark, sf_dir), PATTERNS[name], 10, is_pattern=True).select("chunk_id", _score("score"))

    return run


def like_fallback_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fts.like_topk(_chunks(spark, sf_dir), SHORT, 10).select("chunk_id", F.length("text").alias("n"), "score")


def vec_knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector.knn_topk(_table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir), 10, "vec_id")
    return found.select("vec_id", _score("vec_distance"), _score("score"))


def vec_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    distance = vx.l2_distance(F.col("embedding"), vx.literal_vector(_query_vector(spark, sf_dir)))
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(vx.distance_to_score(distance), 9).alias("score"))


def vector_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = F.transform("embedding", lambda v: v.cast("double") * 3)
    unit = vx.normalize(scaled)
    return _table(spark, sf_dir, "embeddings").select("vec_id", F.round(unit[0], 9).alias("first"), F.round(F.aggregate(unit, F.lit(0.0), lambda s, v: s + v * v), 9).alias("square"))


def vector_nonfinite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda v: F.lit(float("nan")).cast("float"))).otherwise(F.col("embedding"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", vx.is_finite(broken).alias("ok"))


def _hybrid(kind: str, query: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = _text_index(spark, sf_dir)
        asked = plan.resolve(query=query, mode=kind)
        found = plan.search(index.chunks, _chunk_vectors(spark, sf_dir, index.chunks), asked, _query_vector(spark, sf_dir), 10, 50, index)
        return found.select("chunk_id", _score("score"))

    return run


def multi_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexes = {lang: (index.chunks, None, index) for lang, index in text_indexes(spark, sf_dir, by_language=True).items()}
    if not indexes:
        return spark.createDataFrame([], "db_path string, chunk_id long, score double")
    found = plan.search_many(indexes, plan.resolve(query=LITERAL, mode="fts"), limit=10)
    return found.select("db_path", "chunk_id", _score("score"))


def files_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.files_list(_files(spark, sf_dir))


def _file_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir).select("doc_id", "path")
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index").join(files, "doc_id")


def roots_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.roots_summary(_files(spark, sf_dir), _file_chunks(spark, sf_dir))


def index_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.index_info(_files(spark, sf_dir), _chunks(spark, sf_dir))


def remove_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return catalog.removed_files(_previous(files), files).select("path")


def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return catalog.changed_files(files, _previous(files)).select("path", "content_hash")


def changed_by_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose size, time or place differ from the index, or that it lacks; no content is read."""
    files = _files(spark, sf_dir)
    touched = F.when(F.col("doc_id") % 13 == 4, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns"))
    old = _previous(files).withColumn("mtime_ns", touched)
    state = tuple(c for c in catalog.STATE if c != "content_hash")
    return catalog.changed_files(files, old, state).select("path", "size", "mtime_ns")


def index_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that count in an index of two segments: the second has other texts for some files and names others as gone."""
    files = _files(spark, sf_dir)
    docs = _files(spark, sf_dir, "text").select("doc_id", "path", "text").where("doc_id IS NOT NULL")
    if docs.groupBy("doc_id").count().where("count > 1").first():
        # an id that is not one file's: each of its files has all of its texts; else a row has its path, and no text is moved to it
        docs = docs.drop("path").join(files.select("doc_id", "path"), "doc_id")
    taken = (docs.agg(F.max("doc_id")).first()[0] or 0) + 1
    index = Index(spark, index_folder(spark))

    def add(some: DataFrame, shift: int, gone: DataFrame, fresh: bool) -> None:
        named = some.withColumn("file_id", F.col("doc_id") + shift)
        cut = window_chunks(named, ["path", "file_id"]).withColumn("chunk_id", F.shiftleft("file_id", PLACE_BITS) + F.col("chunk_index"))
        cut = cut.withColumns({name: F.lit(None).cast(kind) for name, kind in {**SESSION, "embedding": "array<float>"}.items()})
        states = files.join(some.select("doc_id"), "doc_id", "left_semi").withColumn("file_id", F.col("doc_id") + shift)
        index.commit(states, cut.select(*CHUNK_COLUMNS), gone, {}, fresh, taken + shift)

    add(docs, 0, docs.select(F.col("doc_id").alias("file_id")).limit(0), True)
    renewed = docs.where("doc_id % 7 = 2 AND doc_id % 5 != 1").withColumn("text", F.concat(F.lit("New "), "text"))
    add(renewed, taken, docs.where("doc_id % 7 = 2 OR doc_id % 5 = 1").select(F.col("doc_id").alias("file_id")), False)
    return index.chunks.select("path", "chunk_index", "start_offset", "end_offset", "text")


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _files(spark, sf_dir)
    return catalog.index_stats(files, _previous(files), _file_chunks(spark, sf_dir))


def metadata_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    new = _table(spark, sf_dir, "nation").where("n_nationkey % 3 = 0").select(F.concat("n_name", F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("+")).alias("key"), F.lit("new").alias("value"))
    return catalog.upsert_metadata(old, new)


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"))


def ext_filter_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").withColumn("path", F.concat("url", F.when(F.col("page_id") % 3 == 0, ".md").when(F.col("page_id") % 3 == 1, ".log").otherwise(".rst")))
    return pages.where(file_source.suffix_filter(F.col("path")) & ~F.col("path").rlike("[02468][.]")).select("page_id", "path")


def _session_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as session logs: a meta line, then a task line and a message for every turn."""
    padded = F.when(F.col("turn") % 5 == 1, F.concat(F.lit("\u3000"), F.col("text"), F.lit(" \u00a0"))).otherwise(F.col("text"))
    turns = _table(spark, sf_dir, "conversations").withColumn("text", padded)
    conv = F.col("conv_id").cast("string")
    path = F.concat(F.lit("/sessions/"), F.lpad(conv, 9, "0"), F.lit(".jsonl"))
    source = F.when(F.col("conv_id") % 9 == 4, F.lit('{"subagent":"x"}')).when(F.col("conv_id") % 9 == 5, F.lit('{"kind":"subagent"}')).otherwise(F.lit('"cli"'))
    meta = F.concat(F.lit('{"timestamp":"t0","type":"session_meta","payload":{"id":"s'), conv, F.lit('","cwd":"/w","source":'), source, F.lit("}}"))
    task = F.concat(F.lit('{"type":"event_msg","payload":{"type":"task_started","turn_id":"'), F.col("turn").cast("string"), F.lit('"}}'))
    said = F.to_json(F.struct(
        F.concat(F.lit("t"), F.col("turn").cast("string")).alias("timestamp"), F.lit("response_item").alias("type"),
        F.struct(F.lit("message").alias("type"), "role", F.when(F.col("turn") % 4 == 3, "commentary").otherwise("final_answer").alias("phase"),
                 F.array(F.struct(F.lit("text").alias("type"), F.col("text"))).alias("content")).alias("payload")))
    head = turns.groupBy("conv_id").agg(F.min("turn")).select(path.alias("path"), F.lit(1).alias("line_no"), meta.alias("line"))
    tasks = turns.select(path.alias("path"), (F.col("turn") * 2 + 2).cast("int").alias("line_no"), task.alias("line"))
    messages = turns.select(path.alias("path"), (F.col("turn") * 2 + 3).cast("int").alias("line_no"), said.alias("line"))
    return head.unionByName(tasks).unionByName(messages)


def session_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.turns(_session_lines(spark, sf_dir))


def session_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.turn_chunks(sessions.turns(_session_lines(spark, sf_dir))).select("session_path", "line_no", "chunk_index", "start_offset", "end_offset", "text")


def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.when(F.col("doc_id") % 5 == 1, F.translate("text", " ", "\u3000")).otherwise(F.col("text"))
    return _table(spark, sf_dir, "documents").select("doc_id", tx.snippet(F.concat(F.lit("\u00a0"), wide)).alias("snippet"))


#: A model of each family, one whose name only begins like another's, and one that is not known.
MODELS = ("intfloat/multilingual-e5-small", "cl-nagoya/ruri-v3-70m", "Qwen/Qwen3-Embedding-0.6B", "BAAI/bge-m3", "BAAI/bge-m3-unsupervised", "sbintuitions/sarashina-embedding-v2-1b", "pfnet/plamo-embedding-1b", "other/model")


def prefix_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _table(spark, sf_dir, "benchmark")
    each = [F.struct(F.lit(m).alias("model"), tx.with_prefix(F.col("text"), tx.prefix_policy(m)).alias("passage"), tx.with_prefix(F.col("text"), tx.prefix_policy(m), query=True).alias("query")) for m in MODELS]
    return texts.select("item_id", F.explode(F.array(*each)).alias("m")).select("item_id", "m.*")


def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    timings = _table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("name"), F.col("l_quantity").cast("double").alias("seconds"), F.lit(4.0).alias("vectors"), F.col("l_extendedprice").cast("double").alias("chars")
    )
    found = catalog.summarize_timings(timings)
    return found.select("name", *[F.round(c, 6).alias(c) for c in found.columns[1:]])


# -- the same in SQL ---------------------------------------------------------------

_FOLD = "lower(translate({0}, 'İΣ', 'iσ'))"
_CHUNKS = """
spans AS (
  SELECT doc_id, source, lang, text AS whole, unnest(range(0, 1 + greatest(0, ceil((length(text) - 600) / 480.0))::BIGINT)) AS k
  FROM documents WHERE trim(text, ' ') <> ''),
chunks AS (
  SELECT doc_id, source, lang, k::INT AS chunk_index, (k * 480)::INT AS start_offset, least(k * 480 + 600, length(whole))::INT AS end_offset,
    substr(whole, k * 480 + 1, least(k * 480 + 600, length(whole)) - k * 480) AS text, whole, doc_id * 1000000 + k AS chunk_id
  FROM spans),
folded AS (SELECT chunk_id, doc_id, lang, text, lower(translate(text, 'İΣ', 'iσ')) AS t, greatest(0, length(text) - 2) AS d FROM chunks)"""


def _occurrences(phrase: str) -> str:
    p = phrase.replace("'", "''")
    return f"len(list_filter(range(1, greatest(1, length(t) - {len(phrase) - 2})), lambda i: substr(t, i, {len(phrase)}) = '{p}'))"


def _bm25(phrases: list[tuple[str, str]], match: str, source: str = "folded", extra: str = "") -> str:
    """CTEs ending in ``ranked``: phrases are pairs of text and gate."""
    has = [f"contains(t, '{p}')" for p, _ in phrases]
    sums = ", ".join(f"sum(({h})::BIGINT) AS n{i}" for i, h in enumerate(has))
    tfs = ", ".join(f"(CASE WHEN ({gate}) AND {h} THEN {_occurrences(p)} ELSE 0 END)::DOUBLE AS tf{i}" for i, ((p, gate), h) in enumerate(zip(phrases, has, strict=True)))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    terms = " + ".join(f"({idf(i)}) * (tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * d / mean)))" for i in range(len(phrases)))
    return f"""stats AS (SELECT count(*) AS n, sum(d)::DOUBLE / count(*) AS mean, {sums} FROM {source}),
tfs AS (SELECT chunk_id, doc_id, d, ({match}) AS hit{extra}, {tfs} FROM {source}),
ranked AS (SELECT chunk_id, doc_id, hit{extra}, -({terms}) AS fts_rank FROM tfs, stats)"""


def _topk(phrases: list[tuple[str, str]], match: str) -> str:
    return f"WITH {_CHUNKS}, {_bm25(phrases, match)} SELECT chunk_id, round(-fts_rank, 9) AS score FROM ranked WHERE hit ORDER BY fts_rank, chunk_id LIMIT 10"


def _any(terms: list[str]) -> str:
    return " OR ".join(f"contains(t, '{p}')" for p in terms)


_TERMS = [fts.fold_text(t) for t in fts.query_terms(LITERAL)]
_SEQUENCE = lambda p: f"list_filter(range(1, length(t) - {len(p) - 2}), lambda i: substr(t, i, {len(p)}) = '{p}')"
_QUERY = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
_FILES = """
files AS (SELECT '/' || source || '/' || lpad(doc_id::VARCHAR, 9, '0') || '.txt' AS path, '/' || source AS root_path, lpad(doc_id::VARCHAR, 9, '0') || '.txt' AS relative_path,
  strlen(text)::BIGINT AS size, doc_id * 1000 AS mtime_ns, sha256(text) AS content_hash, doc_id FROM documents),
previous AS (SELECT path, root_path, relative_path, size, mtime_ns, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM files WHERE doc_id % 7 <> 0
  UNION ALL SELECT path || '.gone', root_path, relative_path, size, mtime_ns, content_hash FROM files WHERE doc_id % 11 = 3)"""
_CHANGED = """changed AS (SELECT f.path, f.content_hash FROM files f WHERE NOT EXISTS (SELECT 1 FROM previous p WHERE p.path = f.path AND p.root_path = f.root_path
  AND p.relative_path = f.relative_path AND p.size = f.size AND p.mtime_ns = f.mtime_ns AND p.content_hash = f.content_hash))"""
_HYBRID = "0.7 * coalesce(1 / (1 + dist), 0) + 0.3 * coalesce(least(1.0, greatest(0.0, -fts_rank)), 0)"
_DIST = f"list_distance(e.embedding::DOUBLE[], {_QUERY})"
_SESSIONS = """
said AS (SELECT conv_id, turn, role, text, 's' || conv_id AS session_id, '/w' AS cwd, 't' || turn AS timestamp, turn::VARCHAR AS turn_id,
    '/sessions/' || lpad(conv_id::VARCHAR, 9, '0') || '.jsonl' AS session_path, (turn * 2 + 3)::INT AS line_no
  FROM (SELECT * REPLACE (regexp_replace(CASE WHEN turn % 5 = 1 THEN chr(12288) || text || ' ' || chr(160) ELSE text END, '^[WHITE]+|[WHITE]+$', '', 'g') AS text) FROM conversations)
  WHERE conv_id % 9 <> 4 AND text <> '' AND (role = 'user' OR (role = 'assistant' AND turn % 4 <> 3))
    AND NOT (role = 'user' AND (starts_with(text, '# AGENTS.md instructions') OR starts_with(text, 'The following is the Codex agent history') OR contains(text, '<environment_context>'))))""".replace("WHITE", tx.WHITE)


def _multi_sql() -> str:
    """The top of all languages' indexes, each ranked by its own statistics; rows of other languages, or of none, are one index."""
    named = ", ".join(f"'{lang}'" for lang in LANGUAGES)
    own = _bm25([(p, "true") for p in _TERMS], _any(_TERMS), "sharded", ", db")
    own = own.replace("stats AS (SELECT count(*)", "stats AS (SELECT db AS s_db, count(*)").replace("FROM sharded),\ntfs", "FROM sharded GROUP BY db),\ntfs").replace("FROM tfs, stats)", "FROM tfs JOIN stats ON s_db = db)")
    return f"""WITH {_CHUNKS}, sharded AS (SELECT *, CASE WHEN lang IN ({named}) THEN lang ELSE 'other' END AS db FROM folded), {own}
SELECT db AS db_path, chunk_id, round(-fts_rank, 9) AS score FROM ranked WHERE hit ORDER BY fts_rank, db, chunk_id LIMIT 10"""


def _fts_vec_sql(candidates: str, rank: str) -> str:
    return f"""{candidates}, cand AS (SELECT c.*, row_number() OVER (ORDER BY {rank}) AS prior FROM top c),
scored AS (SELECT c.chunk_id, c.prior, c.fts_rank, {_DIST} AS dist FROM cand c LEFT JOIN embeddings e ON e.vec_id = c.doc_id)
SELECT chunk_id, round({_HYBRID}, 9) AS score FROM scored ORDER BY {_HYBRID} DESC, prior LIMIT 10"""


def _vec_fts_sql(prefix: str, ranks: str) -> str:
    return f"""{prefix}, near AS (SELECT c.chunk_id, {_DIST} AS dist FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id ORDER BY 2, 1 LIMIT 50),
cand AS (SELECT n.*, row_number() OVER (ORDER BY dist, chunk_id) AS prior FROM near n),
scored AS (SELECT c.chunk_id, c.prior, c.dist, r.fts_rank FROM cand c LEFT JOIN ({ranks}) r ON r.chunk_id = c.chunk_id)
SELECT chunk_id, round({_HYBRID}, 9) AS score FROM scored ORDER BY {_HYBRID} DESC, prior LIMIT 10"""


def oracle_sql() -> dict[str, str]:
    with_chunks = f"WITH {_CHUNKS}"
    literal = [(p, "true") for p in _TERMS]
    both = "contains(t, 'enn') AND contains(t, 'shn')"
    near = _near_condition("ing", "the", 5)
    folded_chunk = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    like = f"contains({folded_chunk}, 'zu')"
    return {
        "chunk_long_paragraph": f"{with_chunks} SELECT doc_id, chunk_index, start_offset, end_offset, text FROM chunks",
        "chunk_line_numbers": f"""{with_chunks} SELECT chunk_id, (length(substr(whole, 1, start_offset)) - length(replace(substr(whole, 1, start_offset), chr(10), '')) + 1)::INT AS start_line,
  (length(substr(whole, 1, end_offset - 1)) - length(replace(substr(whole, 1, end_offset - 1), chr(10), '')) + 1)::INT AS end_line FROM chunks""",
        "chunk_paragraph_pack": _PACKED,
        "session_chunks": f"""WITH {_SESSIONS}, cut AS (SELECT *, unnest(range(0, 1 + greatest(0, ceil((length(text) - 600) / 480.0))::BIGINT)) AS k FROM said)
SELECT session_path, line_no, (row_number() OVER (PARTITION BY session_path ORDER BY line_no, k) - 1)::INT AS chunk_index, (k * 480)::INT AS start_offset,
  least(k * 480 + 600, length(text))::INT AS end_offset, substr(text, k * 480 + 1, 600) AS text FROM cut""",
        "trigram_postings": f"{with_chunks} SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(list_transform(range(1, greatest(1, length(t) - 1)), lambda i: substr(t, i, 3))) AS term FROM folded) GROUP BY ALL",
        "trigram_df": f"{with_chunks} SELECT term, count(DISTINCT chunk_id) AS df, count(*) AS cf FROM (SELECT chunk_id, unnest(list_transform(range(1, greatest(1, length(t) - 1)), lambda i: substr(t, i, 3))) AS term FROM folded) GROUP BY term",
        "corpus_stats": f"{with_chunks} SELECT count(*) AS n_chunks, sum(d)::BIGINT AS n_tokens FROM folded",
        "fts_literal_topk": _topk(literal, _any(_TERMS)),
        "fts_scan_topk": _topk(literal, _any(_TERMS)),
        "fts_pattern_and": _topk([("the", "contains(t, 'ing')"), ("ing", "contains(t, 'the')")], "contains(t, 'the') AND contains(t, 'ing')"),
        "fts_pattern_or": _topk([("tion the", "true"), ("enn", both), ("shn", both)], f"contains(t, 'tion the') OR ({both})"),
        "fts_pattern_not": _topk([("ation", "NOT contains(t, 'ing')")], "contains(t, 'ation') AND NOT contains(t, 'ing')"),
        "fts_pattern_phrase": _topk([("of the", "true")], "contains(t, 'of the')"),
        "fts_pattern_near": _near_sql("ing", "the", 5, near),
        "like_fallback_topk": f"{with_chunks} SELECT chunk_id, length(text)::INT AS n, 1.0::DOUBLE AS score FROM chunks WHERE {like} ORDER BY length(text), chunk_id LIMIT 10",
        "vec_knn_topk": f"SELECT vec_id, round({_DIST}, 9) AS vec_distance, round(1 / (1 + {_DIST}), 9) AS score FROM embeddings e ORDER BY {_DIST}, vec_id LIMIT 10",
        "vec_score": f"SELECT vec_id, round(1 / (1 + {_DIST}), 9) AS score FROM embeddings e",
        "vector_normalize": """WITH w AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE * 3) AS v FROM embeddings),
u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM w)
SELECT vec_id, round(u[1], 9) AS first, round(list_sum(list_transform(u, lambda y: y * y)), 9) AS square FROM u""",
        "vector_nonfinite_guard": "SELECT vec_id, vec_id % 10 <> 0 AS ok FROM embeddings",
        "hybrid_fts_vec": _fts_vec_sql(f"WITH {_CHUNKS}, {_bm25(literal, _any(_TERMS))}, top AS (SELECT * FROM ranked WHERE hit ORDER BY fts_rank, chunk_id LIMIT 50)", "fts_rank, chunk_id"),
        "hybrid_vec_fts": _vec_fts_sql(f"WITH {_CHUNKS}, {_bm25(literal, _any(_TERMS))}", "SELECT chunk_id, fts_rank FROM ranked WHERE hit"),
        "hybrid_short_query_fts_vec": _fts_vec_sql(f"{with_chunks}, top AS (SELECT chunk_id, doc_id, length(text) AS n, NULL::DOUBLE AS fts_rank FROM chunks WHERE {like} ORDER BY n, chunk_id LIMIT 50)", "n, chunk_id"),
        "hybrid_short_query_vec_fts": _vec_fts_sql(with_chunks, f"SELECT chunk_id, -1.0 AS fts_rank FROM chunks WHERE {like}"),
        "multi_index_merge": _multi_sql(),
        "files_list": f"WITH {_FILES} SELECT path, root_path, relative_path, size, mtime_ns, content_hash FROM files",
        "roots_summary": f"""WITH {_CHUNKS}, {_FILES} SELECT root_path, count(DISTINCT f.path) AS files, count(c.chunk_id) AS chunks FROM files f
LEFT JOIN chunks c ON c.doc_id = f.doc_id GROUP BY root_path""",
        "index_info": f"WITH {_CHUNKS}, {_FILES} SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM chunks) AS chunks",
        "remove_missing": f"WITH {_FILES} SELECT path FROM previous WHERE path NOT IN (SELECT path FROM files)",
        "changed_files": f"WITH {_FILES}, {_CHANGED} SELECT path, content_hash FROM changed",
        "changed_by_stat": f"""WITH {_FILES} SELECT path, size, mtime_ns FROM files f WHERE NOT EXISTS (SELECT 1 FROM previous p WHERE p.path = f.path AND p.root_path = f.root_path
  AND p.relative_path = f.relative_path AND p.size = f.size AND p.mtime_ns - CASE WHEN f.doc_id % 13 = 4 THEN 1 ELSE 0 END = f.mtime_ns)""",
        "index_segments": f"""WITH current AS (SELECT * REPLACE (CASE WHEN doc_id % 7 = 2 THEN 'New ' || text ELSE text END AS text) FROM documents WHERE doc_id % 5 <> 1),
{_CHUNKS.replace("FROM documents", "FROM current")}, {_FILES} SELECT path, chunk_index, start_offset, end_offset, text FROM chunks JOIN files USING (doc_id)""",
        "index_stats": f"""WITH {_CHUNKS}, {_FILES}, {_CHANGED} SELECT (SELECT count(*) FROM files) AS scanned, (SELECT count(*) FROM changed) AS indexed,
  (SELECT count(*) FROM previous WHERE path NOT IN (SELECT path FROM files)) AS removed,
  (SELECT count(*) FROM chunks c JOIN files f ON f.doc_id = c.doc_id JOIN changed g ON g.path = f.path) AS chunks,
  (SELECT count(*) FROM files) - (SELECT count(*) FROM changed) AS unchanged""",
        "metadata_upsert": """WITH new AS (SELECT n_name || CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE '+' END AS key, 'new' AS value FROM nation WHERE n_nationkey % 3 = 0)
SELECT n_name AS key, n_regionkey::VARCHAR AS value FROM nation WHERE n_name NOT IN (SELECT key FROM new) UNION ALL SELECT key, value FROM new""",
        "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
        "ext_filter_exclude": """SELECT page_id, path FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '.md' WHEN 1 THEN '.log' ELSE '.rst' END AS path FROM pages)
WHERE (path LIKE '%.md' OR path LIKE '%.rst') AND NOT regexp_matches(path, '[02468][.]')""",
        "session_turns": f"WITH {_SESSIONS} SELECT session_id, cwd, role, text, timestamp, turn_id, session_path, line_no FROM said",
        "snippet": """SELECT doc_id, CASE WHEN length(f) > 160 THEN substr(f, 1, 157) || '...' ELSE f END AS snippet
FROM (SELECT doc_id, trim(regexp_replace(chr(160) || CASE WHEN doc_id % 5 = 1 THEN replace(text, ' ', chr(12288)) ELSE text END, '[WHITE]+', ' ', 'g'), ' ') AS f FROM documents)""".replace("WHITE", tx.WHITE),
        "prefix_passage": _prefix_sql(),
        "bench_summary": """SELECT l_returnflag AS name, round(avg(l_quantity::DOUBLE), 6) AS mean, round(median(l_quantity::DOUBLE), 6) AS median, round(min(l_quantity::DOUBLE), 6) AS min,
  round(max(l_quantity::DOUBLE), 6) AS max, round(4.0 / avg(l_quantity::DOUBLE), 6) AS vectors_per_second, round(avg(l_extendedprice::DOUBLE) / avg(l_quantity::DOUBLE), 6) AS chars_per_second FROM lineitem GROUP BY 1""",
    }


def _prefix_sql() -> str:
    heads = (
        ("query: ", "passage: "), ("検索クエリ: ", "検索文書: "), ("Instruct: Given a web search query, retrieve relevant passages that answer the query\nQuery:", ""), ("", ""),
        ("query: ", "passage: "), ("task: 質問を与えるので、その質問に答えるのに役立つ関連文書を検索してください。\nquery: ", "text: "), ("", ""), ("query: ", "passage: "),
    )
    rows = ", ".join(f"('{m}', '{q}', '{p}')" for m, (q, p) in zip(MODELS, heads, strict=True))
    return f"SELECT item_id, model, p || text AS passage, q || text AS query FROM benchmark, (VALUES {rows}) AS known(model, q, p)"


_PACKED = """WITH RECURSIVE turns AS (SELECT conv_id, turn, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
  lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS closing FROM conversations),
whole AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM turns GROUP BY conv_id),
para AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, text, pos, length(text) AS len, pos + length(text) + CASE WHEN closing THEN 0 ELSE 1 END AS stop FROM turns WHERE text <> ''),
summed AS (SELECT *, sum(len) OVER (PARTITION BY conv_id ORDER BY i)::BIGINT AS upto, count(*) OVER (PARTITION BY conv_id) AS total FROM para),
walk(conv_id, i, held, lo, hi) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM para
  UNION ALL
  SELECT w.conv_id, p.i,
    CASE WHEN p.len > 600 THEN NULL WHEN w.held IS NULL THEN p.i WHEN p.upto - s.upto + s.len + 2 * (p.i - w.held) <= 600 THEN w.held WHEN q.len + 2 + p.len <= 600 THEN w.i ELSE p.i END,
    CASE WHEN p.len > 600 OR p.upto - s.upto + s.len + 2 * (p.i - w.held) > 600 THEN w.held END,
    CASE WHEN w.held IS NOT NULL AND (p.len > 600 OR p.upto - s.upto + s.len + 2 * (p.i - w.held) > 600) THEN w.i END
  FROM walk w JOIN summed p ON p.conv_id = w.conv_id AND p.i = w.i + 1
  LEFT JOIN summed q ON q.conv_id = w.conv_id AND q.i = w.i LEFT JOIN summed s ON s.conv_id = w.conv_id AND s.i = w.held),
runs AS (SELECT conv_id, i, 0 AS kind, lo, hi FROM walk WHERE hi IS NOT NULL
  UNION ALL SELECT w.conv_id, w.i + 1, 0, w.held, w.i FROM walk w JOIN summed p ON p.conv_id = w.conv_id AND p.i = w.i WHERE w.i = p.total AND w.held IS NOT NULL),
packed AS (SELECT r.conv_id, r.i, r.kind, 0 AS k, min(p.pos) AS a, max(p.stop) AS b, string_agg(p.text, chr(10) || chr(10) ORDER BY p.i) AS text
  FROM runs r JOIN summed p ON p.conv_id = r.conv_id AND p.i BETWEEN r.lo AND r.hi GROUP BY r.conv_id, r.i, r.kind),
spans AS (SELECT *, unnest(range(0, 1 + ceil((len - 600) / 480.0)::BIGINT)) AS k FROM summed WHERE len > 600),
wide AS (SELECT conv_id, i, 1 AS kind, k, pos + k * 480 AS a, pos + least(k * 480 + 600, len) AS b, substr(text, k * 480 + 1, 600) AS text FROM spans),
parts AS (SELECT * FROM packed UNION ALL SELECT * FROM wide)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY i, kind, k) - 1)::INT AS chunk_index, a::INT AS start_offset, b::INT AS end_offset,
  (length(substr(body, 1, a)) - length(replace(substr(body, 1, a), chr(10), '')) + 1)::INT AS start_line,
  (length(substr(body, 1, greatest(a, b - 1))) - length(replace(substr(body, 1, greatest(a, b - 1)), chr(10), '')) + 1)::INT AS end_line, text
FROM parts JOIN whole USING (conv_id)"""


def _near_condition(a: str, b: str, n: int) -> str:
    """Instances of two phrases at most ``n`` trigram positions apart."""
    return f"len(list_filter({_SEQUENCE(a)}, lambda p: len(list_filter({_SEQUENCE(b)}, lambda q: greatest(q - p - {len(a) - 2}, p - q - {len(b) - 2}) <= {n})) > 0))"


def _near_sql(a: str, b: str, n: int, first: str) -> str:
    second = _near_condition(b, a, n)
    made = _bm25([(a, "true"), (b, "true")], f"contains(t, '{a}') AND contains(t, '{b}') AND {first} > 0")
    for i, (p, count) in enumerate(((a, first), (b, second))):
        made = made.replace(_occurrences(p), f"(CASE WHEN {first} > 0 THEN {count} ELSE 0 END)")
    return f"WITH {_CHUNKS}, {made} SELECT chunk_id, round(-fts_rank, 9) AS score FROM ranked WHERE hit ORDER BY fts_rank, chunk_id LIMIT 10"


def queries() -> dict[str, Query]:
    plain = [
        chunk_long_paragraph, chunk_line_numbers, chunk_paragraph_pack, chunk_markdown, trigram_postings, trigram_df, corpus_stats, fts_literal_topk, fts_scan_topk,
        like_fallback_topk, vec_knn_topk, vec_score, vector_normalize, vector_nonfinite_guard, multi_index_merge, files_list, roots_summary, index_info,
        remove_missing, changed_files, changed_by_stat, index_segments, index_stats, metadata_upsert, content_hash, ext_filter_exclude, session_turns, session_chunks, snippet, prefix_passage,
        bench_summary,
    ]
    found: dict[str, Query] = {f.__name__: f for f in plain}
    found |= {f"fts_pattern_{name}": _pattern(name) for name in PATTERNS}
    found |= {
        "hybrid_fts_vec": _hybrid("fts-vec", LITERAL), "hybrid_vec_fts": _hybrid("vec-fts", LITERAL),
        "hybrid_short_query_fts_vec": _hybrid("fts-vec", SHORT), "hybrid_short_query_vec_fts": _hybrid("vec-fts", SHORT),
    }
    return found
