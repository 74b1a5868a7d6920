"""The pipeline against its stages' brute-force rules, and what it leaves alone."""

from __future__ import annotations

import random

import corpus_pipeline
from pyspark.sql import functions as F

from lodestone.llm._shared import materialize

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    parts = {"en": ["the", "ing", "tion", "of"], "de": ["sch", "ung", "der", "ein"]}

    def prose(lang, n):
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(2, 5))) for _ in range(n))

    rows = []
    for k in range(120):
        lang = "de" if k % 3 == 0 else "en"
        rows.append([k, prose(lang, rng.randint(60, 150)), lang, f"s{k % 4}"])
    passage = prose("en", 70)
    for k in (10, 20, 30):
        rows[k][1] = f"{rows[k][1]}\n{passage}\nlast line {k}"
    rows += [[200, rows[1][1], "en", "s0"], [201, rows[2][1] + " more", "en", "s1"], [202, "1234 !!", "en", "s2"], [203, None, "en", "s3"], [204, "", None, None]]
    return [(r[0], r[1], r[2], r[3], len(r[1] or "")) for r in rows], passage


def test_stages(spark):
    rows, passage = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        if name != "packing":
            assert out.columns == docs.columns
        docs = materialize(out, f"test-{name}") if name != "packing" else out
        seen[name] = docs.collect()
    assert {r.doc_id for r in seen["language_id"]} == {r[0] for r in rows} - {202, 203, 204}
    lines = {r.doc_id: r for r in seen["line_dedup"]}
    assert set(lines) == {r[0] for r in rows} - {200, 202, 203, 204}
    assert passage in lines[10].text and passage not in lines[20].text and passage not in lines[30].text
    assert lines[20].text.endswith("last line 20") and lines[20].n_chars == len(lines[20].text)
    near = {r.doc_id for r in seen["minhash"]}
    assert near == set(lines) - {201}
    assert {r.doc_id for r in seen["mixing"]} <= near and max(seen["mixing"].count(r) for r in seen["mixing"]) <= 2
    assert sum(p.start == 0 for p in seen["packing"]) == len(seen["mixing"])


def test_run_and_an_empty_table(spark, tmp_path):
    rows, _ = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "a/documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path / "a")).agg(F.count("*"), F.max("sequence_id")).first()
    assert found[0] > 100
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "b/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_registration():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
