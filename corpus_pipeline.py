"""A training corpus out of ``documents``: five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language_id, linededup, minhash, mixing, packing
from lodestone.llm._shared import documents_of, materialize, release, written
from lodestone.llm.queries import vocabulary

#: A document is rejected if it has no letters or no language leads the mean of all by this.
LEAST_MARGIN = 0.05
LEAST_WORDS = 50
SHINGLE, PERCENT = 5, 80
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2
WINDOW, END_ID = 4096, 2

#: Columns that stages read or write; all others are carried along under names of the pipeline's own.
CORE = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_scratch: list[str] = []


def _stage(body: Stage) -> Stage:
    """A stage that may be called with any further columns, whatever their names.

    They pass through as they are, even if an operator has columns of the
    same names. The scratch tables of the stage before, whose result has been
    written by now, are deleted.
    """

    @wraps(body)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, [p for p in _scratch if p in written()])
        before = set(written())
        names = [c if c in CORE else f"carried_{i}" for i, c in enumerate(docs.columns)]
        out = body(spark, docs.toDF(*names), sf_dir)
        _scratch[:] = [p for p in written() if p not in before]
        own = dict(zip(names, docs.columns, strict=True))
        return out.toDF(*[own.get(c, c) for c in out.columns])

    return run_stage


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go.

    Null and empty texts and those without a letter go, and so do texts for
    which all languages are all but level, which more languages do not make
    more likely; a tie of two goes to the first and stays. Repeated rows stay or go together. Null
    ids and labels are rows like others. If nothing is labelled, all go. An
    empty table stays empty.
    """
    found = language_id.identify(docs, language_id.fit(docs), keep_text=True, names=("pred_lang", "pred_share", "pred_margin"))
    return found.where((F.col("pred_lang") != language_id.UNKNOWN) & (F.col("pred_margin") >= LEAST_MARGIN)).select(*docs.columns)


@_stage
def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of long line runs go, and with them documents of which nothing is left.

    Of equal runs the first by doc_id, hash and line stays. Repeated rows are
    one document and stay or go together; null and empty texts stay as they
    are, and null ids come first. ``n_chars`` is that of the remaining text.
    An empty table stays empty.
    """
    found = linededup.dedup_lines(docs, LEAST_WORDS)
    left = found.where((F.size("removed_lines") == 0) | (F.size("removed_lines") < F.col("n_lines")))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage
def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of least doc_id.

    Groups are those of five-word shingles at a similarity of 0.8. Null,
    empty and blank texts are groups of their own and stay. Repeated rows are
    one document and stay or go together. An empty table stays empty.
    """
    return minhash.drop_near_duplicates(docs, SHINGLE, PERCENT)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that each source meets its target.

    A null source is one of its own, last in order. Documents without words
    are kept once; repeated rows share their copies evenly; ties go by hash.
    An empty table stays empty.
    """
    return mixing.mixed(docs, WEIGHTS, SHARE, CAP)


@_stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed windows.

    A null or empty text is its end id alone; each repeated row is packed;
    null ids are carried along; further columns are not. No rows make no piece.
    """
    return packing.pack(docs, vocabulary(), WINDOW, END_ID, with_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("minhash", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Kernel scores, suffix ranks and byte-pair ids are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    rows = documents_of(spark, sf_dir)
    kept: list[str] = []
    for name, stage in STAGES[:-1]:
        out, before = stage(spark, rows, sf_dir), set(written())
        rows = materialize(out, f"stage-{name}")
        release(spark, kept)
        kept = [p for p in written() if p not in before]
    return STAGES[-1][1](spark, rows, sf_dir)
