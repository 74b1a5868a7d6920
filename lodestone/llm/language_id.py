"""Language identification by a blended-spectrum string kernel, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

UNKNOWN = "und"
_BITS = 18
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], bool)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashed runs of ``n`` code points."""
    count = len(codes) - n + 1
    out = np.full(count, n * _MULTIPLIERS[3] & (1 << 64) - 1, np.uint64)
    for k in range(n):
        out += codes[k : k + count]
        out *= np.uint64(_MULTIPLIERS[k % 3] | 1)
        out ^= out >> np.uint64(29)
    return (out >> np.uint64(64 - _BITS)).astype(np.int32)


def presence(texts: list[str | None], longest: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, bool]]:
    """For each text which n-grams of 1 to ``longest`` code points it has, and whether it has a letter.

    Texts are read whole, lower-cased, in blocks of about ``most`` code
    points. The array of marks is used again for the next text.
    """
    mark, letters, row = np.zeros(1 << _BITS, bool), _letters(), 0
    while row < len(texts):
        block, size = [], 0
        while row < len(texts) and (not block or size < most):
            block.append((texts[row] or "").lower())
            size += len(block[-1])
            row += 1
        codes = np.frombuffer("".join(block).encode("utf-32-le", "surrogatepass"), np.uint32)
        wide = codes.astype(np.uint64)
        grams = [_grams(wide, n) if len(wide) >= n else np.zeros(0, np.int32) for n in range(1, longest + 1)]
        has_letter = letters[codes]
        start = 0
        for text in block:
            end = start + len(text)
            for n, ids in enumerate(grams, 1):
                if end - n + 1 > start:
                    mark[ids[start : end - n + 1]] = True
            yield mark, bool(has_letter[start:end].any())
            mark[:] = False
            start = end


@dataclass
class Model:
    """Scores of a text: the sum of ``weights`` over its n-grams, over the root of their number, plus ``bias``."""

    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    longest: int

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """Language and share of the scores of each text."""
        return ((language, share) for language, share, _ in self.judge(texts))

    def judge(self, texts: list[str | None], batch: int = 128) -> Iterator[tuple[str, float, float]]:
        """The same and the margin."""
        x = np.zeros((batch, len(self.grams)), np.float32)
        norms, letters = np.ones(batch), np.zeros(batch, bool)
        row = 0
        for mark, has_letter in presence(texts, self.longest):
            x[row] = mark[self.grams]
            norms[row] = np.sqrt(max(1, np.count_nonzero(mark)))
            letters[row] = has_letter
            row += 1
            if row == batch:
                yield from self._scored(x, norms, letters)
                row = 0
        yield from self._scored(x[:row], norms[:row], letters[:row])

    def scores(self, x: np.ndarray, norms: np.ndarray) -> np.ndarray:
        return (x @ self.weights) / norms[:, None] + self.bias

    def _scored(self, x: np.ndarray, norms: np.ndarray, letters: np.ndarray) -> Iterator[tuple[str, float, float]]:
        if not len(x) or not self.languages:
            yield from [(UNKNOWN, 0.0, 0.0)] * len(x)
            return
        scores = self.scores(x, norms)
        odds = np.exp(4 * (scores - scores.max(axis=1, keepdims=True)))
        best = scores.argmax(axis=1)
        share = odds[np.arange(len(x)), best] / odds.sum(axis=1)
        # a lone language is up against the target of a text that is not of it
        lead = scores.max(axis=1) - (scores.mean(axis=1) if len(self.languages) > 1 else -1.0)
        for r in range(len(x)):
            yield (self.languages[best[r]], float(share[r]), float(lead[r])) if letters[r] else (UNKNOWN, 0.0, 0.0)


def train(texts: list[str], labels: list[str], languages: list[str], landmarks: int, longest: int, ridge: float) -> Model:
    """Fit on labelled texts; the first ones of each language, in turn, become landmarks."""
    rows = [(np.flatnonzero(mark), label) for (mark, letters), label in zip(presence(texts, longest), labels, strict=True) if letters]
    if not rows or not languages:
        return Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros(0), longest)
    turn, order = {}, []
    for i, (_, label) in enumerate(rows):
        turn[label] = turn.get(label, -1) + 1
        order.append((turn[label], label, i))
    chosen = [i for _, _, i in sorted(order)[:landmarks]]
    grams = np.unique(np.concatenate([rows[i][0] for i in chosen]))
    column = np.full(1 << _BITS, len(grams), np.int32)
    column[grams] = np.arange(len(grams))
    marks = np.zeros((len(grams), len(chosen)), np.float32)
    for k, i in enumerate(chosen):
        marks[column[rows[i][0]], k] = 1 / np.sqrt(len(rows[i][0]))
    kernel = np.zeros((len(rows), len(chosen)))
    for i, (found, _) in enumerate(rows):
        at = column[found]
        kernel[i] = marks[at[at < len(grams)]].sum(axis=0, dtype=np.float64) / np.sqrt(len(found))
    values, vectors = np.linalg.eigh(kernel[chosen])
    kept = values > 1e-6 * values[-1]
    nystrom = vectors[:, kept] / np.sqrt(values[kept])
    features = np.hstack([kernel @ nystrom, np.ones((len(rows), 1))])
    target = np.array([[1.0 if label == known else -1.0 for known in languages] for _, label in rows])
    penalty = np.diag(np.append(np.full(features.shape[1] - 1, ridge), 1e-9))
    solved = np.linalg.solve(features.T @ features + penalty, features.T @ target)
    # a text's scores are linear in its presence vector, so the landmarks fold into one matrix
    weights = marks.astype(np.float64) @ (nystrom @ solved[:-1])
    return Model(languages, grams, weights.astype(np.float32), solved[-1], longest)


def fit(
    docs: DataFrame, per_language: int = 300, max_sample: int = 6000, max_bytes: int = 64 << 20, landmarks: int = 256, longest: int = 3, ridge: float = 1e-2
) -> Model:
    """Learn every label of the labelled rows that are not held out, from a bounded sample of whole texts.

    The sample holds up to ``per_language`` texts of each label, those of
    least hash of id and text, fewer where there are so many labels that
    ``max_sample`` in all would be passed; but each label has one at least.
    Of these, in turns of one text a label, come those that begin within the
    first ``max_bytes``, and the first one whatever its size. So at most
    max(max_sample, labels) texts and ``max_bytes`` beside one text reach the
    driver. Rows alike in id, text and label are one. Only doc_id (for the
    split and the draw), text and lang are read. Null ids are learned from;
    texts without a letter teach nothing.
    """
    rows = docs.select("text", "lang", F.xxhash64("doc_id", "text", F.lit("draw")).alias("draw")).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n"), F.min("draw").alias("least")).collect()
    if not counts:
        return train([], [], [], landmarks, longest, ridge)
    each = max(1, min(per_language, max_sample // len(counts)))
    # hashes spread evenly, so about twice the wanted number lie below the cut; the least one always does
    cuts = [(r["lang"], max(r["least"], min((1 << 63) - 1, int(-(1 << 63) + (1 << 64) * min(1.0, 2 * each / max(1, r["n"])))))) for r in counts]
    limits = docs.sparkSession.createDataFrame(cuts, "lang string, cut long")
    near = rows.join(F.broadcast(limits), "lang").where("draw <= cut").dropDuplicates(["lang", "draw"])
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    few = near.select("text", "lang", "draw", turn.alias("turn")).where(F.col("turn") <= each)
    # the sample's rows are few by now, so one task may order them
    before = F.sum(F.octet_length("text").cast("long")).over(Window.orderBy("turn", "draw", "lang").rowsBetween(Window.unboundedPreceding, -1))
    sample = few.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < max_bytes).select("turn", "draw", "text", "lang").toArrow()
    sample = sample.sort_by([("turn", "ascending"), ("draw", "ascending"), ("lang", "ascending")])
    return train(sample.column("text").to_pylist(), sample.column("lang").to_pylist(), sorted(set(sample.column("lang").to_pylist())), landmarks, longest, ridge)


def held_out():
    """Rows kept out of training: crc32 of the id as text, modulo 4, is 2 (a null id is never one)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def _predictor(model, keep_text: bool, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 512):
                part = batch.slice(begin, 512)
                found = list(model.value.judge(part.column("text").to_pylist()))
                kept = [n for n in part.schema.names if keep_text or n != "text"]
                columns = [part.column(n) for n in kept]
                columns += [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.float64())[: len(names)])]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *names])

    return run


def identify(docs: DataFrame, model: Model, keep_text: bool = False, names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """Predict each document's language from its whole text alone.

    The kernel of two texts is the number of n-grams of 1 to ``longest`` code
    points that both have, over the root of the product of how many each has.
    Scores are one-versus-rest ridge regressions in the Nyström space of the
    landmarks, aimed at 1 and -1. ``score`` is the predicted language's share
    of exp(4 * score), which falls as languages are added; ``margin`` is the
    lead over the mean of all, which does not (with one language, over -1).

    ``und`` with score and margin 0 if the text is null or has no letter, or
    if nothing could be learned. Repeated rows get equal results, ties go to
    the first language by code point. Null ids are carried along and never
    held out. An empty table gives an empty result. Returns doc_id, held_out,
    lang_pred and score (and the margin, if ``names`` has a third name), or
    with ``keep_text`` all of ``docs`` and these without held_out; they
    replace columns of their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.drop(*names) if keep_text else docs.select("doc_id", held_out().alias("held_out"), "text")
    kept = [f for f in rows.schema.fields if keep_text or f.name != "text"]
    schema = StructType(kept)
    for name, kind in zip(names, ("string", "double", "double"), strict=False):
        schema = schema.add(name, kind)
    return rows.mapInArrow(_predictor(shared, keep_text, names), schema)
