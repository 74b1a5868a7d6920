"""SpotSigs: fingerprints from chains of content words that follow common-word anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm._shared import join_counted, materialize, row_key
from lodestone.llm.textarrays import distinct, mix, slices, text_bytes, words

U64 = np.uint64

#: Common words of English, French, German and Spanish that anchor a chain.
ANCHORS = (
    "a an and are as at be but by for from had has have he in is it its not of on or she that the their there they "
    "this to was were which will with "
    "au aux ce ces dans de des du elle en est et il la le les lui mais ne nous ou par pas pour qui que se son sur un une "
    "auf aus bei das dem den der die ein eine einen er es ich im ist mit nicht oder sich sie sind und von war wie zu zum "
    "al como con del el ella ese esta este las lo los más no para pero por su sus una uno y"
).split()

#: A text with fewer anchored spots is filled up to about so many by word pairs from its whole length.
_FEW = 16

_WORD_BYTES = np.zeros(256, bool)
_WORD_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _hash_words(texts: list[str]) -> np.ndarray:
    data, offsets = text_bytes(pa.array(texts))
    return words(data, offsets, word_bytes=_WORD_BYTES).hashes


_ANCHOR_HASHES = np.sort(_hash_words(ANCHORS))


def _spots(hashes: np.ndarray, anchor: np.ndarray, chain: int) -> np.ndarray:
    """Distinct 32-bit spot signatures of one text's words."""
    if not len(hashes):
        return np.zeros(0, np.uint32)
    content = np.flatnonzero(~anchor)
    anchors = np.flatnonzero(anchor)
    first = np.searchsorted(content, anchors)
    full = first + chain <= len(content)
    anchors, first = anchors[full], first[full]
    out = hashes[anchors]
    for k in range(chain):
        out = mix(out * U64(0x2545F4914F6CDD1D) + hashes[content[first + k]])
    # the head of the text anchors a chain too, so a text of any words has a spot
    head = U64(len(ANCHORS))
    lead = mix(np.array([head]))
    for h in hashes[content[:chain] if len(content) else anchors[:chain] if len(anchors) else slice(0, chain)]:
        lead = mix(lead * U64(0x2545F4914F6CDD1D) + h)
    spots = distinct((np.append(out, lead) >> U64(32)).astype(np.uint32))
    if len(spots) >= _FEW or len(hashes) < 2:
        return spots
    # the pairs of least hash: texts that differ little in their number of spots or words draw mostly the same ones
    pairs = distinct(mix(mix(hashes[:-1] + U64(1)) * U64(0x2545F4914F6CDD1D) + hashes[1:]))
    lacking = _FEW - len(spots)
    if lacking < len(pairs):
        pairs = pairs[pairs < U64((lacking << 64) // len(pairs))]
    return distinct(np.append(spots, (mix(pairs) >> U64(32)).astype(np.uint32)))


def spot_sets(texts: pa.Array, chain: int) -> list[np.ndarray]:
    """Spot signatures of every text; one without words has its whole bytes as its spot, an empty one has none."""
    data, offsets = text_bytes(texts)
    out = []
    for begin, end in slices(offsets):
        part = offsets[begin : end + 1]
        w = words(data[part[0] : part[-1]], part - part[0], word_bytes=_WORD_BYTES)
        at = np.minimum(np.searchsorted(_ANCHOR_HASHES, w.hashes), len(_ANCHOR_HASHES) - 1)
        anchor = _ANCHOR_HASHES[at] == w.hashes
        for r in range(end - begin):
            here = slice(w.first[r], w.first[r + 1])
            spots = _spots(w.hashes[here], anchor[here], chain)
            if not len(spots) and part[r + 1] > part[r]:
                digest = hashlib.sha256(data[part[r] : part[r + 1]]).digest()
                spots = np.frombuffer(digest[:4], np.uint32)
            out.append(spots)
    return out


def as_text(spots: np.ndarray) -> str:
    """A fingerprint: its spots in ascending order, eight hexadecimal digits each."""
    return spots.astype(">u4").tobytes().hex()


def pruned_jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets, or 0 without a look at them if lengths put it below ``least``.

    Two empty sets are alike (1); an empty and another set are not (0).
    """
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 1.0
    if len(a) < least * len(b):
        return 0.0
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common / (len(a) + len(b) - common)


def _dealer(bounds: list[int]):
    """Bucket of each id among the sorted bounds, and whether the id is a bound itself: one lookup a row, however many there are."""
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("bucket int, edge boolean")
    def deal(order: pd.Series) -> pd.DataFrame:
        ids = order.to_numpy()
        bucket = np.searchsorted(edges, ids, "left")
        found = edges[np.minimum(bucket, len(edges) - 1)] == ids if len(edges) else np.zeros(len(ids), bool)
        return pd.DataFrame({"bucket": bucket + found, "edge": found})

    return deal


def in_order_with_next(docs: DataFrame, parts: int | None) -> DataFrame:
    """Rows dealt by ranges of doc_id into buckets, each closed by the first row of the next.

    Columns: bucket, look (1 on a closing row), order, tie, doc_id, text. The
    last bucket is closed by the first row of all. Borders are ``parts``
    quantiles of the ids, which are ids themselves, so a border's rows close
    the bucket before it. Texts are shuffled once. Without ``parts`` there is
    one for every 64 MB of text, up to 65,536, and the session's number of
    shuffle partitions at least.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63)).cast("long")).alias("order"))
    if parts is None:
        size = keyed.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(65536, -(-size // (64 << 20))))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    found = keyed.agg(F.percentile_approx("order", shares, F.lit(min(20 * parts, 1 << 20))).alias("q"), F.min("order").alias("least")).first()
    least, bounds = found["least"], sorted(set(found["q"] or ()))
    dealt = keyed.withColumn("at", _dealer(bounds)("order"))
    places = F.array(
        F.struct(F.col("at.bucket").alias("bucket"), F.lit(0).alias("look")),
        F.when(F.col("at.edge"), F.struct((F.col("at.bucket") - 1).alias("bucket"), F.lit(1).alias("look"))),
        F.when(F.col("order") == F.lit(least), F.struct(F.lit(len(bounds)).alias("bucket"), F.lit(1).alias("look"))),
    )
    dealt = dealt.withColumn("place", F.explode(F.filter(places, lambda p: p.isNotNull())))
    rows = dealt.select("place.bucket", "place.look", "order", F.xxhash64("text").alias("tie"), "doc_id", "text")
    return rows.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket", "look", "order", "tie")


def _reader(chain: int, most: int):
    def rows_of(held: list, following) -> pa.RecordBatch:
        ids, texts = [h[0] for h in held], [h[1] for h in held] + [following[1]]
        edited = []
        for text, other in zip(texts[:-1], texts[1:], strict=True):
            k = len(text) // 4
            edited.append(text[: len(text) - k] + other[:k])
        own = spot_sets(pa.array(texts, pa.large_string()), chain)
        new = spot_sets(pa.array(edited, pa.large_string()), chain)
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array([as_text(s) for s in own[:-1]]),
                pa.array([as_text(s) for s in new]),
                pa.array([pruned_jaccard(own[r], new[r]) for r in range(n)]),
                pa.array([pruned_jaccard(own[r], own[r + 1]) for r in range(n)]),
                pa.array([len(s) for s in own[:-1]], pa.int64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_spots"],
        )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            looks = batch.column("look").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            for r, look in enumerate(looks):
                row = (ids[r], batch.column("text")[r].as_py())
                if look:
                    if held:
                        yield rows_of(held, row)
                    held, size = [], 0
                    continue
                if size > most:
                    yield rows_of(held, row)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])

    return read


def fingerprints(docs: DataFrame, chain: int = 2, parts: int | None = None) -> DataFrame:
    """Fingerprint each text and its edited text, and compare them and the next document's.

    A spot is an anchor (a common word of ``ANCHORS``) with the ``chain``
    content words after it; the head of a text is an anchor too. Where that
    makes fewer than 16 spots, pairs of adjacent words from anywhere in the
    text, drawn by their hash, fill them up to about 16 (all pairs if the
    text has no more), as short texts hold few common words. Words are
    runs of letters and digits of ASCII and of all other characters, A to Z
    folded. A fingerprint is the set of 32-bit spots, written in order, so
    equal texts have equal fingerprints; likeness is the Jaccard similarity.
    The edited text has its last floor(n / 4) code points replaced by the
    first as many of the next document in ascending doc_id (after the last:
    the first).

    A null text is empty; an empty text has an empty fingerprint, alike only
    to empty ones; a text without words has one spot for its bytes. Null ids
    come before all others; rows with one id are ordered by a hash of their
    text, and of equal rows each is the other's next. A table of one row has
    itself as the next. Further columns are not read; an empty table gives
    an empty result.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next and n_spots.
    """
    return in_order_with_next(docs, parts).select("look", "doc_id", "text").mapInArrow(
        _reader(chain, 2 << 20),
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_spots long",
    )


def _length_bounds(least: float) -> list[int]:
    """Least lengths of the partitions: sets as alike as ``least`` are of one partition or of neighbouring ones."""
    bounds = [1]
    while bounds[-1] < 1 << 31:
        bounds.append(max(int(bounds[-1] / least) + 1, bounds[-1] * 21 // 20))
    return bounds


def _alike(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [[np.frombuffer(bytes.fromhex(p.as_py()), ">u4").astype(np.uint32) for p in batch.column(c)] for c in ("left", "right")]
            likeness = pa.array([pruned_jaccard(a, b, least) for a, b in zip(*sides, strict=True)], pa.float64())
            found = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("near_id"), likeness], ["doc_id", "near_id", "likeness"])
            yield found.filter(pa.array(likeness.to_numpy() >= least))

    return compare


def near_pairs(prints: DataFrame, least: float = 0.5) -> DataFrame:
    """All pairs of documents whose fingerprints have a Jaccard similarity of ``least`` (above 0, at most 1) or more.

    ``prints`` has doc_id and a fingerprint as of ``fingerprints``. Sets are
    partitioned by length, so that a set meets those of its own partition
    and of the next; within it two sets meet if they share one of their
    rarest spots, of which alike sets must share one, and if their lengths
    allow the likeness. Those that meet are compared in full, so no pair is
    lost and none is wrong.

    Documents of one fingerprint are a group, under its least doc_id: each
    other id of it makes one row with that id (likeness 1), and groups that
    are alike make one row of their least ids, not one for each two members.
    Empty fingerprints are a group of their own, a null fingerprint makes no
    row, and null ids count only in a group that has no other. An empty
    table gives an empty result.

    Returns doc_id, near_id and likeness.
    """
    rows = prints.where(F.col("fingerprint").isNotNull()).select("doc_id", "fingerprint", *row_key("fingerprint"))
    key = ["_k1", "_k2"]
    rows = materialize(rows, "prints")
    sets = rows.groupBy(*key).agg(F.min("doc_id").alias("least_id"), F.min("fingerprint").alias("print"))
    sets = materialize(sets.withColumn("n", (F.length("print") / 8).cast("int")), "sets")
    copies = rows.select(*key, "doc_id").distinct().join(sets.select(*key, "least_id"), key).where("doc_id != least_id")
    spots = sets.select(*key, "n", F.explode(F.regexp_extract_all("print", F.lit(".{8}"), F.lit(0))).alias("spot"))
    # a spot that very many sets have is not one task's
    counts = materialize(spots.groupBy("spot").agg(F.count("*").alias("often")).withColumn("rows", F.col("often")), "spot-counts")
    ranked = join_counted(spots, counts, ["spot"], "rows")
    ranked = ranked.groupBy(*key, "n").agg(F.array_sort(F.collect_list(F.struct("often", "spot"))).alias("ranked"))
    first = F.slice("ranked", F.lit(1), F.col("n") - F.ceil(F.col("n") * least - 1e-6).cast("int") + 1)
    bounds = F.array(*map(F.lit, _length_bounds(least)))
    partition = F.size(F.filter(bounds, lambda b: b <= F.col("n")))
    first = materialize(ranked.select(*key, "n", partition.alias("part"), F.explode(first).alias("s")).select(*key, "n", "part", "s.spot"), "rarest")
    a = first.withColumn("part", F.explode(F.array("part", F.col("part") + 1))).alias("a")
    order = F.struct("a.n", "a._k1", "a._k2") < F.struct("b.n", "b._k1", "b._k2")
    allowed = F.col("a.n") >= F.col("b.n") * least - 1e-6
    met = a.join(first.alias("b"), (F.col("a.spot") == F.col("b.spot")) & (F.col("a.part") == F.col("b.part")) & order & allowed)
    met = met.select(*(F.col(f"{t}.{k}").alias(f"{t}{k}") for t in "ab" for k in key)).distinct()
    for t, name, ids in (("a", "left", "doc_id"), ("b", "right", "near_id")):
        met = met.join(sets.select(*(F.col(k).alias(f"{t}{k}") for k in key), F.col("print").alias(name), F.col("least_id").alias(ids)), [f"{t}{k}" for k in key])
    near = met.select("doc_id", "near_id", "left", "right").mapInArrow(_alike(least), "doc_id long, near_id long, likeness double")
    swap = F.coalesce(F.col("doc_id") > F.col("near_id"), F.lit(False))
    lower, higher = F.when(swap, F.col("near_id")).otherwise(F.col("doc_id")), F.when(swap, F.col("doc_id")).otherwise(F.col("near_id"))
    near = near.select(lower.alias("doc_id"), higher.alias("near_id"), "likeness")
    return near.unionByName(copies.select(F.col("least_id").alias("doc_id"), F.col("doc_id").alias("near_id"), F.lit(1.0).alias("likeness")))
