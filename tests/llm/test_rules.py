"""Operators against independent statements of their rules: hashing, rates, slots, spots, links and kernel scores."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import struct
import time
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import language_id, linededup, minhash, mixing, oracles, packing, secrets, sharding, spotsigs
from lodestone.llm._shared import HOT_KEYS, join_counted, materialize
from lodestone.llm.queries import vocabulary
from lodestone.llm.textarrays import span_hashes
from lodestone.llm.wordbpe import encoder


def doubling(n: int, first: str = "ab") -> str:
    """The doubling sequence of two letters: polynomial hashes modulo powers of two cannot tell it from its complement."""
    return "".join(first[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048])
def test_doubling_words_stay_apart(spark, n):
    one, two = doubling(n), doubling(n, "ba")
    rows = [(1, one), (2, two), (3, f"{one} {one} x"), (4, f"{two} {two} x"), (5, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    gone = {r.doc_id: r.removed_lines for r in linededup.dedup_lines(docs, 1).collect()}
    assert gone == {1: [], 2: [], 3: [], 4: [], 5: [0]}
    bpe = encoder(vocabulary())
    texts = [one, two, f"{one} {two}", doubling(32), doubling(32, "ba"), f"{doubling(32)} {doubling(32, 'ba')} {doubling(32)}"]
    ids, counts = bpe.encode(pa.array(texts))
    assert [g.tolist() for g in np.split(ids, np.cumsum(counts)[:-1])] == [bpe.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_span_hashes_are_of_the_bytes_alone():
    rng = random.Random(5)
    spans = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 1, 7, 8, 9, 16, 63, 64, 65, 200]))) for _ in range(3000)]
    spans += ["a", "a\0", "a\0\0", "\0", "\0" * 8, "\0" * 9, ""]
    data = np.frombuffer("".join(spans).encode(), np.uint8)
    ends = np.cumsum([len(s) for s in spans])
    hashes = span_hashes(data, ends - [len(s) for s in spans], ends).tolist()
    assert len(set(hashes)) == len(set(spans)) and len(set(zip(spans, hashes, strict=True))) == len(set(spans))


def test_counted_joins_keep_all_rows(spark):
    rows = spark.range(3 * HOT_KEYS).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    values = materialize(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")), "test-values")
    joined = join_counted(rows, values, ["k"])
    assert joined.columns == ["k", "id", "top"] and joined.count() == 3 * HOT_KEYS
    assert joined.where("k = 7").agg(F.countDistinct("id"), F.max("top")).first() == (HOT_KEYS + 1, 3 * HOT_KEYS - 3)


def test_a_line_that_a_third_of_all_lines_are(spark):
    """One very common line between others, against the rule itself: a run of ten words that stands earlier goes."""
    common = "this very common line has seven words"
    rows = [(k, "\n".join([f"own {k} words a b c d e f g", common, f"tail {k % 5} of this", common, common])) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    seen, want = set(), {}
    for k, text in rows:
        lines, gone = text.split("\n"), set()
        for a, b in itertools.combinations(range(len(lines) + 1), 2):
            run = tuple(lines[a:b])
            if sum(len(x.split()) for x in run) >= 10:
                if run in seen:
                    gone |= set(range(a, b))
                seen.add(run)
        want[k] = sorted(gone)
    assert {r.doc_id: r.removed_lines for r in linededup.dedup_lines(docs, 10).collect()} == want


def test_rates_are_the_optimum(spark):
    """Exponential tilts that meet each target, found by bisection here; targets by bisection of the water level."""
    rng = random.Random(9)
    docs = [(k, " ".join(["w"] * int(rng.lognormvariate(3, 1))), rng.choice(["a", "b", "c", "d", None]), ) for k in range(4000)]
    got = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()
    sizes = defaultdict(list)
    for r in got:
        sizes[r.source].append(r.size)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        given = {s: min(2 * sum(sizes[s]), weight[s] * level) for s in order}
        low, high = (level, high) if sum(given.values()) < 1.5 * sum(map(sum, sizes.values())) else (low, level)
    for s in order:
        mine = [r for r in got if r.source == s]
        assert all(math.isclose(r.target, given[s], rel_tol=1e-9) for r in mine)
        low, high = -5.0, 5.0
        for _ in range(200):
            lam = (low + high) / 2
            total = sum(n * min(2.0, math.exp(min(1.0, lam * n))) for n in sizes[s] if n)
            low, high = (lam, high) if total < given[s] else (low, lam)
        if given[s] < 2 * sum(sizes[s]) * (1 - 1e-9):
            assert all(math.isclose(r.rate, min(2.0, math.exp(lam * r.size)) if r.size else 1.0, rel_tol=1e-6) for r in mine)
        assert abs(sum(r.taken for r in mine) - given[s]) <= max(1, min(n for n in sizes[s] if n))
        # documents of one size get copies as even as whole numbers can be
        for size in set(sizes[s]):
            copies = [r.copies for r in mine if r.size == size]
            assert max(copies) - min(copies) <= 1


def test_a_row_that_a_third_of_all_rows_are_is_mixed_in_parts(spark, monkeypatch):
    """Its copies are as many as those of unlike rows of its size would be, in whatever order the rows come."""
    monkeypatch.setattr(mixing, "_BUCKET", 16)
    rows = [(None, "one two three", "s", k) for k in range(400)] + [(k, f"w{k} " * (1 + k % 9), "s" if k % 2 else None, k) for k in range(800)]
    schema = "doc_id long, text string, source string, extra int"
    got = []
    for order in (1, -1):
        docs = spark.createDataFrame(rows[::order], schema).repartition(5 + order)
        planned = mixing.mix(docs).collect()
        assert len(planned) == len(rows)
        same = [r for r in planned if r.doc_id is None]
        goal = {r.source: r.target for r in planned}
        for source, target in goal.items():
            assert abs(sum(r.taken for r in planned if r.source == source) - target) <= 9
        out = mixing.mixed(docs).collect()
        assert len(out) == sum(r.copies for r in planned)
        copies = Counter(r.extra for r in out if r.doc_id is None)
        wanted = sum(r.copies for r in same)
        assert sum(copies.values()) == wanted and set(copies.values()) <= {wanted // 400, wanted // 400 + 1}
        got.append((sorted((r.doc_id, r.copies) for r in planned if r.doc_id is not None), wanted))
    assert got[0] == got[1]


def test_few_sizes_far_apart_still_meet_the_target(spark):
    rng = random.Random(2)
    rows = [(k, "w " * rng.choice([1, 3, 40, 4100, 9000, 30000]), "a" if k % 2 else "b") for k in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        # what no smaller document can take up stays: less than half of the next greater one
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 4100 / 2


def test_no_multiplier_is_an_error(spark):
    cells = spark.createDataFrame([("a", 3, 5), ("a", 9, 2)], "source string, size long, n long")
    with pytest.raises(RuntimeError, match="'a'"):
        mixing._solve(cells, {"a": {"size": 33, "n": 7}}, {"a": 40.0}, 2.0, rounds=1)


def test_slots_by_another_library(spark):
    def slot(doc_id, size):
        seed = 42 if doc_id is None else xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)
        return (lambda h: (h - (1 << 64) if h >> 63 else h) % size)(xxhash.xxh64_intdigest(struct.pack("<i", doc_id is None), seed))

    shards = [f"s{k}" for k in range(5)]
    rows = spark.createDataFrame([(k,) for k in [*range(-50, 200), 2**62, None]], "doc_id long")
    table = sharding.lookup_table(shards, 251)
    for r in sharding.place(rows, shards, size=251).collect():
        assert r.slot == slot(r.doc_id, 251) and r.shard == table[r.slot]


def test_a_row_that_many_rows_are_is_dealt_over_files(spark, tmp_path):
    placed = sharding.place(spark.range(400).select(F.lit(1).cast("long").alias("doc_id"), F.lit("x" * 100).alias("text")), ["a", "b"], size=31)
    sharding.write_shards(placed, str(tmp_path / "few"), file_bytes=8000)
    back = spark.read.parquet(str(tmp_path / "few"))
    files = [r["count"] for r in back.groupBy(F.input_file_name()).count().collect()]
    assert back.count() == 400 and len(files) > 3 and max(files) < 300
    sharding.write_shards(placed.limit(0), str(tmp_path / "none"))


def words_of(text):
    """Runs of ASCII letters and digits and of all other characters above ASCII, A to Z folded."""
    return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def chains(text, chain=2):
    """Anchors with the content words after them, and the head of the text."""
    words = words_of(text)
    content = [i for i, w in enumerate(words) if w not in spotsigs.ANCHORS]
    out = set()
    for i, w in enumerate(words):
        after = [words[j] for j in content if j > i][:chain]
        if w in spotsigs.ANCHORS and len(after) == chain:
            out.add((w, *after))
    return out | {("head", *[words[j] for j in content[:chain]])}


def test_spots_are_anchored_chains():
    rng = random.Random(6)
    vocabulary_ = [*spotsigs.ANCHORS[:40], "Über", "naïve", *(f"c{k}" for k in range(60))]
    texts = [" ".join(rng.choice(vocabulary_) + rng.choice(["", ",", "!", "."]) for _ in range(rng.randint(120, 260))) for _ in range(30)]
    texts += [t[: len(t) // 2] + " " + " ".join(rng.choice(vocabulary_) for _ in range(40)) for t in texts]
    sets = spotsigs.spot_sets(pa.array(texts), 2)
    want = [chains(t) for t in texts]
    assert all(len(w) >= 16 for w in want) and [len(s) for s in sets] == [len(w) for w in want]
    for (a, wa), (b, wb) in itertools.combinations(list(zip(sets, want, strict=True))[::3], 2):
        assert spotsigs.pruned_jaccard(a, b) == pytest.approx(len(wa & wb) / len(wa | wb))


def test_likeness_columns_are_those_of_the_sets(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice([*spotsigs.ANCHORS[:9], *(f"c{k}" for k in range(50))]) for _ in range(200)) for _ in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in spotsigs.fingerprints(docs, parts=3).collect():
        text, after = texts[r.doc_id], texts[(r.doc_id + 1) % 12]
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        for likeness, other in ((r.near_edited, edited), (r.near_next, after)):
            a, b = chains(text), chains(other)
            assert likeness == pytest.approx(len(a & b) / len(a | b))
        assert r.fingerprint == spotsigs.as_text(spotsigs.spot_sets(pa.array([text]), 2)[0])


def test_links_equal_brute_force(spark):
    """Weak parts outside base spans, kept if a complement is within the scope: over random texts."""
    rng, scope = random.Random(12), 40
    pieces = ["user=alice1", "login: bob77", "Ab1xY9" * 7, "password=topsecret1", "AKIA" + "Q" * 16, "0af9" * 8, "https://h.example/p", "secret=" + "Zz9" * 12]
    texts = ["".join(rng.choice(pieces) + " " + ". " * rng.randint(0, 30) for _ in range(rng.randint(1, 12))) for _ in range(150)]
    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), scope=scope).collect()}
    weak = {"linked_id": secrets.WEAK_ID, "linked_secret": secrets.WEAK_SECRET, "linked_endpoint": secrets.ENDPOINT}
    for k, text in enumerate(texts):
        base = [(m.start(), m.end(), "assign") for m in re.finditer(secrets.ASSIGN, text) if len(m[1]) >= 6]
        base += [(m.start(), m.end(), "access") for m in re.finditer(secrets.ACCESS, text) if len(m[0]) >= 20] + [(m.start(), m.end(), "hex") for m in re.finditer(secrets.HEX, text)]
        parts = [(m.start(), m.end(), kind) for kind, pattern in weak.items() for m in re.finditer(pattern, text)]
        parts = [p for p in parts if p[2] != "linked_secret" or all(re.search(c, text[p[0] : p[1]]) for c in ("[A-Z]", "[a-z]", "[0-9]"))]
        parts = [p for p in parts if not any(b[0] < p[1] and p[0] < b[1] for b in base)]
        strong = {"assign", "hex", "linked_secret"}
        near = lambda a, b: b[0] - a[1] <= scope and a[0] - b[1] <= scope
        linked = {p for p in parts if any((q[2] in strong) != (p[2] == "linked_secret") and near(p, q) for q in parts + base)}
        want = {f"{s[2]}:{s[0]}:{s[1]}" for s in [*base, *linked]}
        assert set(got[k].spans.split(",")) - {""} == want, text


def test_secrets_equal_their_sql(spark):
    """Over random texts with parts at all distances, other scripts, tabs and line ends between them."""
    rng = random.Random(31)
    pieces = ["user=alice1", "LOGIN: bob77", "Ab1xY9" * 7, "Ab1xY9" * 7 + "==", "Ab1xY9" * 7 + "===", "x=" + "Zz9_" * 9, "Password = 'topsecret1'", "token:abc", "AKIA" + "Q" * 16, "AKIAQ", "0af9" * 8,
              "https://h.example/p", "xftp://h", "api_key=" + "Zz9" * 12, "\u00e9\U0001f600", "account_name"]
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", "\n", "\t", "\r\n", "", "\x0b"]) + ". " * rng.randint(0, 150) for _ in range(rng.randint(0, 12))) for _ in range(300)]
    docs = pd.DataFrame({"doc_id": range(len(texts) + 1), "text": [*texts, None]})
    got = secrets.scan(spark.createDataFrame(list(docs.itertuples(index=False, name=None)), "doc_id long, text string"), scope=256)
    con = duckdb.connect()
    con.register("documents", docs)
    want = con.sql(oracles.OP6).df()
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want[names].itertuples(index=False, name=None))
    assert (want["n_linked"] > 1).sum() > 50


def test_many_matches_take_about_linear_time(spark):
    seconds = []
    for n in (4000, 64000):
        text = "password=abcdefgh user=alice12 x " * (n // 2)
        began = time.perf_counter()
        found = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
        seconds.append(time.perf_counter() - began)
        assert found.n_assign == n // 2 and found.n_linked == n // 2 and found.spans.endswith(f"linked_id:{len(text) - 15}:{len(text) - 3}")
    assert seconds[1] < 40


def test_rows_without_an_id_are_learned_from(spark):
    rows = [(None, f"{'the thing of' if k % 2 else 'der schung ein'} {k}", "en" if k % 2 else "de") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == ["de", "en"]
    found = language_id.identify(docs.limit(50), model).join(docs.limit(0), "doc_id", "left_anti")
    assert Counter(r.lang_pred for r in found.collect()).keys() <= {"de", "en"}


def test_every_label_is_learned_and_copies_are_one(spark):
    rows = [(4 * k + j, f"{chr(0x3400 + k)}{chr(0x3401 + 7 * k)} {chr(0x3400 + k) * 3}", f"l{k:03d}") for k in range(260) for j in range(4)]
    rows += [(9000, "one and the same row", "rare")] * 3000
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=4)
    assert len(model.languages) == 261 and "rare" in model.languages


def test_a_long_text_is_learned_from_alone(spark):
    rows = [(0, "the thing " * 50000, "en"), (1, "der schung " * 10, "de"), (4, "qui que " * 10, "fr")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_bytes=1000)
    assert model.languages and len(model.languages) <= 3


def test_scores_equal_explicit_kernel_ridge_regression():
    """Kernel values from sets of n-grams, Nyström features and ridge regression written out, against the folded matrix."""
    rng = random.Random(3)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(rng.randint(2, 9)))
    texts = [make(p) for p in (["the", "ing", "of"], ["sch", "ung", "der"], ["eau", "oi", "que"]) for _ in range(6)]
    labels = [x for x in ("en", "de", "fr") for _ in range(6)]
    languages = ["de", "en", "fr"]
    model = language_id.train(texts, labels, languages, 9, 3, 1e-2)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    chosen = [texts[6 * g + turn] for turn in range(3) for g in (1, 0, 2)]
    values, vectors = np.linalg.eigh([[kernel(a, b) for b in chosen] for a in chosen])
    root = vectors[:, values > 1e-6 * values[-1]] / np.sqrt(values[values > 1e-6 * values[-1]])
    features = lambda ts: np.hstack([np.array([[kernel(t, c) for c in chosen] for t in ts]) @ root, np.ones((len(ts), 1))])
    x, y = features(texts), np.array([[1.0 if label == known else -1.0 for known in languages] for label in labels])
    solved = np.linalg.solve(x.T @ x + np.diag([1e-2] * (x.shape[1] - 1) + [1e-9]), x.T @ y)
    asked = [make(["the", "sch", "eau"]) for _ in range(20)]
    want = features(asked) @ solved
    for (language, share, margin), row in zip(model.judge(asked), want, strict=True):
        odds = np.exp(4 * (row - row.max()))
        assert language == languages[int(row.argmax())]
        assert share == pytest.approx(odds.max() / odds.sum(), abs=1e-4) and margin == pytest.approx(row.max() - row.mean(), abs=1e-4)


def test_stages_carry_columns_of_any_name(spark):
    """Clashing names and repeated rows: all stages but the last return the columns they got, with their values."""
    clash = ["score", "lang_pred", "n_lines", "removed_lines", "_k1", "_runs", "_copies", "node", "size", "carried_1", "margin"]
    rng = random.Random(1)
    rows = [(k, " ".join("".join(rng.choice(["the", "ing", "of"]) for _ in range(3)) for _ in range(60)), "en", "s", 0, *[f"{c}-{k}" for c in clash]) for k in range(40)]
    rows += [rows[3]] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in clash))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, ""), f"clash-{name}")
        assert docs.columns[5:] == clash
        found = docs.collect()
        assert found and all(r[5 + i] == f"{c}-{r.doc_id}" for r in found for i, c in enumerate(clash))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert sum(p.start == 0 for p in pieces.collect()) == docs.count()


def test_packing_of_a_word_with_many_forms(spark):
    texts = ["it's It'S IT'S its", "a" * 49, "a" * 48, "don't" * 20]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bpe = encoder(vocabulary())
    found = {p.doc_id: p.ids for p in packing.pack(docs, vocabulary(), 1 << 20, 2).collect()}
    assert found == {k: [*bpe.library.encode(t, add_special_tokens=False).ids, 2] for k, t in enumerate(texts)}


def test_words_of_one_hash_are_told_apart_by_their_bytes(monkeypatch):
    """With a hash that all words share, ids are still the library's."""
    from lodestone.llm import wordbpe

    monkeypatch.setattr(wordbpe, "span_hashes", lambda data, starts, ends: np.full(len(starts), 7, np.uint64))
    bpe = wordbpe.WordBpe(vocabulary())
    texts = ["some words of some texts", "other words, and of other lengths", "some words of some texts", ""]
    for text in texts:
        assert bpe.encode(pa.array([text]))[0].tolist() == bpe.library.encode(text, add_special_tokens=False).ids
    assert len(bpe._seen) == 2


def test_digests_of_sets_name_nodes(spark):
    from lodestone.llm.textarrays import set_digest, shingle_sets, text_bytes

    (items,) = shingle_sets(*text_bytes(pa.array(["some words of a text"])), 2)
    raw = hashlib.blake2b(b"".join(int(x).to_bytes(8, "little") for x in items), digest_size=16).digest()
    assert set_digest(items) == struct.unpack("<2q", raw)
