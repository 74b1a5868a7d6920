"""Near duplicates, repeated lines and fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import linededup, minhash, spotsigs
from lodestone.llm.components import components
from lodestone.llm.textarrays import shingle_sets, text_bytes

WORD = "[^\x20\x09-\x0d]+"


def shingles(text, size):
    words = re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def groups(rows, size):
    """Least id reachable over all pairs at 0.8; nodes are sets."""
    sets = sorted({(r.doc_id, frozenset(shingles(r.text, size))) for r in rows}, key=lambda s: (s[0] is None, s[0] or 0))
    distinct = list({s for _, s in sets if s})
    parent = {s: s for s in distinct}

    def find(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            common = len(a & b)
            if 100 * common >= 80 * (len(a) + len(b) - common):
                parent[find(a)] = find(b)
    least = {}
    for doc_id, s in sets:
        if s and doc_id is not None:
            least[find(s)] = min(doc_id, least.get(find(s), doc_id))
    return {(d, s): (least.get(find(s)) if s else d) for d, s in sets}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(docs, size):
    rows = docs.select("doc_id", "text").collect()
    want = groups(rows, size)
    got = minhash.near_duplicates(docs, size, with_keys=True).collect()
    expected = sorted(((r.doc_id, len(shingles(r.text, size)), want[(r.doc_id, frozenset(shingles(r.text, size)))]) for r in rows), key=repr)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_crowded_buckets_are_compared_in_blocks(spark):
    """Variants of one text that mostly miss the threshold: many components share their buckets."""
    rng = random.Random(7)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        text = list(base)
        for p in rng.sample(range(120), rng.choice([0, 4, 8, 12, 16])):
            text[p] = f"e{rng.randrange(40)}"
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(docs.collect(), 2)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2, block_items=2000).collect()}
    assert got == {d: c for (d, _), c in want.items()}
    assert len(set(got.values())) > 5


def test_one_of_each_group_stays(docs):
    kept = minhash.drop_near_duplicates(docs.where("doc_id BETWEEN 4 AND 30 AND doc_id != 6"), 2).collect()
    assert 5 in {r.doc_id for r in kept} and len(kept) < 15


def test_no_documents(none):
    assert minhash.near_duplicates(none).count() == 0
    assert linededup.dedup_lines(none).count() == 0
    assert spotsigs.fingerprints(none).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(20)] + [(100, k) for k in range(101, 110)] + [(7, 7), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), **dict.fromkeys(range(100, 110), 100)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shingle_sets_of_any_slice():
    texts = ["a b c", None, "", "x", "É é É é", "A a A a", " lead and trail \n"]
    got = list(shingle_sets(*text_bytes(pa.array(texts).slice(1)), 2))
    assert [len(s) for s in got] == [len(shingles(t, 2)) for t in texts[1:]]


def removed(rows, least):
    """Numbers of the lines that stand in a run of ``least`` words that occurs earlier, over all runs."""
    keys = sorted({(r.doc_id is not None, r.doc_id or 0, r._a, r._b, r.text or "") for r in rows})
    first, runs = {}, []
    for place, key in enumerate(keys):
        lines = key[4].split("\n")
        counts = [len(re.findall(WORD, line)) for line in lines]
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += counts[b]
                if total >= least:
                    run = tuple(lines[a : b + 1])
                    first.setdefault(run, (place, a))
                    runs.append((key, place, a, b, run))
    out = {}
    for key, place, a, b, run in runs:
        if first[run] < (place, a):
            out.setdefault(key[1:], set()).update(range(a, b + 1))
    return out


@pytest.mark.parametrize("least", [1, 30, 50])
def test_line_dedup_equals_brute_force(docs, least):
    from pyspark.sql import functions as F

    from lodestone.llm._shared import row_key

    few = docs.where("doc_id IS NULL OR doc_id > 40 OR doc_id < 4")
    k1, k2 = row_key("doc_id", "text")
    rows = few.select("doc_id", "text", k1.alias("_a"), k2.alias("_b")).collect()
    want = removed([r for r in rows if r.text is not None], least)
    got = linededup.dedup_lines(few.withColumn("extra", F.lit("é")), least).collect()
    assert len(got) == len(rows) and {r.extra for r in got} == {"é"}
    keys = {(r.doc_id, r.text): (r.doc_id or 0, r._a, r._b, r.text or "") for r in rows}
    whole = {k: v for k, v in keys.items()}
    for r in got:
        if r.n_lines == 0:
            assert r.text is None and r.removed_lines == []
    expected = sorted(((k[0], sorted(want.get(v, ()))) for k, v in whole.items()), key=repr)
    assert sorted({(r.doc_id, tuple(r.removed_lines)) for r in got}, key=repr) == sorted({(d, tuple(x)) for d, x in expected}, key=repr)
    texts = {}
    for k, v in whole.items():
        gone = want.get(v, set())
        texts.setdefault(k[0], set()).add(None if k[1] is None else "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in gone))
    assert all(r.text in texts[r.doc_id] for r in got)


def test_fingerprints(docs):
    rows = docs.select("doc_id", "text").collect()
    got = spotsigs.fingerprints(docs, parts=5).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.doc_id, []).append(r.text or "")
    ids = sorted(by_text, key=lambda d: (d is not None, d or 0))
    for r in got:
        if r.doc_id in (6, None, 70) or len(by_text[r.doc_id]) > 1:
            continue
        after = ids[(ids.index(r.doc_id) + 1) % len(ids)]
        text = by_text[r.doc_id][0]
        k = len(text) // 4
        options = {hashlib.sha256((text[: len(text) - k] + other[:k]).encode()).hexdigest() for other in by_text[after]}
        assert r.edited_sha256 in options and r.n_chars == len(text)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert next(r for r in got if r.doc_id == 5).near_next == 1.0
    assert {r.fingerprint for r in got if r.doc_id in (5, 6)} == {next(r for r in got if r.doc_id == 5).fingerprint}
    assert {r.fingerprint for r in got if r.doc_id in (1, 2)} == {""}
    assert all(r.near_edited > 0.3 for r in got if r.n_chars > 200)


def test_pruned_jaccard():
    a, b = np.array([1, 2, 3], np.uint32), np.array([2, 3, 4, 5, 6, 7, 8], np.uint32)
    assert spotsigs.pruned_jaccard(a, b) == 2 / 8 and spotsigs.pruned_jaccard(a, b, 0.5) == 0.0
    assert spotsigs.pruned_jaccard(a[:0], b) == 0.0 and spotsigs.pruned_jaccard(a[:0], b[:0]) == 1.0


def mixed_words(seed, n):
    """Words of which about two fifths are anchors."""
    rng = random.Random(seed)
    return [rng.choice(spotsigs.ANCHORS) if rng.random() < 0.4 else f"c{rng.randrange(10**6)}" for _ in range(n)]


def test_fingerprints_read_the_whole_text_alike():
    """The head of a text weighs as much as any other part, with common words and without them."""
    like = lambda *texts: spotsigs.pruned_jaccard(*spotsigs.spot_sets(pa.array([" ".join(t) for t in texts]), 2))
    for n in (200, 240, 280, 320):
        heads, bodies = [mixed_words(k, 64) for k in (1, 2)], [mixed_words(k, n) for k in (3, 4)]
        assert like(heads[0] + bodies[0], heads[1] + bodies[0]) > 0.5
        assert like(heads[0] + bodies[0], heads[0] + bodies[1]) < 0.25
    for texts in ([mixed_words(k, 400) for k in range(40)], [[f"x{k}y{p}" for p in range(400)] for k in range(40)]):
        quarters = [[like(t, t[:a] + [f"z{k}w{p}" for p in range(100)] + t[a + 100 :]) for k, t in enumerate(texts)] for a in (0, 100, 200, 300)]
        assert all(0.5 < np.mean(q) < 0.8 for q in quarters), [np.mean(q) for q in quarters]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_near_pairs_equal_brute_force(spark, docs, none, least):
    """Near copies that are far apart by id, sets of one and of many spots, copies, empty sets and null ids."""
    rng = random.Random(3)
    rows = [(r.doc_id, r.fingerprint) for r in spotsigs.fingerprints(docs.where("doc_id IS NOT NULL OR text != 'one'")).select("doc_id", "fingerprint").collect()]
    for k in range(60):
        base = random.Random(k % 7).sample(range(400), (1, 3, 10, 20, 40, 90, 91)[k % 7])
        kept = [s for s in base if rng.random() < rng.choice([1, 0.9, 0.7])] + rng.sample(range(400, 500), rng.randrange(1 + len(base) // 2))
        rows.append((1000 + 17 * k % 61, spotsigs.as_text(np.sort(np.array(kept, np.uint32)))))
    rows += [(2000, None), (None, "0000000a"), (None, "0000000a0000000b")]
    groups = {}
    for doc_id, text in rows:
        if text is not None:
            groups.setdefault(text, set()).add(doc_id)
    name = {text: min(ids - {None}, default=None) for text, ids in groups.items()}
    want = [(name[t], d, 1.0) for t, ids in groups.items() for d in ids - {None, name[t]}]
    texts = sorted(groups)
    sets = {t: {t[p : p + 8] for p in range(0, len(t), 8)} for t in texts}
    for i, t in enumerate(texts):
        for u in texts[:i]:
            both = len(sets[t] & sets[u])
            likeness = both / (len(sets[t]) + len(sets[u]) - both)
            if likeness >= least:
                want.append((*sorted((name[t], name[u]), key=lambda d: (d is not None, d or 0)), likeness))
    order = lambda r: tuple((x is not None, x or 0) for x in r)
    pairs = spotsigs.near_pairs(spark.createDataFrame(rows, "doc_id long, fingerprint string"), least).collect()
    got = [(*sorted((r.doc_id, r.near_id), key=lambda d: (d is not None, d or 0)), r.likeness) for r in pairs]
    assert sorted(got, key=order) == sorted(want, key=order) and len(got) > 5
    assert all(r.doc_id < r.near_id for r in pairs if None not in (r.doc_id, r.near_id))
    assert spotsigs.near_pairs(spotsigs.fingerprints(none), least).count() == 0
