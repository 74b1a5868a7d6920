from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, node long, start int, target double, `offset` long, score double, _k1 long"


def prose(seed: int, words: int) -> list[str]:
    random.seed(seed)
    return ["".join(random.choice(["an", "er", "ti", "lo", "mu", "se", "Ka", "ro"]) for _ in range(random.randint(1, 4))) for _ in range(words)]


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, len(text or ""), -1, -2, -3, -4, -5.0, -6, -7.0, -8)


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, near copies, repeated rows, ties, null ids, and columns with clashing names."""
    base = prose(1, 300)
    rows = [row(1, ""), row(2, None), row(3, " \n\t "), row(4, " ".join(prose(2, 20000))), row(5, " ".join(base)), row(6, " ".join(base)), row(6, " ".join(base))]
    for k in range(7, 27):
        changed = list(base)
        for p in random.Random(k).sample(range(300), 3 + k % 12):
            changed[p] = f"new{k}x{p}"
        rows.append(row(k, " ".join(changed), source=None if k % 5 == 0 else "b"))
    rows += [row(40 + k, " ".join(prose(40 + k, 30 + k)), lang=None if k % 3 else "fr", source="cé") for k in range(12)]
    rows += [row(None, "only a few words"), row(None, "only a few words"), row(60, "one"), row(61, "ONE"), row(62, "!!! ???"), row(63, "퟿\U0001f600 ß İ Σς")]
    lines = [" ".join(prose(90 + k, 20)) for k in range(8)]
    rows += [row(70, "\n".join(lines)), row(71, "\n".join(["own start", *lines[2:6], "own end"])), row(72, "\n".join([*lines[:1], "x", *lines[1:2]])), row(73, "\n".join(lines[:3] * 2)), row(70, "another text of the same id")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
