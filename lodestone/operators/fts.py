"""Trigram full-text search: query language, BM25 and the short-query fallback.

Over bare chunks, statistics of a query's phrases come from one scan and are
a handful of numbers; a second scan scores. Nothing is shuffled but the top
rows. A search of an index reads its posting table instead (``lookup``),
and texts only for phrases that are longer than a trigram. Both count phrases
as arrays, one number a text, and judge and rank these by the same functions.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import contains_ascii

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
MAX_TERMS = 128
NEAR_DISTANCE = 10


class PatternError(ValueError):
    """A pattern that the query language does not have."""


def fold_text(text: str) -> str:
    """Lower case, one code point for one; diacritics stay."""
    if not text.isascii():
        # many times faster than a translation of every character
        text = text.replace("\u0130", "i").replace("\u03a3", "\u03c3")
    return text.lower()


def query_terms(query: str, most: int = MAX_TERMS) -> list[str]:
    """Distinct trigrams of a stripped query in order, before folding; ``most`` at most."""
    query = query.strip()
    return list(dict.fromkeys(query[i : i + 3] for i in range(len(query) - 2)))[:most]


def match_query(query: str) -> str:
    """A literal query as a pattern: its trigrams, quoted and joined by OR."""
    return " OR ".join('"' + t.replace('"', '""') + '"' for t in query_terms(query))


# -- pattern language -----------------------------------------------------------


@dataclass
class Phrase:
    text: str
    anchored: bool = False

    @property
    def grams(self) -> list[str]:
        return [self.text[i : i + 3] for i in range(len(self.text) - 2)]

    @property
    def is_gram(self) -> bool:
        return len(self.text) == 3 and not self.anchored

    def counts(self, texts: list[str]) -> Iterator[int]:
        """Overlapping occurrences in each text."""
        needle = self.text
        if self.anchored:
            return (int(t.startswith(needle)) for t in texts)
        if any(needle[:n] == needle[-n:] for n in range(1, len(needle))):
            return (len(places(t, needle)) for t in texts)
        return (t.count(needle) for t in texts)


def places(text: str, phrase: str) -> list[int]:
    out, at = [], text.find(phrase)
    while at >= 0:
        out.append(at)
        at = text.find(phrase, at + 1)
    return out


@dataclass
class Near:
    phrases: list[Phrase]
    distance: int

    def counts(self, text: str) -> list[int]:
        """For each phrase how many of its instances stand in a group that is near enough.

        A group has an instance of every phrase; with the last begin among
        them at L, each one ends, in trigram positions, at most ``distance``
        before L.
        """
        found = [places(text, p.text) for p in self.phrases]
        reach = [len(p.text) - 2 + self.distance for p in self.phrases]
        part: list[set[int]] = [set() for _ in self.phrases]
        for last in {x for f in found for x in f} if all(found) else ():
            spans = [f[bisect.bisect_left(f, last - r) : bisect.bisect_right(f, last)] for f, r in zip(found, reach, strict=True)]
            if all(spans):
                for mine, span in zip(part, spans, strict=True):
                    mine.update(span)
        return [len(p) for p in part]


@dataclass
class Both:
    parts: list


@dataclass
class Either:
    parts: list


@dataclass
class Without:
    left: object
    right: object


class _Nothing:
    """A phrase without a trigram."""


NOTHING = _Nothing()
_TOKEN = re.compile(r'\s+|"((?:[^"]|"")*)"|([A-Za-z0-9_\x80-\U0010ffff\x1a]+)|([()+*^:,])')


@dataclass
class _Parser:
    pattern: str
    tokens: list = field(default_factory=list)
    at: int = 0

    def __post_init__(self) -> None:
        place = 0
        while place < len(self.pattern):
            m = _TOKEN.match(self.pattern, place)
            if not m:
                raise PatternError(f"syntax error near {self.pattern[place]!r}")
            if m[1] is not None:
                self.tokens.append(("string", m[1].replace('""', '"')))
            elif m[2] is not None:
                self.tokens.append(("word", m[2]))
            elif m[3] is not None:
                self.tokens.append((m[3], m[3]))
            place = m.end()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def take(self, kind: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if kind and token[0] != kind:
            raise PatternError(f"syntax error near {token[1]!r}")
        self.at += 1
        return token

    def is_word(self, *names: str) -> bool:
        return self.peek()[0] == "word" and self.peek()[1] in names

    def whole(self):
        if not self.tokens:
            raise PatternError("empty pattern")
        out = self.either()
        self.take("end")
        return out

    def either(self):
        parts = [self.both()]
        while self.is_word("OR"):
            self.take()
            parts.append(self.both())
        parts = [p for p in parts if p is not NOTHING]
        return NOTHING if not parts else parts[0] if len(parts) == 1 else Either(parts)

    def both(self):
        parts = [self.without()]
        while self.is_word("AND"):
            self.take()
            parts.append(self.without())
        if len(parts) > 1 and any(p is NOTHING for p in parts):
            return NOTHING
        return parts[0] if len(parts) == 1 else Both(parts)

    def without(self):
        left = self.run()
        while self.is_word("NOT"):
            self.take()
            right = self.run()
            if left is not NOTHING and right is not NOTHING:
                left = Without(left, right)
        return left

    def starts_item(self) -> bool:
        kind, _ = self.peek()
        return kind in ("string", "(", "^") or (kind == "word" and not self.is_word("AND", "OR", "NOT"))

    def run(self):
        """Items side by side are all wanted; those without a trigram are passed over."""
        if not self.starts_item():
            raise PatternError(f"syntax error near {self.peek()[1]!r}")
        parts = []
        while self.starts_item():
            parts.append(self.item())
        parts = [p for p in parts if p is not NOTHING]
        return NOTHING if not parts else parts[0] if len(parts) == 1 else Both(parts)

    def item(self):
        if self.peek()[0] == "word" and self.peek(1)[0] == ":":
            column = self.take()[1].lower()
            self.take(":")
            if column not in ("text", "path"):
                raise PatternError(f"no such column: {column}")
            found = self.item()
            return found if column == "text" else NOTHING
        if self.peek()[0] == "(":
            self.take()
            found = self.either()
            self.take(")")
            return found
        if self.is_word("NEAR") and self.peek(1)[0] == "(":
            return self.near()
        return self.phrase()

    def near(self):
        self.take()
        self.take("(")
        phrases, distance = [], NEAR_DISTANCE
        while self.peek()[0] in ("string", "word", "^"):
            phrases.append(self.phrase())
        if self.peek()[0] == ",":
            self.take()
            if not self.peek()[1].isdigit():
                raise PatternError("expected integer after NEAR's comma")
            distance = int(self.take("word")[1])
        self.take(")")
        phrases = [p for p in phrases if p is not NOTHING]
        return NOTHING if not phrases else phrases[0] if len(phrases) == 1 else Near(phrases, distance)

    def phrase(self):
        anchored = False
        if self.peek()[0] == "^":
            self.take()
            anchored = True
        strings = []
        while True:
            kind, text = self.take()
            if kind not in ("string", "word"):
                raise PatternError(f"syntax error near {text!r}")
            strings.append(fold_text(text))
            if self.peek()[0] != "+":
                break
            self.take()
        if self.peek()[0] == "*":
            self.take()
        grams = [s[i : i + 3] for s in strings for i in range(len(s) - 2)]
        if not grams:
            return NOTHING
        if any(a[1:] != b[:2] for a, b in zip(grams, grams[1:], strict=False)):
            return _IMPOSSIBLE
        return Phrase(grams[0] + "".join(g[2] for g in grams[1:]), anchored)


#: A phrase whose trigrams cannot follow each other: it is asked for, and no text has it.
_IMPOSSIBLE = Phrase("￿￿￿")


def parse(pattern: str):
    """Syntax tree of a pattern, or ``NOTHING`` if it cannot match."""
    return _Parser(pattern).whole()


class Seen:
    """Counts of phrases in folded texts, one number a text; each phrase is counted once."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.size = len(texts)
        self._known: dict = {}

    def count(self, phrase: Phrase) -> np.ndarray:
        key = (phrase.text, phrase.anchored)
        if key not in self._known:
            self._known[key] = np.fromiter(phrase.counts(self.texts), float, self.size)
        return self._known[key]

    def near(self, tree: Near) -> np.ndarray:
        """A row a text, a column a phrase."""
        if id(tree) not in self._known:
            self._known[id(tree)] = np.array([tree.counts(t) for t in self.texts], float).reshape(self.size, len(tree.phrases))
        return self._known[id(tree)]


def matches(tree, seen: Seen) -> np.ndarray:
    """Which texts match."""
    if tree is NOTHING:
        return np.zeros(seen.size, bool)
    if isinstance(tree, (Both, Either)):
        join = np.logical_and if isinstance(tree, Both) else np.logical_or
        return join.reduce([matches(part, seen) for part in tree.parts])
    if isinstance(tree, Without):
        return matches(tree.left, seen) & ~matches(tree.right, seen)
    return seen.near(tree)[:, 0] > 0 if isinstance(tree, Near) else seen.count(tree) > 0


def scored_phrases(tree) -> list[Phrase]:
    """Each phrase that can score, once for each time it is asked for."""
    if tree is NOTHING:
        return []
    if isinstance(tree, (Both, Either)):
        return [phrase for part in tree.parts for phrase in scored_phrases(part)]
    if isinstance(tree, Without):
        return scored_phrases(tree.left)
    return tree.phrases if isinstance(tree, Near) else [tree]


def scored_counts(tree, seen: Seen, gate: np.ndarray | bool = True) -> list[np.ndarray]:
    """Counts of the scored phrases in their order, which are 0 where the part a phrase belongs to does not match."""
    if tree is NOTHING:
        return []
    if isinstance(tree, Either):
        return [found for part in tree.parts for found in scored_counts(part, seen, gate)]
    if isinstance(tree, Both):
        gate = gate & matches(tree, seen)
        return [found for part in tree.parts for found in scored_counts(part, seen, gate)]
    if isinstance(tree, Without):
        return scored_counts(tree.left, seen, gate & matches(tree, seen))
    if isinstance(tree, Near):
        return [np.where(gate, found, 0.0) for found in seen.near(tree).T]
    return [np.where(gate, seen.count(tree), 0.0)]


# -- ranking ----------------------------------------------------------------------


def token_count(text: Column) -> Column:
    return F.greatest(F.lit(0), F.length(text) - 2)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: chunks and trigram tokens of the corpus."""
    return chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(token_count(F.col("text"))), F.lit(0)).cast("long").alias("n_tokens"))


def distinct_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """The distinct trigrams of each folded text, by trigram and then text: text, number of the trigram, the trigrams, how often.

    One sort of numbers that hold trigram and text; trigrams are numbered by
    the code points that occur.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    none = np.zeros(0, np.int64)
    if len(codes) < 3:
        return none, none, [], none
    there = np.zeros(int(codes.max()) + 1, bool)
    there[codes] = True
    letters = np.flatnonzero(there)
    n, wide = len(texts), len(letters)
    place = np.zeros(len(there), np.int64)
    place[letters] = np.arange(wide)
    codes = place[codes]
    grams = (codes[:-2] * wide + codes[1:-1]) * wide + codes[2:]
    row = np.repeat(np.arange(n), lengths)[: len(grams)]
    inside = np.arange(len(grams)) + 2 < np.cumsum(lengths)[row]
    grams, row = grams[inside], row[inside]
    if not len(grams):
        return none, none, [], none
    names = None
    if wide**3 * n >= 1 << 63:  # only with some 100,000 different letters
        names, grams = np.unique(grams, return_inverse=True)
    keys = grams * n + row
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    tf = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    grams, row = keys // n, keys % n
    new = np.concatenate([[True], grams[1:] != grams[:-1]])
    known = grams[new] if names is None else names[grams[new]]
    text = letters[np.stack([known // (wide * wide), known // wide % wide, known % wide], axis=1)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return row, np.cumsum(new) - 1, [text[i : i + 3] for i in range(0, len(text), 3)], tf


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts of all texts of a batch at once, in slices that bound the arrays: a row for each trigram of a slice, with its chunks as a list."""
    for whole in batches:
        for begin in range(0, len(whole), 1024):
            batch = whole.slice(begin, 1024)
            row, number, terms, tf = distinct_grams([fold_text(t or "") for t in batch.column("text").to_pylist()])
            if not terms:
                continue
            cuts = pa.array(np.searchsorted(number, np.arange(len(terms) + 1)).astype(np.int32))
            ids = pa.ListArray.from_arrays(cuts, batch.column("chunk_id").take(pa.array(row)))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), ids, pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32)))], ["term", "ids", "tfs"])


def postings(chunks: DataFrame) -> DataFrame:
    """term, chunk_id, tf: every folded trigram of every chunk, counted where the chunk is, without a shuffle."""
    # lists cross over from Python in far less time than their elements as rows
    lists = chunks.select("chunk_id", "text").mapInArrow(_count_grams, "term string, ids array<long>, tfs array<int>")
    rows = lists.select("term", "tfs", F.posexplode("ids").alias("at", "chunk_id"))
    return rows.select("term", "chunk_id", F.get("tfs", F.col("at")).cast("long").alias("tf"))


def tree_of(query: str, is_pattern: bool):
    return parse(query if is_pattern else match_query(query)) if is_pattern or query_terms(query) else NOTHING


def idf_of(n: int, df: int) -> float:
    idf = math.log((n - df + 0.5) / (df + 0.5))
    return idf if idf > 0 else LEAST_IDF


def statistics(chunks: DataFrame, phrases: list[Phrase]) -> dict:
    """n, tokens and the number of chunks that have each phrase (n0, n1, ...), from one scan."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * (2 + len(phrases))
        for batch in batches:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            seen = Seen([fold_text(t) for t in texts])
            found = [len(texts), sum(max(0, len(t) - 2) for t in texts), *(int(np.count_nonzero(seen.count(p))) for p in phrases)]
            sums = [a + b for a, b in zip(sums, found, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sums], names)

    names = ["n", "tokens", *(f"n{i}" for i in range(len(phrases)))]
    counted = chunks.select("text").mapInArrow(count, ", ".join(f"{name} long" for name in names))
    return counted.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names]).first().asDict()


def ranks(tree, seen: Seen, tokens: np.ndarray, idfs: list[float], mean: float) -> np.ndarray:
    """BM25 of texts with that many tokens, more negative is better; phrases are added up in their order."""
    norm = K1 * (1 - B + B * tokens / mean)
    rank = np.zeros(seen.size)
    for idf, count in zip(idfs, scored_counts(tree, seen), strict=True):
        rank = rank - idf * (count * (K1 + 1) / (count + norm))
    return rank


def mean_of(n: int, tokens: int) -> float:
    return tokens / n if n and tokens else 1.0


def scored(chunks: DataFrame, tree, stats: dict | None = None) -> DataFrame:
    """``chunks`` with ``_hit`` and ``fts_rank`` (more negative is better) by a pattern's tree.

    The statistics are those of all ``chunks`` unless ``stats`` has them: n,
    tokens, and a number of chunks for each scored phrase (n0, n1, ...). A
    text is folded once for all phrases. Ties of rank are for the caller to break.
    """
    if tree is NOTHING:
        return chunks.withColumns({"_hit": F.lit(False), "fts_rank": F.lit(0.0)})
    phrases = scored_phrases(tree)
    stats = stats or statistics(chunks, phrases)
    idfs, mean = [idf_of(stats["n"], stats[f"n{i}"]) for i in range(len(phrases))], mean_of(stats["n"], stats["tokens"])

    @F.pandas_udf("hit boolean, rank double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        texts = [t or "" for t in texts]
        seen = Seen([fold_text(t) for t in texts])
        tokens = np.array([max(0, len(t) - 2) for t in texts], float)
        return pd.DataFrame({"hit": matches(tree, seen), "rank": ranks(tree, seen, tokens, idfs, mean)})

    # named so, a filter on the result does not run it a second time
    judged = chunks.withColumn("_judged", judge.asNondeterministic()(F.col("text")))
    return judged.withColumns({"_hit": F.col("_judged.hit"), "fts_rank": F.col("_judged.rank")}).drop("_judged")


def uses_fallback(query: str, is_pattern: bool) -> bool:
    """Literal queries of fewer than three characters have no trigram."""
    return not is_pattern and len(query.strip()) < 3


def fts_topk(chunks: DataFrame, query: str, k: int, is_pattern: bool = False) -> DataFrame:
    """The best ``k`` chunks by BM25, ties to the smaller chunk_id: ``chunks`` with fts_rank and score."""
    return _best(scored(chunks, tree_of(query, is_pattern)), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    return found.where("_hit").drop("_hit").orderBy("fts_rank", "chunk_id").limit(k).withColumn("score", -F.col("fts_rank"))


def like_topk(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """The ``k`` shortest chunks that hold the query, with ASCII folding; score 1, no rank."""
    found = chunks.where(contains_ascii(F.col("text"), query)).withColumn("_length", F.length("text"))
    top = found.orderBy("_length", "chunk_id").limit(k).drop("_length")
    return top.withColumn("fts_rank", F.lit(None).cast("double")).withColumn("score", F.lit(1.0))
