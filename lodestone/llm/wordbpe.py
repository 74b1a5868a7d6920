"""A word-level byte-pair encoder over whole batches of texts, equal to the `tokenizers` library.

It reads a `tokenizers` file of the kind "lower-cased words with word ends"
and encodes the distinct words of a batch side by side: words of one byte
length form a matrix of symbols, and each round merges in every row the
leftmost pair of least rank, so a round costs one pass over the matrix.
Texts with characters whose folding or class needs more than the tables
here, and very long words, go to the library itself.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Tokenizer

from lodestone.llm.textarrays import span_hashes, text_bytes

#: The normaliser, pre-tokeniser and word end of the files read here.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")

_ROW = "\x1e"
#: Characters outside these ranges are left to the library.
_OTHERS = re.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-įı-ſ‐-‧‰-⁞₠-₿]|<\\|")
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_LONGEST = 48
_MOST_WORDS = 500_000


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: Bytes that only texts with one of ``_OTHERS`` can hold, and some texts without.
_ODD_BYTES = np.zeros(256, bool)
_ODD_BYTES[0x1C:0x20] = True
_ODD_BYTES[0xC6:] = True
_ODD_PAIRS = [(0xC2, 0x85), (0xC2, 0xA0), (0xC4, 0xB0), (ord("<"), ord("|"))]


def _suspects(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Rows worth a look for ``_OTHERS``, by their UTF-8 bytes."""
    odd = _ODD_BYTES[data]
    for a, b in _ODD_PAIRS:
        odd[:-1] |= (data[:-1] == a) & (data[1:] == b)
    at = np.flatnonzero(odd)
    return np.unique(np.searchsorted(offsets, at, "right") - 1).tolist()


class _PairTable:
    """An open-addressing table from symbol pairs to merge ranks, looked up by whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << int(np.ceil(np.log2(len(keys) * 8 + 2)))) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.zeros(self.mask + 1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] == -1)
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], np.int32(missing))
        more = np.flatnonzero((found != keys) & (found != -1))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            found = self.keys[slot[more]]
            hit = found == keys[more]
            out[more[hit]] = self.values[slot[more[hit]]]
            more = more[~hit & (found != -1)]
        return out


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all bytes of some runs, run after run."""
    return np.arange(int(lengths.sum())) + np.repeat(starts - np.cumsum(lengths) + lengths, lengths)


def _equal_spans(a: np.ndarray, starts_a: np.ndarray, b: np.ndarray, starts_b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Which of the runs of bytes in ``a`` and ``b``, of equal lengths of at least 1, are equal."""
    if not len(lengths):
        return np.zeros(0, bool)
    differ = a[_places(starts_a, lengths)] != b[_places(starts_b, lengths)]
    return np.add.reduceat(differ, np.cumsum(lengths) - lengths, dtype=np.int64) == 0


class WordBpe:
    """Encoder of one `tokenizers` file; see the module's text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != WORD_END or split["pattern"].get("Regex") != SPLIT:
            raise ValueError(f"{path} is not a word-end BPE of the kind that this encoder reads")
        self.library = Tokenizer.from_file(path)
        vocab = model["vocab"]
        chars = _byte_chars()
        self.size = len(vocab)
        self.byte_ids = np.array([vocab[c] for c in chars], np.int32)
        self.last_ids = np.array([vocab[c + WORD_END] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.never = len(pairs)
        _, firsts = np.unique(keys, return_index=True)
        self.ranks = _PairTable(keys[firsts], firsts.astype(np.int32))
        self._forget()
        everything = "".join(map(chr, range(0x20C0)))
        self.classes = np.full(len(everything), _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
            self.classes[[m.start() for m in regex.finditer(pattern, everything)]] = kind
        self.classes[[9, 10, 11, 12, 13, 32, ord(_ROW)]] = _SPACE

    # -- words ---------------------------------------------------------------

    def _merge(self, symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Encode a matrix of words; pairs of row numbers and their final symbols."""
        rows, done = np.arange(len(symbols)), []
        ranks = self.ranks.get((symbols[:, :-1] * np.int64(self.size) + symbols[:, 1:]).ravel(), self.never).reshape(len(symbols), -1)
        while len(rows):
            if symbols.shape[1] == 1:
                done.append((rows, symbols))
                break
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == self.never
            if over.any():
                done.append((rows[over], symbols[over]))
                rows, symbols, ranks, at, best = rows[~over], symbols[~over], ranks[~over], at[~over], best[~over]
                if not len(rows):
                    break
            each, width = np.arange(len(rows)), symbols.shape[1] - 1
            place = np.arange(width)[None, :]
            symbols = np.where(place <= at[:, None], symbols[:, :-1], symbols[:, 1:])
            symbols[each, at] = self.merged[best]
            ranks = np.where(place[:, : width - 1] < at[:, None], ranks[:, : width - 1], ranks[:, 1:])
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < width - 1))
                s = side[ok]
                ranks[ok, s] = self.ranks.get(symbols[ok, s] * np.int64(self.size) + symbols[ok, s + 1], self.never)
        return done

    def _encode_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words one after another, and how many each has."""
        lengths = ends - starts
        counts, parts, owners, places = np.zeros(len(starts), np.int64), [], [], []
        for length in np.unique(lengths):
            which = np.flatnonzero(lengths == length)
            if length > _LONGEST:
                for w in which:
                    ids = self.library.encode(bytes(data[starts[w] : ends[w]]).decode(), add_special_tokens=False).ids
                    counts[w] = len(ids)
                    parts.append(np.array(ids, np.int32))
                    owners.append(np.full(len(ids), w))
                    places.append(np.arange(len(ids)))
                continue
            letters = data[starts[which][:, None] + np.arange(length)[None, :]]
            symbols = self.byte_ids[letters]
            symbols[:, -1] = self.last_ids[letters[:, -1]]
            for rows, final in self._merge(symbols):
                counts[which[rows]] = final.shape[1]
                parts.append(final.ravel())
                owners.append(np.repeat(which[rows], final.shape[1]))
                places.append(np.tile(np.arange(final.shape[1]), len(rows)))
        first = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for ids, owner, place in zip(parts, owners, places, strict=True):
            flat[first[owner] + place] = ids
        return flat, counts

    def _known(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``_flat`` the symbols of each of the distinct ``words`` (binary) begin and how many there are.

        Words met before are not encoded again: they are found by hash and
        then compared byte for byte. One that shares its hash with another is
        encoded whenever it comes. The memory of words starts anew once it
        holds ``_MOST_WORDS``, so it is bounded.
        """
        if len(self._seen) > _MOST_WORDS:
            self._forget()
        data, offsets = text_bytes(words)
        starts, lengths = offsets[:-1], np.diff(offsets)
        hashes = span_hashes(data, starts, offsets[1:])
        at = np.minimum(np.searchsorted(self._seen, hashes), len(self._seen) - 1)
        met = self._seen[at] == hashes
        same = met & (self._lengths[at] == lengths)
        same[same] = _equal_spans(data, starts[same], self._letters, self._starts[at[same]], lengths[same])
        begin, counts = self._begin[at], self._counts[at]
        fresh = np.flatnonzero(~same)
        if len(fresh):
            flat, n = self._encode_words(data, starts[fresh], offsets[1:][fresh])
            begin[fresh], counts[fresh] = len(self._flat) + np.cumsum(n) - n, n
            self._flat = np.concatenate([self._flat, flat])
            new = fresh[~met[fresh]]
            order = new[np.argsort(hashes[new], kind="stable")]
            order = order[np.append(True, hashes[order[1:]] != hashes[order[:-1]])] if len(order) else order
            place = np.searchsorted(self._seen, hashes[order])
            self._seen = np.insert(self._seen, place, hashes[order])
            self._starts = np.insert(self._starts, place, len(self._letters) + np.cumsum(lengths[order]) - lengths[order])
            self._letters = np.concatenate([self._letters, data[_places(starts[order], lengths[order])]])
            self._lengths = np.insert(self._lengths, place, lengths[order])
            self._begin = np.insert(self._begin, place, begin[order])
            self._counts = np.insert(self._counts, place, counts[order])
        return begin, counts

    def _forget(self) -> None:
        self._seen = np.array([np.iinfo(np.uint64).max], np.uint64)
        self._starts, self._lengths, self._begin, self._counts = np.zeros((4, 1), np.int64) - [[0], [1], [0], [0]]
        self._letters, self._flat = np.zeros(0, np.uint8), np.zeros(0, np.int32)

    def _pieces(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens, in characters."""
        kinds = self.classes[codes]
        fresh = np.ones(len(codes), bool)
        fresh[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _NUMBER)
        if len(quotes := np.flatnonzero(fresh & (codes == ord("'")))):
            padded = np.concatenate([codes, np.zeros(3, codes.dtype)])
            for ending in CONTRACTIONS:
                hit = quotes[np.logical_and.reduce([padded[quotes + 1 + k] == ord(c) for k, c in enumerate(ending)])]
                fresh[hit + 1] = False
                after = hit + 1 + len(ending)
                fresh[after[after < len(codes)]] = True
        edges = np.flatnonzero(fresh)
        ends = np.append(edges[1:], len(codes))
        kept = kinds[edges] != _SPACE
        return edges[kept], ends[kept]

    # -- texts ---------------------------------------------------------------

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = (_ROW.join(texts) + _ROW).lower()
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts, ends = self._pieces(codes)
        rows = np.searchsorted(starts, np.flatnonzero(codes == ord(_ROW)))
        data = np.frombuffer(joined.encode(), np.uint8)
        width = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF).astype(np.int64), out=width[1:])
        starts, ends = width[starts], width[ends]
        inside = np.zeros(len(data) + 1, np.int8)
        # words do not overlap, but one may begin where another ends
        inside[starts] += 1
        inside[ends] -= 1
        letters = data[np.cumsum(inside[:-1], dtype=np.int8) > 0]
        at = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
        word = column.indices.to_numpy()
        begin, counts = self._known(column.dictionary)
        flat = self._flat
        each = counts[word]
        shift = np.cumsum(each) - each
        ids = flat[np.repeat(begin[word] - shift, each) + np.arange(int(each.sum()))]
        upto = np.append(shift, each.sum())
        ends_at = upto[rows]
        return ids, np.diff(ends_at, prepend=0)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column one after another, and how many each text has."""
        column = column.fill_null("")
        texts = column.to_pylist()
        odd = {i for i in _suspects(*text_bytes(column)) if _OTHERS.search(texts[i])}
        if not odd:
            return self._encode_plain(texts)
        ids, counts = self._encode_plain([t for i, t in enumerate(texts) if i not in odd])
        rest = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else ())
        each = [
            np.array(self.library.encode(t, add_special_tokens=False).ids, np.int32) if i in odd else next(rest)
            for i, t in enumerate(texts)
        ]
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """The encoder of a file, built once in each Python worker."""
    return WordBpe(path)

