"""Words of many texts at once, as NumPy arrays over an Arrow column's bytes.

A word is a run of bytes other than space and the controls 9 to 13. Those
are ASCII, so cutting UTF-8 bytes cuts at code points.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] = _FOLD[97:123]
#: Longer runs of bytes are hashed one by one by BLAKE2b.
_BLOCKED = 64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (in place on a copy)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows in them; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, min(end, n)
        row = end


@dataclass
class Words:
    """Words of a run of rows, in order; row r has words first[r] to first[r + 1]."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of ``data[start:end]``; equal runs have equal hashes wherever they stand.

    Runs of up to 64 bytes are taken in blocks of 8, each mixed into what the
    blocks before it made, all runs side by side; longer ones go to BLAKE2b.
    """
    lengths = ends - starts
    out = mix(lengths.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x632BE59BD9B4E019))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    blocks = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    short = np.flatnonzero(lengths <= _BLOCKED)
    for at in range(0, _BLOCKED, 8):
        short = short[lengths[short] > at]
        if not len(short):
            break
        block = blocks[starts[short] + at].astype(U64)
        left = lengths[short] - at
        partial = left < 8
        block[partial] &= (U64(1) << (left[partial].astype(U64) * U64(8))) - U64(1)
        out[short] = mix(mix(out[short] ^ block) * U64(0xD6E8FEB86659FD93) + U64(at + 1))
    for row in np.flatnonzero(lengths > _BLOCKED):
        out[row] = int.from_bytes(hashlib.blake2b(data[starts[row] : ends[row]], digest_size=8).digest(), "little")
    return out


def span_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit BLAKE2b digests of ``data[start:end]``, as two columns of 64-bit words."""
    raw = bytes(data)
    made = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(made, "<i8").reshape(-1, 2)


def set_digest(items: np.ndarray) -> tuple[int, int]:
    """Two 64-bit words of the BLAKE2b digest of a set, given as sorted 64-bit members."""
    return struct.unpack("<2q", hashlib.blake2b(items.astype("<u8").data, digest_size=16).digest())


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True, word_bytes: np.ndarray = _IS_WORD) -> Words:
    """Words of the rows; ``fold`` reads A to Z as a to z, ``word_bytes`` says which bytes make words."""
    n = len(data)
    inside = word_bytes[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    begins[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    ends = np.flatnonzero(closes) + 1
    hashes = span_hashes(_FOLD[data] if fold else data, starts, ends)
    return Words(hashes, starts, ends, np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words of one text; a shorter text is one run."""
    if not len(hashes):
        return np.zeros(0, U64)
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.full(n, size, U64)
    for k in range(size):
        out = mix(out * U64(0x2545F4914F6CDD1D) + hashes[k : k + n])
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (sorting beats np.unique's hashing on short arrays)."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=keep[1:])
    return values[keep]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row its distinct shingle hashes, sorted."""
    for begin, end in slices(offsets):
        part = offsets[begin : end + 1]
        w = words(data[part[0] : part[-1]], part - part[0])
        for r in range(end - begin):
            yield distinct(shingles(w.hashes[w.first[r] : w.first[r + 1]], size))
