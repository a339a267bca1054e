"""Vectorised byte hashing shared by the operators that run in numpy: words, shingles and windows of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15 | 1)
INVERSE = U(pow(int(BASE), -1, 1 << 64))
#: Bytes of text hashed in one go; a longer text is a chunk of its own.
CHUNK = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(n: int, of: np.uint64 = BASE) -> np.ndarray:
    """of**0 .. of**(n-1) modulo 2**64."""
    have = _powers.get(int(of))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, of, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[int(of)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def byte_values(seed: int = 1) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix(np.arange(256, dtype=U) * U(0xD1342543DE82EF95) + U(seed))


def text_chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, offsets, bytes) of runs of rows whose texts hold about ``limit`` bytes; nulls are empty."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may own bytes
        keep = np.asarray(column.is_valid())
        if (np.diff(offsets)[~keep] > 0).any():
            column = pa.array([x if x is not None else b"" for x in column.to_pylist()], pa.large_binary())
            yield from text_chunks(column, limit)
            return
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, len(column))
        yield a, offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        a = b


def fold_case(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals of UTF-8 text made small."""
    out = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * 32
    if len(out) > 1:
        wide = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:] += wide.astype(np.uint8) * 32
    return out


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text of each word, its hash) in order. A word is a run of bytes other than white space within one text;
    case and ASCII punctuation don't count, so words of punctuation alone are all alike."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U)
    ink = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.empty(n, bool)
    before[0], before[1:] = False, ink[:-1]
    cut = offsets[:-1]
    before[cut[cut < n]] = False
    starts = np.flatnonzero(ink & ~before)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, U)
    folded = fold_case(data)
    counts = (folded >= 128) | ((folded >= 97) & (folded <= 122)) | ((folded >= 48) & (folded <= 57))
    at = np.cumsum(counts, dtype=np.int32)
    value = byte_values()[folded]
    value *= powers(int(at[-1]) + 1)[at]
    value *= counts
    prefix = np.zeros(n + 1, U)
    np.cumsum(value, out=prefix[1:])
    ends = np.append(starts[1:], n)  # white space adds nothing
    total = prefix[ends] - prefix[starts]
    first = at[starts] - counts[starts]
    return np.searchsorted(offsets, starts, "right") - 1, mix(total * powers(int(at[-1]) + 1, INVERSE)[first])


def shingles(owner: np.ndarray, words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each run of ``size`` words; a text with fewer words has one shingle of them all."""
    n = len(words)
    if not n:
        return owner, words
    new = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    length = np.diff(np.append(new, n))
    prefix = np.zeros(n + 1, U)
    np.cumsum(words * powers(n), out=prefix[1:])
    back = powers(n, INVERSE)
    take = np.maximum(length - size + 1, 1)
    at = np.repeat(new - np.append(0, np.cumsum(take)[:-1]), take) + np.arange(int(take.sum()))
    end = np.minimum(at + size, np.repeat(new + length, take))
    return owner[at], mix((prefix[end] - prefix[at]) * back[at] + (end - at).astype(U))
