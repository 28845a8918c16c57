"""Vectorised byte, word and shingle kernels over Arrow text columns.

Everything here works on blocks: runs of whole documents of about 256 KiB, so that
temporaries stay in the cache whatever the Arrow batch holds. Words are hashed eight bytes at
a time by a mixing function. Byte ranges that overlap are hashed by prefix sums: polynomials
over random byte values modulo the prime 2 ** 31 - 1, at two independent bases.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 18
PRIME = (1 << 31) - 1
_P = U64(PRIME)
_BASES = (0x5E3779B9, 0x3F4A7C15)
#: Words beyond this many bytes are hashed one by one.
LONG_WORD = 512


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def raw_text(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null counts as an empty text."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset : arr.offset + len(arr) + 1] if len(arr) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of up to `limit` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Modulo the prime, of values below 2 ** 63."""
    x = (x & _P) + (x >> U64(31))
    x = (x & _P) + (x >> U64(31))
    return np.where(x >= _P, x - _P, x)


@functools.cache
def _powers(n: int) -> tuple[tuple[np.ndarray, np.ndarray], ...]:
    """Powers of each base and of its inverse, made by doubling."""
    out = []
    for base in _BASES:
        pair = []
        for b in (base, pow(base, -1, PRIME)):
            p = np.ones(n, U64)
            have = 1
            while have < n:
                more = min(have, n - have)
                p[have : have + more] = _reduced(p[:more] * U64(pow(b, have, PRIME)))
                have += more
            pair.append(p)
        out.append(tuple(pair))
    return tuple(out)


def powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    return [(p[:n], q[:n]) for p, q in _powers(1 << max(20, int(n).bit_length()))]


@functools.cache
def byte_values(which: int) -> np.ndarray:
    """A random residue for each byte."""
    return mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93) + U64(which << 32)) % _P


def class_table(pattern_bytes: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(pattern_bytes)] = True
    return t


#: Word bytes of the two rules: all but ASCII blanks; ASCII letters, digits and every non-ASCII byte.
NOT_BLANK = ~class_table(b" \t\n\x0b\x0c\r")


def prefix_hash(data: np.ndarray) -> list[np.ndarray]:
    """Prefix sums whose differences, scaled back, are hashes of byte ranges; up to 2 ** 31 bytes."""
    out = []
    for which, (p, _) in enumerate(powers(len(data) + 1)):
        sums = np.zeros(len(data) + 1, U64)
        x = byte_values(which)[data] * p[: len(data)]
        np.cumsum((x & _P) + (x >> U64(31)), out=sums[1:])  # each below 2 ** 32
        out.append(sums)
    return out


def range_hash(prefix: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges. Two different ranges of L bytes agree with a chance of at most ((L + 1) / 2 ** 31) ** 2 over the choice of bases and byte values."""
    one, two = (_reduced(_reduced(s[end] - s[start]) * q[start]) for s, (_, q) in zip(prefix, powers(len(prefix[0])), strict=True))
    return mix64((one << U64(32)) | two)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool) -> np.ndarray:
    """Hashes of byte spans (words), with A-Z as a-z if folded: each eight bytes are mixed into what the bytes before gave."""
    size = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = _FOLD[data] if fold else data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix64(size.astype(U64) * U64(0xD6E8FEB86659FD93) + U64(1))
    live = np.flatnonzero(size <= LONG_WORD)
    done = 0
    while len(live):
        part = eight[start[live] + done] & _LOW_BYTES[np.minimum(size[live] - done, 8)]
        out[live] = mix64(out[live] ^ part)
        done += 8
        live = live[size[live] > done]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(padded[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word; offsets are relative to data, no word crosses a document."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w = is_word[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | cut[1:n]
    end = w.copy()
    end[:-1] &= ~w[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, side="right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of every word of a block."""
    s, e, d = word_spans(data, offsets, is_word)
    return span_hashes(data, s, e, fold), d


_ROLL = [int(x) | 1 for x in mix64(np.arange(11, 75, dtype=U64))]


def shingle_hashes(h: np.ndarray, d: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles, in order; a document of 1 to k-1 words has its whole sequence as one."""
    counts = np.bincount(d, minlength=n_docs) if len(d) else np.zeros(n_docs, np.int64)
    m = len(h) - k + 1
    if m > 0:
        ok = d[: len(h) - k + 1] == d[k - 1 :]
        acc = np.zeros(m, U64)
        for j in range(k):
            acc += h[j : j + m] * U64(_ROLL[j])
        full, fd = mix64(acc[ok]), d[:m][ok]
    else:
        full, fd = np.zeros(0, U64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return full, fd
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    extra = [mix64(np.array([sum(int(h[first[x] + j]) * _ROLL[j] for j in range(counts[x])) + _ROLL[40 + counts[x]] & (1 << 64) - 1], U64))[0] for x in short]
    allh, alld = np.concatenate([full, np.array(extra, U64)]), np.concatenate([fd, short])
    order = np.argsort(alld, kind="stable")
    return allh[order], alld[order]


def sorted_sets(h: np.ndarray, d: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each document in ascending order, with documents and per-document offsets."""
    h = h.copy()
    bounds = np.searchsorted(d, np.arange(n_docs + 1))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a > 1:
            h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[keep], d[keep]
    return h, d, np.searchsorted(d, np.arange(n_docs + 1))
