"""Words of whole Arrow columns of text as numpy arrays, without an object for each word.

A word is a maximal run of bytes other than the six blanks of ASCII. Features of a classifier take the hash of `polynomial`, modulo 2**64, which is
cheap, but gives some pairs of words one hash. Where words must be told apart, `lanes` mixes in eight bytes after the other.
The hash of a run of words is a polynomial in the hashes of its words, from running sums as Rabin and Karp do: modulo 2**64 in `runs`, modulo
the prime 2**61 - 1 in `prime_runs`, which goes with `lanes`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
#: Bytes worked on at once; a group of texts holds about this many.
CHUNK = 1 << 21

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of unsigned 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, np.uint64)
        p[0] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(16, int(size).bit_length()))


def text_groups(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Splits a column into groups of about CHUNK bytes: (first row, end row, bytes, offsets).

    Each text gets a line break after it, so that words never cross texts; null counts as empty.
    """
    column = column.cast(pa.large_binary())
    sizes = np.zeros(len(column), np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    valid = np.ones(len(column), bool)
    if column.null_count:
        valid = column.is_valid().to_numpy(zero_copy_only=False)
    sizes[:] = np.where(valid, np.diff(offsets), 0)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        ends = np.cumsum(sizes[at : at + 65536] + 1)
        n = max(1, int(np.searchsorted(ends, CHUNK)))
        n = min(n, len(ends))
        out = np.full(int(ends[n - 1]), 10, np.uint8)
        starts = np.concatenate(([0], ends[:n]))
        if valid[at : at + n].all():
            source = data[offsets[at] : offsets[at + n]]
            keep = np.ones(len(out), bool)
            keep[starts[1:] - 1] = False
            out[keep] = source
        else:
            for i in range(n):
                if sizes[at + i]:
                    out[starts[i] : starts[i] + sizes[at + i]] = data[offsets[at + i] : offsets[at + i] + sizes[at + i]]
        yield at, at + n, out, starts
        at += n


def polynomial(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    p, inverse = powers(BASE, len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum((part.astype(np.uint64) + np.uint64(1)) * p[: len(part)], out=sums[1:])
    return mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(WORD_BASE))


#: Bytes of a word that `lanes` takes eight at a time; longer words are digested one by one.
LONG = 64


def lanes(part: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A hash without structure: no two words of a kind are known to share it."""
    size = e - s
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate((part, np.zeros(8, np.uint8))), 8)
    h = mix(size.astype(np.uint64) * np.uint64(WORD_BASE))
    todo = np.flatnonzero(size <= LONG)
    for at in range(0, LONG, 8):
        todo = todo[size[todo] > at]
        if not len(todo):
            break
        lane = np.ascontiguousarray(eights[s[todo] + at]).view("<u8")[:, 0]
        spare = np.maximum(8 - (size[todo] - at), 0).astype(np.uint64) * np.uint64(8)
        h[todo] = mix(h[todo] ^ (lane << spare))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(part[s[i] : e[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def split(
    data: np.ndarray, blank: np.ndarray = BLANK, hashed: Callable[..., np.ndarray] = polynomial
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each word in `data`, which ends with a blank."""
    starts, ends, hashes = [], [], []
    at = 0
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        while not blank[data[stop - 1]] and stop < len(data):  # to the end of the word
            more = np.flatnonzero(blank[data[stop : stop + CHUNK]])
            stop = stop + int(more[0]) + 1 if len(more) else min(len(data), stop + CHUNK)
        part = data[at:stop]
        is_blank = blank[part]
        change = np.flatnonzero(is_blank[1:] != is_blank[:-1]) + 1
        if len(part) and not is_blank[0]:
            change = np.concatenate(([0], change))
        if len(change) % 2:
            change = np.concatenate((change, [len(part)]))
        s, e = change[0::2], change[1::2]
        starts.append(s + at)
        ends.append(e + at)
        hashes.append(hashed(part, s, e))
        at = stop
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every `size` consecutive words, by the place of the first."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64)
    p, inverse = powers(WORD_BASE, n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * p[:n], out=sums[1:])
    return mix((sums[size:] - sums[: n - size + 1]) * inverse[: n - size + 1])


PRIME = (1 << 61) - 1
_P, _S61, _S32, _S31, _S30, _S29 = (np.uint64(x) for x in (PRIME, 61, 32, 31, 30, 29))
_LOW32, _LOW31, _LOW30 = (np.uint64((1 << n) - 1) for n in (32, 31, 30))


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any unsigned 64-bit numbers modulo the prime."""
    x = (x & _P) + (x >> _S61)
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a * b modulo the prime, by halves of 31 and 30 bits; 2**61 counts as 1."""
    a1, a0, b1, b0 = a >> _S31, a & _LOW31, b >> _S31, b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(_reduced(a1 * b1 * np.uint64(2) + (middle >> _S30) + ((middle & _LOW30) << _S31)) + _reduced(a0 * b0))


@lru_cache(maxsize=4)
def _prime_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for b in (WORD_BASE % PRIME, pow(WORD_BASE, -1, PRIME)):
        p = np.ones(1, np.uint64)
        while len(p) < size:
            p = np.concatenate((p, _times(p, np.uint64(pow(b, len(p), PRIME)))))
        both.append(p)
    return both[0], both[1]


def prime_runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """As `runs`; two different runs share a hash by chance with 2**-61."""
    n = len(hashes)
    if n < size:
        return np.empty(0, np.uint64)
    p, inverse = _prime_powers(1 << max(16, int(n + 1).bit_length()))
    terms = _times(_reduced(hashes), p[:n])
    # Running sums of the upper and lower bits, which stay below 2**64, and then modulo the prime.
    high, low = (np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (terms >> _S32, terms & _LOW32))
    high = _reduced(high)
    sums = _reduced((((high << _S32) & _P) + (high >> _S29)) + _reduced(low))
    return mix(_times(_reduced(sums[size:] + (_P - sums[: n - size + 1])), inverse[: n - size + 1]))


def places(first: np.ndarray, size: int) -> np.ndarray:
    """The places at which a run of `size` words begins within one text.

    first: for each text the index of its first word, then the number of all words.
    """
    counts = np.maximum(np.diff(first) - size + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(first[:-1] - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + shift
