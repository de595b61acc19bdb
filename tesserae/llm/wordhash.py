"""64-bit hashes of all words of a text at once, by array operations.

A word's hash is the sum of a random number for each byte times a power of an odd number
for its place, modulo 2 ** 64, and then mixed. Sums come from one running sum over the
text, with the power of a word's first place divided out.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import xxhash

CHUNK = 1 << 18
SPACE = 32
BASE = 0x9E3779B97F4A7C15
BYTES = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

MORE_BYTES = np.random.default_rng(14).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


@cache
def powers() -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse modulo 2 ** 64, to the powers from 0 to CHUNK - 1."""
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(CHUNK - 1, b, np.uint64))]) for b in (BASE, pow(BASE, -1, 1 << 64)))


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of what stands between the spaces of a byte array."""
    edges = np.flatnonzero(np.diff((a == SPACE).view(np.int8), prepend=1, append=1))
    return edges[::2], edges[1::2]


#: Kinds of bytes: letters, digits, marks and, before their places are known, first bytes of
#: letters from U+00C0 to U+017F and newlines. 0: any other, apostrophes among them.
LETTER, DIGIT, MARK, LATIN, NEWLINE = 2, 3, 4, 5, 6
KINDS = bytes(
    1 if b == SPACE else NEWLINE if b == 10 else LATIN if 0xC3 <= b <= 0xC5 else 0 if not 32 < b < 127 or b == 39 else LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
    for b in range(256)
)


def parts(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The kind of each byte, and begins and ends of what stands between spaces or bytes of two known kinds.

    A newline is known where it is alone between two known bytes. 0xFF may stand in the text.
    """
    kinds = np.frombuffer(bytearray(joined.translate(KINDS)), np.uint8)
    a = np.frombuffer(joined, np.uint8)
    at = np.flatnonzero(kinds == LATIN)
    next_ = a[at + 1]
    known = np.where((a[at] == 0xC3) & ((next_ == 0x97) | (next_ == 0xB7)), 0, LETTER).astype(np.uint8)  # the signs of multiplication and division
    kinds[at] = kinds[at + 1] = known
    at = np.flatnonzero(kinds == NEWLINE)
    beside = np.zeros(len(a) + 2, np.uint8)
    beside[1:-1] = kinds
    alone = [(x >= LETTER) & (x <= MARK) for x in (beside[at], beside[at + 2])]
    kinds[at[~(alone[0] & alone[1])]] = 0
    x, y = kinds[:-1], kinds[1:]
    cut = np.ones(len(a) + 1, bool)
    cut[1:-1] = (x != y) & ((x != 0) & (y != 0) | (x == 1) | (y == 1))
    edges = np.flatnonzero(cut)
    if len(edges) < 2:
        return kinds, edges[:0], edges[:0]
    real = kinds[edges[:-1]] != 1
    return kinds, edges[:-1][real], edges[1:][real]


def hashes(folded: bytes) -> np.ndarray:
    """The hashes of the words of a text whose only separators are spaces."""
    if len(folded) > CHUNK:
        return np.concatenate([_hashes(p) for p in pieces(folded)])
    return _hashes(folded)


def pieces(folded: bytes):
    """folded in parts of whole words, of at most CHUNK bytes but for longer words."""
    at = 0
    while at < len(folded):
        end = len(folded)
        if end - at > CHUNK:
            end = folded.rfind(b" ", at, at + CHUNK)
            if end <= at:
                end = folded.find(b" ", at + 1)
                end = len(folded) if end < 0 else end
        yield folded[at:end]
        at = end


def _hashes(folded: bytes) -> np.ndarray:
    a = np.frombuffer(folded, np.uint8)
    if len(a) > CHUNK:  # one long word
        return np.array([xxhash.xxh64_intdigest(folded.strip(b" "))], np.uint64)
    begins, ends = runs(a)
    up, down = powers()
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(BYTES[a] * up[: len(a)], out=total[1:])
    return mix((total[ends] - total[begins]) * down[begins]) if len(begins) else np.zeros(0, np.uint64)


#: Bytes of a run that is hashed by its words of eight bytes, and masks of the first bytes of a word.
SHORT = 24
FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def checked(a: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of runs of a byte array of any length. Of runs of more than CHUNK / 2 bytes they mean nothing."""
    size = ends - begins
    words = np.zeros(len(a) // 8 + SHORT // 8 + 2, "<u8")
    words.view(np.uint8)[: len(a)] = a
    at, shift = begins >> 3, (begins & 7).astype(np.uint64) * np.uint64(8)
    key, check = size.astype(np.uint64) * np.uint64(BASE), np.zeros(len(begins), np.uint64)
    low, rows = words[at], None
    for k in range(SHORT // 8):
        # of shifts by 64 bits, in two steps
        high = words[at + k + 1]
        x = (low >> shift | high << np.uint64(1) << (np.uint64(63) - shift)) & FIRST[np.minimum(size - 8 * k, 8)]
        if rows is None:
            key, check = mix(key ^ x), mix(check + x * BYTES[k])
        else:
            key[rows], check[rows] = mix(key[rows] ^ x), mix(check[rows] + x * BYTES[k])
        more = np.flatnonzero(size > 8 * k + 8)
        rows = more if rows is None else rows[more]
        low, at, shift, size = high[more], at[more], shift[more], size[more]
    size = ends - begins
    long = np.flatnonzero(size > SHORT)
    if len(long):
        n = size[long]
        to = np.cumsum(n) - n
        key[long], check[long] = summed(a[np.repeat(begins[long] - to, n) + np.arange(n.sum())], to, to + n)
    return key, check


def summed(a: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of longer runs, by running sums over parts of CHUNK / 2 bytes."""
    out = np.zeros((2, len(begins)), np.uint64)
    up, down = powers()
    step = CHUNK // 2
    for first in range(0, len(a), step):
        k, e = np.searchsorted(begins, [first, first + step])
        if k == e:
            continue
        part = a[first : first + CHUNK]
        b, f = begins[k:e] - first, np.minimum(ends[k:e] - first, len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        for table, to in zip((BYTES, MORE_BYTES), out, strict=True):
            np.cumsum(table[part] * up[: len(part)], out=total[1:])
            to[k:e] = mix((total[f] - total[b]) * down[b])
    return out[0], out[1]
