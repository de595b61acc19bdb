"""Byte-level BPE ids from the tokenizers library, with a memo over parts of space-separated chunks.

Byte-level BPE never merges across a single space that stands between two other
characters, nor does its pattern match across a place where letters, digits, marks or a
single newline meet, apostrophes apart.  So a text is the concatenation of the ids of its
parts (wordhash.parts) and each distinct part has to be encoded only once per worker.  The
memo is kept in arrays and emptied when it is full, which bounds memory without changing
any id.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from functools import cache
from itertools import chain

import numpy as np

from . import wordhash


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Trailing marks; an apostrophe may belong to the letters that follow it.
MARKS = ".,;:!?$%&#*()[]{}<>/|+=-\"@~^_`"




def characters() -> np.ndarray:
    """The character that byte-level BPE has for each byte."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = np.zeros(256, np.uint16)
    out[own] = own
    out[out == 0] = 256 + np.arange(256 - len(own))
    return out


CHARACTERS = characters()
HALF, LOW = np.uint64(32), np.uint64((1 << 32) - 1)


class Memo:
    """Ids of chunks by two hashes: a table of open addressing in arrays, which doubles when it is three quarters full."""

    def __init__(self, dtype: np.dtype, slots: int = 1 << 16):
        self.flat, self.used, self.many = np.zeros(1 << 16, dtype), 0, 0
        self._empty(slots)

    def _empty(self, slots: int) -> None:
        #: key; check and, in the lower half, one more than the number of the entry
        self.table = np.zeros((slots, 2), np.uint64)
        entries = np.zeros((2, 3 * slots // 4), np.int32)
        if self.many:
            entries[:, : self.many] = self.offsets[: self.many], self.sizes[: self.many]
        self.offsets, self.sizes = entries

    def __len__(self) -> int:
        return self.many

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offset into flat of each key, -1 if it isn't there, and its number of ids, -1 for a chunk that has none of its own."""
        last, pairs = len(self.table) - 1, self.table.view(np.complex128)[:, 0]  # of 16 bytes, which are read at once
        check = check << HALF
        slot = (key & np.uint64(last)).view(np.int64)
        there = pairs[slot].view(np.uint64).reshape(-1, 2)
        entry = there[:, 1] & LOW
        left = np.flatnonzero((there[:, 0] != key) | (there[:, 1] ^ entry != check))
        left = left[entry[left] > 0]
        while len(left):
            slot[left] = s = slot[left] + 1 & last
            there = pairs[s].view(np.uint64).reshape(-1, 2)
            entry[left] = e = there[:, 1] & LOW
            left = left[(e > 0) & ((there[:, 0] != key[left]) | (there[:, 1] ^ e != check[left]))]
        entry = entry.view(np.int64) - 1  # the last one for what isn't there
        at, size = self.offsets[entry], self.sizes[entry]
        missed = np.flatnonzero(entry < 0)
        at[missed], size[missed] = -1, 0
        return at, size

    def add(self, key: np.ndarray, check: np.ndarray, ids: list[bytes | None]) -> None:
        """Different keys that aren't there."""
        sizes = np.array([-1 if x is None else len(x) // self.flat.itemsize for x in ids], np.int32)
        self.put(key, check, sizes, np.frombuffer(b"".join(x for x in ids if x is not None), self.flat.dtype))

    def put(self, key: np.ndarray, check: np.ndarray, sizes: np.ndarray, new: np.ndarray) -> None:
        """add() of ids that lie end to end."""
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(new)] = new
        many, slots = self.many + len(key), len(self.table)
        while 4 * many > 3 * slots:
            slots *= 2
        if slots > len(self.table):
            before = self.table[(self.table[:, 1] & LOW) > 0]
            self._empty(slots)
            self._place(before)
        real = np.maximum(sizes, 0)
        self.offsets[self.many : many] = self.used + np.cumsum(real) - real
        self.sizes[self.many : many] = sizes
        self._place(np.stack([key, check << HALF | np.arange(self.many + 1, many + 1, dtype=np.uint64)], axis=1))
        self.used += len(new)
        self.many = many

    def _place(self, rows: np.ndarray) -> None:
        last, number = len(self.table) - 1, rows[:, 1]
        left, slot = np.arange(len(rows)), (rows[:, 0] & np.uint64(last)).astype(np.int64)
        while len(left):
            free = left[self.table[slot[left], 1] == 0]
            self.table[slot[free]] = rows[free]  # of several for one slot the last one stays
            left = left[self.table[slot[left], 1] != number[left]]
            slot[left] = slot[left] + 1 & last


class Encoder:
    """Encodes whole texts; ids come back as little-endian uint16 or uint32 bytes."""

    def __init__(self, path: str | None = None, memo_limit: int = 3_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.tokenizer.encode_special_tokens = True  # their names in a text are ordinary text
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.opens = np.zeros(size, dtype=bool)  # tokens whose first byte is a space
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith("Ġ")
        self.model = self.tokenizer.model
        self.memo = Memo(self.dtype)
        self.memo_limit = memo_limit
        self.tails: dict[str, bytes] = {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=self.dtype).tobytes() for x in found]

    def _learn(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of chunks after a space. A chunk with white space at either end gets None: its texts are encoded whole."""
        out: list[bytes | None] = [None] * len(chunks)
        good: dict[str, list[tuple[int, str]]] = {}
        for k, c in enumerate(chunks):
            if c[0].isspace() or c[-1].isspace():
                continue
            core = c.rstrip(MARKS)
            # marks after a letter are a token of their own
            if len(core) == len(c) or not core or not core[-1].isalpha():
                core = c
            good.setdefault(core, []).append((k, c[len(core) :]))
        cores = list(good)
        for tail in {t for x in good.values() for _, t in x}.difference(self.tails):
            (self.tails[tail],) = self._plain([tail])
            if len(self.tails) > 10_000:
                self.tails = {tail: self.tails[tail], "": b""}
        for at in range(0, len(cores), 4096):
            some = cores[at : at + 4096]
            (found,) = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)
            ids = np.array(found.ids, dtype=self.dtype)
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(some):
                raw, width = ids.tobytes(), self.dtype.itemsize
                ends = [*(starts[1:] * width).tolist(), len(raw)]
                encoded = [raw[a:b] for a, b in zip((starts * width).tolist(), ends, strict=True)]
            else:  # not expected; keeps the result right in any case
                encoded = self._plain([" " + c for c in some])
            for c, x in zip(some, encoded, strict=True):
                for k, tail in good[c]:
                    out[k] = x if not tail else x + (self.tails[tail] if tail in self.tails else self._plain([tail])[0])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size < 4_000_000):
                size += len(texts[to])
                to += 1
            out += self._block(texts[at:to])
            at = to
        return out

    @staticmethod
    def _first(key: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """One of the rows for each different key."""
        return rows[np.unique(key[rows], return_index=True)[1]]

    def _add(self, a: np.ndarray, kinds: np.ndarray, begins: np.ndarray, ends: np.ndarray, opens: np.ndarray, key: np.ndarray, check: np.ndarray) -> None:
        """Puts new parts into the memo. One of a single known kind is a whole match of the tokenizer's pattern, so that its model alone encodes it."""
        size = ends - begins
        to = np.cumsum(size) - size
        places = np.repeat(begins - to, size) + np.arange(size.sum())
        plain = np.minimum.reduceat(kinds[places], to) > 0
        some = plain[np.repeat(np.arange(len(size)), size)]
        n = size[plain] + opens[plain] + 1
        to = np.cumsum(n) - n
        chars = np.full(n.sum(), wordhash.SPACE, "<u2")
        chars[to[opens[plain]]] = CHARACTERS[wordhash.SPACE]
        chars[np.repeat(to + opens[plain] - np.cumsum(size[plain]) + size[plain], size[plain]) + np.arange(size[plain].sum())] = CHARACTERS[a[places[some]]]
        tokenize = self.model.tokenize
        found = [[t.id for t in tokenize(w)] for w in chars.tobytes().decode("utf-16-le").split(" ")[:-1]]
        many = np.fromiter(map(len, found), np.int32, len(found))
        self.memo.put(key[plain], check[plain], many, np.fromiter(chain.from_iterable(found), self.dtype, many.sum()))
        for spaced, encode in ((True, self._learn), (False, self._plain)):
            rest = np.flatnonzero(~plain & (opens == spaced))
            if len(rest):
                self.memo.add(key[rest], check[rest], encode([a[b:e].tobytes().decode() for b, e in zip(begins[rest].tolist(), ends[rest].tolist(), strict=True)]))

    def _block(self, texts: list[str]) -> list[bytes]:
        raw = [t.encode() for t in texts]
        # a byte that no text has stands between them
        joined = b" \xff ".join(raw)
        a = np.frombuffer(joined, np.uint8)
        kinds, begins, ends = wordhash.parts(joined)
        lengths = np.array([len(x) for x in raw], np.int64)
        first = np.concatenate([[0], np.cumsum(lengths[:-1] + 3)]) if len(raw) else lengths
        low, high = np.searchsorted(begins, first), np.searchsorted(begins, first + lengths)
        opens = np.ones(len(begins), bool)
        opens[1:] = begins[1:] > ends[:-1]
        chunks, filled = (np.concatenate([[0], np.cumsum(x)]) for x in (opens, ends - begins))
        # single spaces between chunks, and no part that is too long to be hashed
        regular = (lengths - filled[high] + filled[low] == chunks[high] - chunks[low] - 1) & (lengths <= wordhash.CHUNK // 2)
        opens[low[regular]] = False  # what a text begins with
        rest = np.zeros(len(begins) + 1, np.int8)
        rest[low[regular]] = 1
        rest[high[regular]] = -1  # of the byte between two texts
        rest = np.flatnonzero(np.cumsum(rest[:-1], dtype=np.int8))
        begins, ends, opens = begins[rest], ends[rest], opens[rest]
        key, check = wordhash.checked(a, begins, ends)
        key ^= opens  # with and without a space
        at, size = self.memo.find(key, check)
        new = self._first(key, np.flatnonzero(at < 0))
        if len(new):
            if len(self.memo) + len(new) > self.memo_limit:
                self.memo = Memo(self.dtype)
                at[:] = -1
                new = self._first(key, np.arange(len(key)))
            self._add(a, kinds, begins[new], ends[new], opens[new], key[new], check[new])
            missed = np.flatnonzero(at < 0)
            at[missed], size[missed] = self.memo.find(key[missed], check[missed])
        # texts with a part that has no ids of its own are encoded whole
        low, high = np.searchsorted(rest, low), np.searchsorted(rest, high)
        if size.min(initial=0) < 0:
            lost = np.concatenate([[0], np.cumsum(size < 0)])
            regular &= lost[high] == lost[low]
            size = np.maximum(size, 0)
        total = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        places = np.repeat(at - total[:-1], size) + np.arange(total[-1])
        ids = self.memo.flat[places].tobytes()
        if len(self.memo) > self.memo_limit:  # by this block alone
            self.memo = Memo(self.dtype)
        width = self.dtype.itemsize
        whole = iter(self._plain([t for ok, t in zip(regular.tolist(), texts, strict=True) if not ok]))
        return [ids[x:y] if ok else next(whole) for ok, x, y in zip(regular.tolist(), (total[low] * width).tolist(), (total[high] * width).tolist(), strict=True)]


@cache
def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker process: its memo outlives a task."""
    return Encoder(path or default_path())


def release(path: str | None = None) -> None:
    """Empties the worker's memo, if it has one."""
    if encoder.cache_info().currsize:
        e = encoder(path)
        e.memo = Memo(e.dtype)


def forget() -> None:
    """Gives the worker's encoder and memo back as a whole, for operators that don't tokenise."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
