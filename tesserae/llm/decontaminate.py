"""Benchmark decontamination over a distributed positional inverted index.

The index is document-partitioned and stored: each row covers a block of whole training
texts and holds, for every term, the sorted positions of its occurrences in that block.
Building and searching need no shuffle of texts, and one index serves any test set.

The test set's windows of words are stored in files of about SLICE_BYTES. A search takes a
block of the index and goes through these files one after another, so memory is bounded by a
block and a file, and all that is found in a document meets in one row. Posting lists are
intersected from the rarest term of the block on, with offsets for phrases and within a
distance for proximity, so that most windows end at an empty list. Both kinds of match are
exact: a phrase is a window word by word; a proximity match is a stretch of at most the
window's length and SLACK more words of one document that holds all words of the window, as
often as the window does, in any order. Each phrase is one as well.

Edge cases: null and word-less texts have no positions; a null item has no phrase, an
item shorter than the window is one phrase of its own length; repeated items each count
under their own id, repeated ids count once, null item ids are left out; each row of the
documents gives a row, repeated and null ids included; empty tables give no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, stored

#: ASCII other than letters and digits separates words; A-Z becomes a-z; all else belongs to words.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32) for c in range(256))
BLOCK_TOKENS = 1_000_000
SLICE_BYTES = 8_000_000
SLACK = 2
INDEX = "docs array<bigint>, lengths binary, terms binary, counts binary, postings binary"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Numbers(dict):
    """Numbers new words in order."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def build_index(docs: DataFrame, name: str = "postings") -> DataFrame:
    """Stores the positions of all terms: a row for each block of documents.

    docs and lengths: ids and numbers of words of the block's documents, in order.
    Positions count over the block, with a gap of one after each document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, sizes, found, total = Numbers(), [], [], [], 0
        pack = zstandard.ZstdCompressor(level=1).compress

        def block() -> pa.RecordBatch:
            lengths = np.array(sizes, np.int64)
            terms = np.concatenate(found)
            where = np.arange(len(terms)) + np.repeat(np.arange(len(sizes)), lengths)
            order = np.argsort(terms, kind="stable")
            steps = np.diff(where[order].astype("<i4"), prepend=np.int32(0))
            row = [ids, lengths.astype("<i4").tobytes(), pack(b" ".join(number)), np.bincount(terms, minlength=len(number)).astype("<i4").tobytes(), pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes())]
            kinds = [pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words(t.as_py())
                ids.append(i)
                sizes.append(len(w))
                found.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
                total += len(w) + 1
                if total >= BLOCK_TOKENS:
                    yield block()
                    number, ids, sizes, found, total = Numbers(), [], [], [], 0
        if ids:
            yield block()

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INDEX), name)


class Block:
    """One row of the index, opened for searching."""

    def __init__(self, docs: list[int | None], lengths: bytes, terms: bytes, counts: bytes, postings: bytes):
        unpack = zstandard.ZstdDecompressor().decompress
        self.docs = docs
        self.lengths = np.frombuffer(lengths, "<i4")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths.astype(np.int64) + 1)[:-1]])
        self.counts = np.frombuffer(counts, "<i4")
        self.ends = np.cumsum(self.counts, dtype=np.int64)
        steps = np.frombuffer(unpack(postings), np.uint8).reshape(4, -1)
        self.where = np.cumsum(np.ascontiguousarray(steps.T).view("<i4").ravel(), dtype=np.int32)
        self.number = {t: k for k, t in enumerate(unpack(terms).split(b" "))} if len(self.counts) else {}

    def list(self, k: int) -> np.ndarray:
        return self.where[self.ends[k] - self.counts[k] : self.ends[k]]

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def close(self, terms: list[int], span: int) -> np.ndarray:
        """Places of the rarest term that have each other term fewer than span words away; all matches hold one of them."""
        lists = sorted((self.list(k) for k in set(terms)), key=len)
        at = lists[0]
        for x in lists[1:]:
            if not len(at):
                break
            to = np.searchsorted(x, at)
            after, before = x[np.minimum(to, len(x) - 1)] - at, at - x[np.maximum(to - 1, 0)]
            at = at[((after >= 0) & (after < span)) | ((before >= 0) & (before < span))]
        return at

    def phrase(self, terms: list[int]) -> np.ndarray:
        """Block positions at which the terms occur one after another."""
        lists = sorted(((len(x), k, x) for k, x in ((k, self.list(t)) for k, t in enumerate(terms))), key=lambda x: x[:2])
        at = lists[0][2] - lists[0][1]
        for _, k, x in lists[1:]:
            if not len(at):
                break
            to = np.searchsorted(x, at + k)
            to[to == len(x)] = 0
            at = at[x[to] == at + k]
        return at

    def near(self, terms: list[int], span: int, at: np.ndarray | None = None) -> list[tuple[int, int]]:
        """The shortest stretches (first, last + 1) of at most span words in one document that hold all terms in any order."""
        need: dict[int, int] = defaultdict(int)
        for t in terms:
            need[t] += 1
        out = set()
        for p in (self.close(terms, span) if at is None else at).tolist():
            d = int(self.document(np.array([p]))[0])
            low, high = max(int(self.starts[d]), p - span + 1), min(int(self.starts[d] + self.lengths[d]), p + span)
            inside = sorted((int(x), t) for t in need for x in self.list(t)[slice(*np.searchsorted(self.list(t), (low, high)))])
            have: dict[int, int] = defaultdict(int)
            first = missing = 0
            missing = len(terms)
            for x, t in inside:
                missing -= have[t] < need[t]
                have[t] += 1
                while have[inside[first][1]] > need[inside[first][1]]:
                    have[inside[first][1]] -= 1
                    first += 1
                if not missing and x + 1 - inside[first][0] <= span:
                    out.add((inside[first][0], x + 1))
        # a stretch that holds another one is not the shortest
        return [s for s in sorted(out) if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in out)]


@dataclass
class Slice:
    """Windows of the test set: words and items of each, and the windows as rows of numbers of words (-1 behind their end)."""

    names: list[bytes]
    rows: np.ndarray
    items: list[list[str]]


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """phrase (its words, with spaces between) and items of each different window of the test set, stored in files of about SLICE_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = set()
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = words(t.as_py())
                out.update((b" ".join(w[k : k + size]), i) for k in range(max(1, len(w) - size + 1) if w else 0))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.string()), strict=True)], names=["phrase", "item"])

    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(run, "phrase binary, item string")
    found = stored(items.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items")), "windows")
    total = found.agg(F.sum(F.octet_length("phrase") + F.expr("aggregate(items, 0L, (t, i) -> t + octet_length(i))"))).first()[0] or 0
    return stored(found.repartition(max(1, -(-total // SLICE_BYTES))), "phrases")


def opened(fs, path: str) -> Slice:
    t = pq.read_table(path, filesystem=fs)
    split = [p.split(b" ") for p in t.column("phrase").to_pylist()]
    number = Numbers()
    longest = max(map(len, split), default=1)
    rows = np.full((len(split), longest), -1, np.int32)
    for k, p in enumerate(split):
        rows[k, : len(p)] = list(map(number.__getitem__, p))
    return Slice(list(number), rows, t.column("items").to_pylist())


SPANS = "array<struct<start:int,end:int>>"
FOUND = f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans {SPANS}, items array<string>, n_near long, near {SPANS}, near_items array<string>"


def search(index: DataFrame, phrases: DataFrame, slack: int = SLACK) -> DataFrame:
    """FOUND for each document of the index: merged word spans of the phrases and of the proximity matches, with their items."""
    folder = phrases.stored_at
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), spans, pa.list_(pa.string()), pa.int64(), spans, pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        files = sorted(f.path for f in fs.get_file_info(FileSelector(base)) if f.path.endswith(".parquet"))
        kept: tuple[str, Slice | None] = ("", None)
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                block = Block(*row)
                hits, items, near, near_items = defaultdict(list), defaultdict(set), defaultdict(list), defaultdict(set)
                for f in files:
                    if kept[0] != f:
                        kept = f, opened(fs, f)
                    look(block, kept[1], hits, items, near, near_items)
                yield rows(block, hits, items, near, near_items)

    def look(block: Block, part: Slice, hits: dict, items: dict, near: dict, near_items: dict) -> None:
        # places of the slice's words in the block's list; the last is that of no word, which takes part in all
        there = np.array([*(block.number.get(w, -1) for w in part.names), -2], np.int32)
        terms = there[part.rows]
        for k in np.flatnonzero((terms != -1).all(axis=1)).tolist():
            own = [t for t in terms[k].tolist() if t != -2]
            at = block.close(own, len(own) + slack)
            if not len(at):
                continue
            for p in (found := block.phrase(own)).tolist():
                d = int(block.document(np.array([p]))[0])
                hits[d].append((p - int(block.starts[d]), p - int(block.starts[d]) + len(own)))
                items[d].update(part.items[k])
            some = [(int(p), int(p) + len(own)) for p in found] if len(own) == 1 else block.near(own, len(own) + slack, at)
            for a, e in some:
                d = int(block.document(np.array([a]))[0])
                near[d].append((a - int(block.starts[d]), e - int(block.starts[d])))
                near_items[d].update(part.items[k])

    def rows(block: Block, hits: dict, items: dict, near: dict, near_items: dict) -> pa.RecordBatch:
        out = []
        for d, (i, n) in enumerate(zip(block.docs, block.lengths.tolist(), strict=True)):
            own, own_near = merge(hits.get(d, [])), merge(near.get(d, []))
            hit, names = sum(e - a for a, e in own), sorted(items.get(d, ()))
            out.append((i, n, hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), hit > 0, structs(own), names, sum(e - a for a, e in own_near), structs(own_near), sorted(near_items.get(d, ()))))
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return index.mapInArrow(run, FOUND)


def structs(spans: list[tuple[int, int]]) -> list[dict]:
    return [{"start": a, "end": e} for a, e in spans]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def find(docs: DataFrame, benchmark: DataFrame, size: int = 10, slack: int = SLACK) -> DataFrame:
    """FOUND for each row of docs."""
    return search(build_index(docs), windows(benchmark, size), slack)


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs without those that hold a phrase; rows without an id stay.

    A phrase that a third of all documents hold makes a long list of ids, so the list is
    joined, not broadcast; Spark broadcasts it itself while it is small.
    """
    hit = find(docs, benchmark, size).where("contaminated").select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)
