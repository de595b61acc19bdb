"""Near-duplicate classes: SimHash shards searched by small-world graphs, edges verified.

Similarity is the Jaccard index of the sets of five-word shingles (a shorter text is one
shingle); documents linked by pairs of at least 0.8 form a class. Words are those of
decontaminate.words().

1. Texts of equal words collapse to their smallest doc_id. Each gets a 256-bit SimHash
   of its shingles and BANDS shard keys, each of ROWS min-hashes. Two texts of similarity
   0.8 share no key with a probability of (1 - 0.8**2)**12 = 5e-6. Only shards of two
   and more are searched; sharding by content keeps the search from growing as the square
   of the corpus, which random shards with all queries sent to each would do.
2. Search: shards of more than PART texts are split by id, and the text of the smallest id
   is sent to each part. In every part a small-world graph over the Hamming distance is
   built, and each text searches it with a beam that expands until an earlier text within
   RADIUS bits is found or the radius is passed (at similarity 0.8 the expected distance is
   39 bits, with a deviation of 6). It proposes its nearest earlier neighbour and the
   smallest id found. Proposals are verified on the whole texts and united.
3. Audit: the graph is held against exact search. In shards whose texts are in more than one
   component, those outside the component of the smallest id are sent as queries to every
   part, and texts within RADIUS of one of another component are found by a scan (texts of at
   most FEW shingles at any distance, as their SimHashes are coarse). Sketches of SKETCH bytes
   leave out pairs that are five deviations of their estimate below 0.8. For what is left,
   the common shingles with all texts of a part are counted exactly, and the links that the
   graph missed are united as well. Nothing is capped, and each step gives at most a row for
   a text and a component it is linked to. recall says which share of the unions the graph
   search had found.

Only ids, SimHashes and sketches travel in searches; texts and sets are joined to what is left.
n_links counts the verified links of a document's text that the union used; links inside a
component that is already united are not looked for.

Edge cases: null texts count as empty; all texts without words form one class. Rows that
share a doc_id are one document, whatever their texts; it is linked to all that any of its
texts is linked to. Null ids are left out of the classes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import file_system, spend, stored
from .decontaminate import FOLD, words
from .graph import Shard, components, distances
from .wordhash import hashes, mix

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 2
RADIUS = 62
#: Texts of so few shingles have SimHashes too coarse to rule anything out.
FEW = 64
#: Texts of a graph, and shingles of an inverted index.
PART, PART_SHINGLES = 512, 400_000
AUDIT_SHINGLES = 4_000_000
#: Rows of an Arrow batch where a row has two texts or a set.
LONG_ROWS = 500
#: Ranges of a sketch; a power of two.
SKETCH = 512
SIGNATURE = ["size", "s1", "s2", "s3", "s4"]
KEYS = [f"k{i}" for i in range(BANDS)]
BLOOM_BITS = 1 << 24
#: Odd multipliers of the min-hashes and of the shingle polynomial.
MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WEIGHTS = np.random.default_rng(12).integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(x: np.ndarray) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of word hashes."""
    if not len(x):
        return x
    size = min(SHINGLE, len(x))
    total = x[: len(x) - size + 1] * WEIGHTS[0]
    for k in range(1, size):
        total += x[k : len(x) - size + 1 + k] * WEIGHTS[k]
    return np.unique(mix(total))


def shingles_of(text: str | None) -> np.ndarray:
    return shingles(hashes(text.encode().translate(FOLD))) if text else EMPTY


EMPTY = np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> bytes:
    """One byte of the least shingle hash in each of SKETCH ranges of hashes, 0 for none: shares of equal bytes estimate similarity."""
    out = np.zeros(SKETCH, np.uint8)
    bins = s >> np.uint64(64 - SKETCH.bit_length() + 1)
    first = np.flatnonzero(np.diff(bins, prepend=np.uint64(1 << 63)))
    out[bins[first]] = (s[first] % np.uint64(255)).astype(np.uint8) + 1
    return out.tobytes()


def likely(one: np.ndarray, many: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Which of many sketches may be as similar to one as SIMILARITY: the estimate, five deviations and a bit up.

    Where there are about as many bytes as shingles, nearly all shingles are compared, which
    narrows the deviation as in any sample from a finite whole.
    """
    there = np.count_nonzero((many != 0) | (one != 0), axis=1)
    same = np.count_nonzero((many == one) & (one != 0), axis=1)
    union = (size + sizes) / (1 + SIMILARITY)
    rest = np.clip((union - there) / np.maximum(union - 1, 1), 0, 1)
    return same >= SIMILARITY * there - 5 * np.sqrt(SIMILARITY * (1 - SIMILARITY) * there * rest) - 2


def simhash(s: np.ndarray) -> bytes:
    votes = np.zeros(256, np.int64)
    for at in range(0, len(s), 255 * 32):
        part = [s[at : at + 255 * 32]]
        while len(part) < 4:
            part.append(mix(part[-1] ^ np.uint64(0x9E3779B97F4A7C15)))
        bits = np.unpackbits(np.stack(part, axis=1).view(np.uint8).reshape(-1, 32), axis=1)
        for low in range(0, len(bits), 255):
            votes += bits[low : low + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(s)).tobytes()


def bands(s: np.ndarray) -> np.ndarray:
    """A signed 64-bit shard key for each band."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 4096):
        x = s[at : at + 4096, None] * MULTIPLIERS
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(ROWS):
        key = mix(key + rows[:, k])
    return key.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the words and eight bytes of it, sketch, number of shingles, s1 to s4 (the SimHash), KEYS; no keys for texts without words."""
    fields = [("doc_id", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary()), *[(c, pa.int64()) for c in ["code", *SIGNATURE, *KEYS]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()  # a worker that tokenised before needs its memory for this
        for b in batches:
            digests, sketches, sizes, codes, keys = [], [], [], [], []
            for t in b.column(1):
                plain = b" ".join(words(t.as_py()))
                digests.append(xxhash.xxh3_128_digest(plain))
                s = shingles(hashes(plain))
                sketches.append(sketch(s))
                sizes.append(len(s))
                codes.append(simhash(s))
                keys.append(bands(s))
            code, key, empty = np.frombuffer(b"".join(codes), np.int64).reshape(-1, 4), np.array(keys, np.int64).reshape(-1, BANDS), np.array(sizes) == 0
            made = [pa.array(digests, pa.binary()), pa.array(sketches, pa.binary()), pa.array([int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()), pa.array(sizes, pa.int64()), *[pa.array(code[:, k]) for k in range(4)], *[pa.array(key[:, k], mask=empty) for k in range(BANDS)]]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *made], names=[n for n, _ in fields])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(run, ", ".join(f"{n} {'binary' if t == pa.binary() else 'long'}" for n, t in fields))


def alike(m, n):
    """Whether sets of these sizes can be similar enough; of numbers or arrays."""
    return np.minimum(m, n) >= SIMILARITY * np.maximum(m, n)


def proposals(rows: DataFrame) -> DataFrame:
    """The search over (shard, part, rep, SIGNATURE), sorted within partitions: pairs (a, b) with a < b."""

    def pairs(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> Iterator[tuple[int, int]]:
        shard = Shard(codes, RADIUS)
        for i in range(1, len(ids)):
            earlier = lambda near: [j for _, j in near if j < i and ids[j] < ids[i] and alike(sizes[i], sizes[j])]  # noqa: B023, E731
            found = earlier(shard.within(codes[i], earlier))
            if found:
                for j in {found[0], min(found)}:
                    yield int(ids[j]), int(ids[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in groups(batches, 2):
            if len(columns[2]) > 1:
                yield from written(pairs(columns[2], columns[3], np.stack(columns[4:8], axis=1).view(np.uint64)))

    return rows.select("shard", "part", "rep", *SIGNATURE).mapInArrow(collected(run), "a long, b long").distinct()


def jaccard(s: np.ndarray, t: np.ndarray) -> float:
    """Of two sorted sets: equal neighbours in the merged array are common."""
    m = np.concatenate([s, t])
    m.sort(kind="stable")
    common = int((m[1:] == m[:-1]).sum())
    return common / max(1, len(m) - common)


class Parts:
    """Goes through sorted Arrow batches of (shard, part, query, rep, ...) part by part."""

    def __init__(self, batches: Iterator[pa.RecordBatch], open_part, ask):
        """open_part(texts): what queries are put to; ask(opened, queries). Both get the columns behind query as lists of arrays."""
        self.batches, self.open_part, self.ask = batches, open_part, ask

    def __iter__(self) -> Iterator[object]:
        """The answers; None after each part."""
        at, held, opened = None, [], None
        for b in self.batches:
            c = [x.to_numpy(zero_copy_only=False) for x in b.columns]
            changes = np.flatnonzero((c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]) | (c[2][1:] != c[2][:-1])) + 1
            for k, e in zip([0, *changes.tolist()], [*changes.tolist(), b.num_rows], strict=True):
                if k == e:
                    continue
                if at != (c[0][k], c[1][k]):
                    if opened is not None:
                        yield opened, None
                    at, held, opened = (c[0][k], c[1][k]), [], None
                own = [x[k:e] for x in c[3:]]
                if not c[2][k]:
                    held.append(own)
                elif held:
                    if opened is None:
                        opened = self.open_part(int(at[0]), [np.concatenate(x) for x in zip(*held, strict=True)])
                    yield opened, self.ask(opened, own)
        if opened is not None:
            yield opened, None


def near_misses(rows: DataFrame) -> DataFrame:
    """The audit's exact search over (shard, part, query, rep, SIGNATURE, root, main, sketch), sorted: (shard, rep) of texts that may be similar to one of another component."""

    def opened(shard: int, c: list[np.ndarray]) -> dict:
        return {"shard": shard, "ids": c[0], "sizes": c[1], "codes": np.stack(c[2:6], axis=1).view(np.uint64), "root": c[6], "sketches": np.frombuffer(b"".join(c[8]), np.uint8).reshape(-1, SKETCH), "hit": np.zeros(len(c[0]), bool)}

    def ask(x: dict, c: list[np.ndarray]) -> list[int]:
        out = []
        codes = np.stack(c[2:6], axis=1).view(np.uint64)
        for k, (rep, size, root, main) in enumerate(zip(c[0].tolist(), c[1].tolist(), c[6].tolist(), c[7].tolist(), strict=True)):
            # two queries meet twice: the later one counts
            hit = np.flatnonzero(((distances(x["codes"], codes[k]) <= RADIUS) | (size <= FEW)) & (x["root"] != root) & ((x["root"] == main) | (x["ids"] < rep)) & alike(size, x["sizes"]))
            if len(hit):
                hit = hit[likely(np.frombuffer(c[8][k], np.uint8), x["sketches"][hit], size, x["sizes"][hit])]
            if len(hit):
                x["hit"][hit] = True
                out.append(rep)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, found in Parts(batches, opened, ask):
            reps = x["ids"][x["hit"]] if found is None else found
            if len(reps):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(reps), x["shard"])), pa.array(reps, pa.int64())], names=["shard", "rep"])

    return rows.select("shard", "part", "query", "rep", *SIGNATURE, "root", "main", "sketch").mapInArrow(run, "shard long, rep long").distinct()


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """rep, code and the set of shingles of each text of the documents that ids (one column) names, and of a few more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = [b" ".join(words(t.as_py())) for t in b.column(1)]
            codes = [int.from_bytes(xxhash.xxh3_128_digest(p)[:8], "little", signed=True) for p in plain]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(codes, pa.int64()), pa.array([shingles(hashes(p)).tobytes() for p in plain], pa.binary())], names=["rep", "code", "set"])

    return touched(docs, ids).mapInArrow(run, "rep long, code long, set binary").dropDuplicates(["rep", "code"])


class Inverted:
    """For each shingle the sets that have it."""

    def __init__(self, sets: list[np.ndarray]):
        flat, rows = np.concatenate([EMPTY, *sets]), np.repeat(np.arange(len(sets)), list(map(len, sets)))
        order = np.argsort(flat, kind="stable")
        self.names, first = np.unique(flat[order], return_index=True)
        self.bounds, self.rows, self.many = np.append(first, len(flat)), rows[order], len(sets)

    def common(self, s: np.ndarray) -> np.ndarray:
        """The number of shingles that a set has in common with each of the sets."""
        if not len(self.names):
            return np.zeros(self.many, np.int64)
        at = np.minimum(np.searchsorted(self.names, s), len(self.names) - 1)
        at = at[self.names[at] == s]
        low, n = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        places = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.rows[places], minlength=self.many)


def missed(rows: DataFrame) -> DataFrame:
    """The links that the search missed, over (shard, part, query, rep, size, root, main, set), sorted: pairs (a, b) of similar texts of two components.

    The sets of a part are an inverted index, so that a query's common shingles with all of
    them are counted at once. Of the texts of one component only the most similar one counts.
    """

    def opened(shard: int, c: list[np.ndarray]) -> dict:
        return {"ids": c[0], "sizes": c[1], "root": c[2], "index": Inverted([np.frombuffer(s, np.uint64) for s in c[4]])}

    def ask(x: dict, c: list[np.ndarray]) -> list[tuple[int, int]]:
        out = []
        for rep, size, root, main, raw in zip(c[0].tolist(), c[1].tolist(), c[2].tolist(), c[3].tolist(), c[4], strict=True):
            common = x["index"].common(np.frombuffer(raw, np.uint64))
            hit = np.flatnonzero((common >= SIMILARITY * (size + x["sizes"] - common)) & (x["root"] != root) & ((x["root"] == main) | (x["ids"] < rep)))
            best: dict[int, int] = {}
            for j in hit[np.argsort(-common[hit], kind="stable")].tolist():
                best.setdefault(int(x["root"][j]), j)
            out += [(min(rep, int(x["ids"][j])), max(rep, int(x["ids"][j]))) for j in best.values()]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in Parts(batches, opened, ask):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return rows.select("shard", "part", "query", "rep", "size", "root", "main", "set").mapInArrow(run, "a long, b long").where("a <> b").distinct()


def groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[list[np.ndarray]]:
    """The long columns of each run of rows that agree in the first columns."""
    kept: list[np.ndarray] | None = None
    for b in batches:
        if not b.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if kept is not None:
            columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
        changes = np.zeros(len(columns[0]) - 1, bool)
        for c in columns[:by]:
            changes |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist()]
        for a, e in zip(cuts, cuts[1:], strict=False):
            yield [c[a:e] for c in columns]
        kept = [c[cuts[-1] :] for c in columns]
    if kept is not None:
        yield kept


def written(pairs: Iterator[tuple[int, int]], size: int = 50_000) -> Iterator[list[tuple[int, int]]]:
    out = []
    for p in pairs:
        out.append(p)
        if len(out) >= size:
            yield out
            out = []
    if out:
        yield out


def collected(run):
    """Gathers lists of pairs to Arrow batches."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for some in run(source):
            out += some
            if len(out) >= 50_000:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
        x = np.unique(np.array(out, np.int64), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

    return batches


def touched(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents that ids (one column) names, and a few more: a bitmap of fixed size spares the others the shuffle."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(BLOOM_BITS))
    own_bits = ids.select(bit(ids.columns[0]).alias("bit"))
    words = own_bits.groupBy(F.shiftright("bit", 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 as int)))").alias("bits"))
    # at most BLOOM_BITS / 32 rows
    own = docs.where("doc_id IS NOT NULL").select("doc_id", "text").withColumn("bit", bit("doc_id"))
    there = own.join(F.broadcast(words), F.shiftright("bit", 5) == F.col("w"))
    return there.where("(shiftright(bits, cast(bit & 31 as int)) & 1) = 1").select("doc_id", "text")


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of documents of which two whole texts have a Jaccard index of SIMILARITY or more."""
    own = touched(docs, pairs.select("a").union(pairs.select("b"))).withColumn("h", F.xxhash64("text")).dropDuplicates(["doc_id", "h"])
    both = pairs.join(own.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").join(own.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, object, np.ndarray] = (None, None, np.zeros(0, np.uint64))
        for x in batches:
            out = []
            for a, b, tb, ta in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2), x.column(3), strict=True):
                text = ta.as_py()
                if a != last[0] or text != last[1]:
                    last = a, text, shingles_of(text)
                if jaccard(last[2], shingles_of(tb.as_py())) >= SIMILARITY:
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return both.select("a", "b", "tb", "ta").mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), n_links and recall for each document."""
    own = stored(signatures(docs), "signatures")
    known = stored(own.groupBy("digest").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ["code", *SIGNATURE, *KEYS]]), "texts")
    member = stored(own.select("doc_id", "digest").join(known.select("digest", "rep"), "digest").select("doc_id", "rep"), "members")
    banded = stored(known.where("size > 0").select(F.explode(F.array(*KEYS)).alias("shard"), "rep", "code", *SIGNATURE), "bands")
    spend(known)
    sizes = stored(banded.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("hub")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / PART)).drop("n"), "shard-sizes")
    shards = stored(banded.join(sizes, "shard"), "shards")
    spend(banded, sizes)
    part = F.pmod(F.xxhash64("rep"), F.col("parts"))
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    columns = ["shard", "part", "rep", *SIGNATURE]
    hubs = shards.where("parts > 1 AND rep = hub").withColumn("part", everywhere)
    first = shards.withColumn("part", part).select(*columns).unionByName(hubs.select(*columns))
    pairs = stored(proposals(first.repartition("shard", "part").sortWithinPartitions("shard", "part", "rep")), "pairs")
    links = stored(verified(docs, pairs), "links", LONG_ROWS)
    spend(pairs)
    # texts of one doc_id are one document
    several = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").drop("z")
    same = stored(member.join(several, "doc_id").select("a", F.col("rep").alias("b")).where("a <> b").distinct(), "same")
    roots = components(links.unionByName(same))
    by_search = roots.count()
    rooted = stored(with_root(shards, roots, "root"), "rooted")
    spend(shards)
    mixed = stored(rooted.groupBy("shard").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.when(F.col("rep") == F.col("hub"), F.col("root"))).alias("main")).where("low < high").select("shard", "main"), "mixed")
    left = stored(rooted.join(mixed, "shard"), "left")
    # the texts that are left, with their sketches; a row of that id and digest stands for all of them
    sketched = own.select(F.col("doc_id").alias("rep"), "code", "sketch").join(left.select("rep", "code").distinct(), ["rep", "code"], "left_semi").groupBy("rep", "code").agg(F.first("sketch").alias("sketch"))
    open_ = stored(left.join(sketched, ["rep", "code"]), "open")
    spend(own, rooted, mixed, left)
    if not open_.isEmpty():
        columns = ["shard", "part", "query", "rep", *SIGNATURE, "root", "main", "sketch"]
        near = stored(near_misses(asked(open_, columns)), "near-misses")
        again = stored(open_.drop("sketch", "parts").join(near, ["shard", "rep"]), "again")
        spend(open_, near)
        parts = again.groupBy("shard").agg(F.ceil(F.sum("size") / PART_SHINGLES).alias("parts"))
        sized = stored(again.join(stored(parts, "parts"), "shard"), "sized")
        spend(again)
        sets = stored(shingle_sets(docs, sized.select("rep").distinct()), "sets", LONG_ROWS)
        columns = ["shard", "part", "query", "rep", "size", "root", "main", "set"]
        new = stored(missed(asked(sized.join(sets, ["rep", "code"]), columns)), "links", LONG_ROWS)
        spend(sized, sets)
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(new))
    total = roots.count()
    degrees = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    facts = stored(degrees.join(roots.withColumnRenamed("node", "rep"), "rep", "full"), "facts")
    out = member.join(facts, "rep", "left").select("doc_id", F.coalesce("root", "rep").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("n_links").alias("n_links")).withColumn("recall", F.lit(by_search / total if total else 1.0))


def asked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The texts of each shard that is in parts, and behind them, as queries, those outside the main component.

    Texts are dealt to as many parts as rows says and queries likewise, and each part of
    texts meets each part of queries by itself, so no task gets more than two parts.
    """
    own = lambda *c: F.pmod(F.xxhash64(*c), F.col("parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    there = rows.withColumn("other", every).withColumn("part", own("rep") * F.col("parts") + F.col("other")).withColumn("query", F.lit(0)).select(*columns)
    queries = rows.where("root <> main").withColumn("other", every).withColumn("part", F.col("other") * F.col("parts") + own("rep", F.lit(1))).withColumn("query", F.lit(1)).select(*columns)
    return there.unionByName(queries).repartition("shard", "part").sortWithinPartitions("shard", "part", "query", "rep")


def with_root(rows: DataFrame, roots: DataFrame, name: str) -> DataFrame:
    """rows with the root of their rep, which is rep itself outside the components."""
    return rows.join(roots.select(F.col("node").alias("rep"), F.col("root").alias(name)), "rep", "left").withColumn(name, F.coalesce(name, "rep"))


def audit(docs: DataFrame, found: DataFrame, every: int = 100) -> DataFrame:
    """Links of the documents whose id is divisible by every, against all documents: doc_id, other and whether found has them in one class.

    found has doc_id and class_id. This is brute force, by an inverted index of the queries'
    shingles: every row meets every slice of AUDIT_SHINGLES of them, whatever its shard. Texts
    without words are left out.
    """
    asked_ = docs.where(f"doc_id % {every} = 0").select("doc_id", "text")
    joined = asked_.join(found.select("doc_id", "class_id"), "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingles_of(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2).cast(pa.int64()), pa.array([s.tobytes() for s in made], pa.binary()), pa.array(list(map(len, made)), pa.int64())], names=["doc_id", "class_id", "set", "size"])

    queries = stored(joined.mapInArrow(sets, "doc_id long, class_id long, set binary, size long").where("size > 0"), "audit", LONG_ROWS)
    slices = max(1, -(-(queries.agg(F.sum("size")).first()[0] or 0) // AUDIT_SHINGLES))
    cut = stored(queries.repartition(slices), "audit-slices", LONG_ROWS)
    spend(queries)
    folder = cut.stored_at

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        files = sorted(f.path for f in fs.get_file_info(FileSelector(base)) if f.path.endswith(".parquet"))
        kept: tuple = ("",)
        for b in batches:
            own = [shingles_of(t.as_py()) for t in b.column(1)]
            out = []
            for f in files:
                if kept[0] != f:
                    t = pq.read_table(f, filesystem=fs)
                    kept = f, *(t.column(c).to_numpy() for c in ("doc_id", "class_id", "size")), Inverted([np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()])
                _, ids, classes_, sizes, index = kept
                for i, c, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), own, strict=True):
                    common = index.common(s)
                    for j in np.flatnonzero((common > 0) & (common >= SIMILARITY * (len(s) + sizes - common)) & (ids != i)).tolist():
                        out.append((int(ids[j]), i, c == int(classes_[j])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["doc_id", "other", "found"])

    rows = docs.select("doc_id", "text").join(found.select("doc_id", "class_id"), "doc_id")
    return rows.mapInArrow(run, "doc_id long, other long, found boolean").groupBy("doc_id", "other").agg(F.max("found").alias("found"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without those that have an earlier document in their class; rows without an id stay."""
    later = classes(docs).where("doc_id <> class_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
