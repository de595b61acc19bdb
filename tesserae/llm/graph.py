"""Connected components, and small-world graphs over Hamming distance."""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spend, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of edges (a, b) but the roots, which are the smallest nodes of their components.

    Alternates large-star and small-star steps; each round is written to the shared folder.
    Nothing but a count and a checksum of the edges comes to the driver.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        if before is not None:
            spend(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("the components did not settle")


def distances(codes: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ one).sum(axis=-1, dtype=np.int32)


class SmallWorld:
    """A navigable small-world graph over the rows of codes (uint64 words), built by insertion.

    Of at most links + 1 rows each is linked to each, which is what insertion comes to.
    """

    def __init__(self, codes: np.ndarray, links: int = 12, beam: int = 24):
        self.codes = codes
        n = len(codes)
        self.complete = n <= links + 1
        if self.complete:
            self.near = [[j for j in range(n) if j != i] for i in range(n)]
            return
        self.near = [[] for _ in range(n)]
        for i in range(1, n):
            for _, j in self.search(codes[i], beam, i)[:links]:
                self.near[i].append(j)
                self.near[j].append(i)

    def search(self, code: np.ndarray, beam: int, size: int | None = None) -> list[tuple[int, int]]:
        """The best (distance, row) pairs that a beam search over the first size rows finds."""
        size = len(self.codes) if size is None else size
        starts = sorted({0, size // 2, size - 1})
        seen = set(starts)
        first = list(zip(distances(self.codes[starts], code).tolist(), starts, strict=True))
        todo, best = list(first), [(-d, -i) for d, i in first]
        heapq.heapify(todo)
        heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        while todo:
            d, i = heapq.heappop(todo)
            if len(best) >= beam and d > -best[0][0]:
                break
            fresh = [j for j in self.near[i] if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for e, j in zip(distances(self.codes[fresh], code).tolist(), fresh, strict=True):
                if len(best) < beam or e < -best[0][0]:
                    heapq.heappush(todo, (e, j))
                    heapq.heappush(best, (-e, -j))
                    if len(best) > beam:
                        heapq.heappop(best)
        return sorted((-d, -i) for d, i in best)

    def within(self, code: np.ndarray, radius: int, beam: int = 32, enough=None) -> list[tuple[int, int]]:
        """What is found within the radius; the beam doubles until it reaches beyond it, or until enough(found)."""
        while True:
            found = self.search(code, beam)
            near = [x for x in found if x[0] <= radius]
            if len(near) < beam or (enough is not None and enough(near)):
                return near
            beam *= 2


def exact(codes: np.ndarray, code: np.ndarray, radius: int) -> list[tuple[int, int]]:
    d = distances(codes, code)
    at = np.flatnonzero(d <= radius)
    return sorted(zip(d[at].tolist(), at.tolist(), strict=True))


class Shard:
    """Answers radius queries by a small-world graph whose recall is audited against exact search.

    audit: so many queries are compared with the exact search; if fewer than least of
    their neighbours are found, the beam is widened, and after three times the shard is
    scanned. recall has what the last audit measured.
    """

    def __init__(self, codes: np.ndarray, radius: int, audit: int = 16, least: float = 0.98):
        self.codes, self.radius, self.beam, self.recall = codes, radius, 32, 1.0
        self.graph: SmallWorld | None = SmallWorld(codes)
        while self.graph is not None and not self.graph.complete:
            rows = np.linspace(0, len(codes) - 1, audit).astype(int)
            want = [{j for _, j in exact(codes, codes[i], radius)} for i in rows]
            got = [{j for _, j in self.graph.within(codes[i], radius, self.beam)} for i in rows]
            self.recall = float(np.mean([len(g & w) / len(w) if w else 1.0 for g, w in zip(got, want, strict=True)]))
            if self.recall >= least:
                return
            self.beam *= 4
            if self.beam > 2048:
                self.graph = None

    def within(self, code: np.ndarray, enough=None) -> list[tuple[int, int]]:
        """(distance, row) within the radius, nearest first; all of them, or of the first beams until enough(found)."""
        return exact(self.codes, code, self.radius) if self.graph is None else self.graph.within(code, self.radius, self.beam, enough)
