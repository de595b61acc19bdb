"""Quality rules: a learned decision list over text statistics.

Sequential covering: one rule after another is grown by FOIL gain as a conjunction of
thresholds on two thirds of the labelled rows, pruned on the rest, and the rows that it
covers are set aside. The list becomes one ordered Spark CASE expression, so that
applying it needs no Python beyond the statistics themselves.

Edge cases: a null text has no words and fails the base rule; so does an empty one.
Repeated rows are judged alike. Labels that are null or disagree for an id: the lower
quality counts, nulls are left out. Without labels of both kinds the list is empty and
everything that passes the base rule is kept. judge() replaces columns of the names that
it makes and carries others along; accepted() carries all along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import append_columns

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_upper", "n_lower", "n_digits", "n_marks"]
#: Ratios that rules may test: numerator, denominator (at least 1).
RATIOS = {
    "mean_word": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "repeat_ratio": ("n_repeat_words", "n_words"),
    "line_words": ("n_words", "n_lines"),
    "distinct_ratio": ("n_distinct_words", "n_words"),
    "upper_ratio": ("n_upper", "n_letters"),
    "digit_ratio": ("n_digits", "word_chars"),
    "mark_ratio": ("n_marks", "n_words"),
}
FEATURES = [*RATIOS, "n_words"]


def repeated(words: list[bytes]) -> tuple[int, int]:
    """Words in three-word windows that occur at least twice, and the number of distinct words."""
    ids: dict[bytes, int] = {}
    new = ids.setdefault
    seq = [new(w, len(ids)) for w in words]
    size = len(ids)
    if len(seq) < 4 or size == len(seq):
        return 0, size
    x = np.array(seq, dtype=np.int64)
    if size < 2_000_000:
        key = (x[:-2] * size + x[1:-1]) * size + x[2:]
    else:  # three such numbers don't fit into 64 bits: number the pairs first
        _, pair = np.unique(x[:-2] * size + x[1:-1], return_inverse=True)
        key = pair.astype(np.int64) * size + x[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(x), dtype=bool)
    for k in range(3):
        hit[k : k + len(key)] |= twice
    return int(hit.sum()), size


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of one whole text; words are split at ASCII white space only."""
    if not text:
        return (0,) * len(COUNTS)
    raw = text.encode()
    words = raw.split()
    repeat, distinct = repeated(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(text) - sum(text.count(c) for c in " \t\n\r\x0b\x0c")
    kinds = np.bincount(KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=5)
    return (len(words), chars, int(kinds[4]), len(lines) - len(set(lines)), repeat, len(lines), distinct, *(int(k) for k in kinds[1:4]), text.count("!") + text.count("?"))


KIND = np.zeros(256, dtype=np.uint8)
KIND[ord("A") : ord("Z") + 1], KIND[ord("a") : ord("z") + 1], KIND[ord("0") : ord("9") + 1] = 1, 2, 3
KIND[[ord(c) for c in SYMBOLS]] = 4


def with_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    def make(b: pa.RecordBatch) -> list[pa.Array]:
        bpe.forget()  # a worker that tokenised before needs its memory for this
        rows = [statistics(t.as_py()) for t in b.column(b.schema.get_field_index("text"))]
        return [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]

    return append_columns(docs, [(n, "long", pa.int64()) for n in COUNTS], make, keep)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        x = feature(self.feature)
        return x > self.threshold if self.above else x <= self.threshold

    def holds(self, data: dict[str, np.ndarray]) -> np.ndarray:
        return data[self.feature] > self.threshold if self.above else data[self.feature] <= self.threshold


Rule = tuple[Test, ...]


def feature(name: str) -> Column:
    if name not in RATIOS:
        return F.col(name).cast("double")
    top, bottom = RATIOS[name]
    below = F.col("n_upper") + F.col("n_lower") if bottom == "n_letters" else F.col(bottom)
    return F.col(top).cast("double") / F.greatest(below, F.lit(1)).cast("double")


def covered(rule: Rule, data: dict[str, np.ndarray], size: int) -> np.ndarray:
    hit = np.ones(size, dtype=bool)
    for t in rule:
        hit &= t.holds(data)
    return hit


def grow(data: dict[str, np.ndarray], bad: np.ndarray, most: int = 4) -> Rule:
    """Adds the threshold of the best FOIL gain until no good row is covered or nothing is gained."""
    rule: list[Test] = []
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < most:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if not n0 or not p0:
            break
        best: tuple[float, Test | None] = (1e-9, None)
        before = np.log2(p0 / (p0 + n0))
        for name in FEATURES:
            x, y = data[name][inside], bad[inside]
            order = np.argsort(x, kind="stable")
            xs, cum = x[order], np.cumsum(y[order])
            ends = np.flatnonzero(xs[1:] > xs[:-1])
            if not len(ends):
                continue
            p_low, n_low = cum[ends], ends + 1 - cum[ends]
            for above in (False, True):
                p, n = (p0 - p_low, n0 - n_low) if above else (p_low, n_low)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - before), -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = float(gain[k]), Test(name, above, float((xs[ends[k]] + xs[ends[k] + 1]) / 2))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(data)
    return tuple(rule)


def worth(rule: Rule, data: dict[str, np.ndarray], bad: np.ndarray) -> float:
    hit = covered(rule, data, len(bad))
    p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
    return (p - n) / (p + n) if p + n else -1.0


def learn(data: dict[str, np.ndarray], bad: np.ndarray, precision: float = 0.9, most: int = 24, seed: int = 7) -> list[Rule]:
    """Rules that mark bad rows, each at least as precise as asked on the rows kept for pruning."""
    rules: list[Rule] = []
    if not bad.any() or bad.all():
        return rules
    for_growth = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), dtype=bool)
    while len(rules) < most:
        g, v = left & for_growth, left & ~for_growth
        if not (g & bad).any() or not (v & bad).any():
            break
        rule = grow({k: x[g] for k, x in data.items()}, bad[g])
        inside = {k: x[v] for k, x in data.items()}
        cut = max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r, inside, bad[v]), -len(r)), default=())
        hit = covered(cut, inside, int(v.sum()))
        if not cut or not hit.any() or bad[v][hit].mean() < precision:
            break
        rules.append(cut)
        left &= ~covered(cut, data, len(bad))
    return rules


def decision(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, 0 if none does."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column()
        for t in rule[1:]:
            test &= t.column()
        out = F.when(test, k) if out is None else out.when(test, k)
    return F.lit(0) if out is None else out.otherwise(0)


def training(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> list[Rule]:
    """Fits the list on at most sample_rows labelled rows, those of the smallest id hashes."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    # bounded by sample_rows, so this side may be broadcast
    marked = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    # of several texts of an id the one of the smallest hash, so that the sample doesn't depend on the plan
    marked = marked.groupBy("doc_id", "_quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = with_statistics(marked, keep=["_quality"]).where(~base_failed()).select("_quality", *[feature(f).alias(f) for f in FEATURES]).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    return learn({f: rows[f].to_numpy() for f in FEATURES}, rows["_quality"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, sample_rows: int = 10_000) -> DataFrame:
    """docs (or the columns in keep) with COUNTS, base_failed, rule (0: none) and kept."""
    rules = training(docs, labels, sample_rows)
    out = with_statistics(docs, keep).withColumn("base_failed", base_failed())
    return out.withColumn("rule", F.when(F.col("base_failed"), 0).otherwise(decision(rules)).cast("int")).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def accepted(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> DataFrame:
    """The rows of docs that are kept, with all their columns, whatever these are called."""
    mark = next("_in" * k + "_" for k in range(1, len(docs.columns) + 2) if not any(c.startswith("_in" * k + "_") for c in docs.columns))
    taken = [c for c in docs.columns if c in {*COUNTS, "base_failed", "rule", "kept"}]
    renamed = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(mark + c if c in taken else c) for c in docs.columns])
    out = judge(renamed, labels, sample_rows=sample_rows).where("kept")
    return out.select(*[F.col("`" + (mark + c if c in taken else c).replace("`", "``") + "`").alias(c) for c in docs.columns])


def describe(rules: list[Rule]) -> Iterator[str]:
    for rule in rules:
        yield " AND ".join(f"{t.feature} {'>' if t.above else '<='} {t.threshold:.6g}" for t in rule)
