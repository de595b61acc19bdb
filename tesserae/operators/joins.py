"""Joins of two tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..relation import ORD, PlanError, col, data, kind, need, number, operation, ranges, with_order


def same_keys(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> None:
    need(left, *left_keys)
    need(right, *right_keys)
    if not left_keys or len(left_keys) != len(right_keys):
        raise PlanError("each side needs the same number of keys")
    for a, b in zip(left_keys, right_keys, strict=True):
        if kind(left, a) != kind(right, b):
            raise PlanError(f"keys {a!r} and {b!r} differ in type")


def renamed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[col(c).alias(prefix + c) for c in df.columns])


@operation("table.join", "BB")
def join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str = "inner") -> DataFrame:
    """Left columns but keys get _L, right ones _R; keys are those of the left, or of the right where there is no left row."""
    same_keys(left, right, left_keys, right_keys)
    modes = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}
    if how not in modes:
        raise PlanError(f"there is no join {how!r}")
    l, r = renamed(left, "l."), renamed(right, "r.")
    on = [col("l." + a) == col("r." + b) for a, b in zip(left_keys, right_keys, strict=True)]
    keys = {a: F.coalesce(col("l." + a), col("r." + b)) if how in ("right", "outer") else col("l." + a) for a, b in zip(left_keys, right_keys, strict=True)}
    out = [keys[c].alias(c) if c in keys else col("l." + c).alias(c + "_L") for c in data(left)]
    out += [col("r." + c).alias(c + "_R") for c in data(right) if c not in right_keys]
    order = [col("l." + ORD).alias(ORD)] if ORD in left.columns and how in ("inner", "left") else []
    return l.join(r, on, modes[how]).select(*out, *order)


def _exists(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], how: str) -> DataFrame:
    same_keys(left, right, left_keys, right_keys)
    r = right.select(*[col(b).alias(f"__k{n}") for n, b in enumerate(right_keys)])
    return left.join(r, [col(a) == F.col(f"__k{n}") for n, a in enumerate(left_keys)], how)


@operation("table.semi_join", "BB")
def semi_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    return _exists(left, right, left_keys, right_keys, "left_semi")


@operation("table.anti_join", "BB")
def anti_join(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str]) -> DataFrame:
    return _exists(left, right, left_keys, right_keys, "left_anti")


@operation("table.cross_join", "BB")
def cross_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product; columns of both sides get _x and _y."""
    a, b = data(left), data(right)
    l = left.select(*[col(c).alias(c + "_x" if c in b else c) for c in a])
    return l.crossJoin(right.select(*[col(c).alias(c + "_y" if c in a else c) for c in b]))


@operation("table.asof_join", "BB")
def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, left_by: list[str] = (), right_by: list[str] = (), direction: str = "backward", tolerance: float | None = None, allow_exact: bool = True) -> DataFrame:
    """The nearest right row of each left row: both sides in one sorted window per group, no pairs.

    The sort is linear in the rows of a group and streams; groups are the unit of distribution.
    Without keys, ranges of the right side's times are, each of which gets the last right row
    before it and the first one behind it.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise PlanError(f"there is no direction {direction!r}")
    left, right = with_order(left), with_order(right)
    left_by, right_by = list(left_by), list(right_by)
    if left_by:
        same_keys(left, right, left_by, right_by)
    elif right_by:
        raise PlanError("each side needs the same number of keys")
    taken = [c for c in data(right) if c != right_on and c not in right_by]
    lx, rx = number(left, left_on), number(right, right_on)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    by = [f"__b{k}" for k in range(len(left_by))]
    own = F.struct(*[col(c) for c in left.columns])
    other = F.struct(rx.alias("__x"), *[col(c).alias(f"__v{k}") for k, c in enumerate(taken)])
    l = left.select(*[col(c).alias(b) for b, c in zip(by, left_by, strict=True)], lx.alias("__at"), F.lit(True).alias("__isl"), F.col(ORD).alias("__o"), own.alias("__l"))
    r = right.where(finite(rx)).select(*[col(c).alias(b) for b, c in zip(by, right_by, strict=True)], rx.alias("__at"), F.lit(False).alias("__isl"), F.col(ORD).alias("__o"), other.alias("__r"))
    if right_by:
        r = r.where(" AND ".join(f"{b} IS NOT NULL" for b in by))
    both = l.unionByName(r, allowMissingColumns=True)
    groups = [F.col(b) for b in by]
    if not by:
        bucket, many = ranges(r, "__at")
        both = both.withColumn("__bucket", bucket)
        ends = r.withColumn("__bucket", bucket).groupBy("__bucket").agg(F.max_by("__r", F.struct("__at", "__o")).alias("__last"), F.min_by("__r", F.struct("__at", "__o")).alias("__first"))
        order = Window.orderBy("__bucket")
        filled = left.sparkSession.range(many).select(F.col("id").cast("int").alias("__bucket")).join(ends, "__bucket", "left")
        filled = filled.select("__bucket", F.last("__last", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__last"), F.first("__first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__first"))
        both = both.join(F.broadcast(filled), "__bucket")  # a row for each range
        groups = [F.col("__bucket")]

    def found(back: bool) -> Column:
        # with exact matches a left row sees right rows at its own time, so those come first
        left_late = allow_exact
        side = F.when(F.col("__isl"), 1 if left_late else -1).otherwise(0)
        if back:
            w = Window.partitionBy(*groups).orderBy(F.col("__at").asc_nulls_first(), side, F.col("__o")).rowsBetween(Window.unboundedPreceding, -1)
        else:
            w = Window.partitionBy(*groups).orderBy(F.col("__at").desc_nulls_last(), side, F.col("__o").desc()).rowsBetween(Window.unboundedPreceding, -1)
        inside = F.last("__r", ignorenulls=True).over(w)
        return inside if by else F.coalesce(inside, F.col("__last" if back else "__first"))

    if direction in ("backward", "nearest"):
        both = both.withColumn("__back", found(True))
    if direction in ("forward", "nearest"):
        both = both.withColumn("__fore", found(False))
    rows = both.where("__isl")

    def near(c: str) -> Column:
        ok = finite(F.col("__at")) & F.col(c).isNotNull()
        if by:
            for b in by:
                ok &= F.col(b).isNotNull()
        if tolerance is not None:
            ok &= F.abs(F.col("__at") - F.col(c + ".__x")) <= tolerance
        return F.when(ok, F.col(c))

    if direction == "nearest":
        b, f = near("__back"), near("__fore")
        hit = F.when(f.isNull() | (F.abs(F.col("__at") - b["__x"]) <= F.abs(f["__x"] - F.col("__at"))), b).otherwise(f)
    else:
        hit = near("__back" if direction == "backward" else "__fore")
    rows = rows.withColumn("__hit", hit)
    names = set(left.columns)
    return rows.select(*[F.col("__l")[c].alias(c) for c in left.columns], *[F.col("__hit")[f"__v{k}"].alias(c + "_R" if c in names else c) for k, c in enumerate(taken)])


def soundex_key(c: Column) -> Column:
    """Soundex of the ASCII letters only."""
    return F.soundex(F.regexp_replace(c, "[^A-Za-z]", ""))


@operation("table.fuzzy_join", "BB")
def fuzzy_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, metric: str, threshold: float, blocking: str = "prefix", blocking_param: int | None = None, how: str = "inner", score_column: str | None = None, max_candidates: int | None = 50, case_sensitive: bool = False) -> DataFrame:
    """Pairs of one block whose similarity reaches the threshold. A right block larger than max_candidates is an error."""
    if not 0 < threshold <= 1:
        raise PlanError("the threshold lies above 0 and up to 1")
    need(left, left_key)
    need(right, right_key)
    left = with_order(left)
    case = (lambda c: c) if case_sensitive else F.lower
    block = {"prefix": lambda c: F.substring(c, 1, blocking_param or 2), "soundex": soundex_key, "none": lambda c: F.lit("")}.get(blocking)
    if block is None:
        raise PlanError(f"there is no blocking {blocking!r}")
    l = renamed(left, "l.").withColumn("__a", case(col("l." + left_key)))
    l = l.withColumn("__block", block(F.col("__a")))
    r = right.select(*[col(c).alias("r." + c) for c in data(right)]).withColumn("__b", case(col("r." + right_key))).where("__b IS NOT NULL")
    r = r.withColumn("__block", block(F.col("__b")))
    if max_candidates is not None:
        sizes = r.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))
        sizes = sizes.where(F.when(F.col("__n") > max_candidates, F.raise_error(F.lit("rejected: a block has more than max_candidates rows"))).otherwise(F.lit(True)))
        r = r.join(sizes.select("__block"), "__block")
    keys = ["__block"]
    if blocking == "none":  # one block of all rows: the left side is dealt out, and the right side goes to each part
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        l = l.withColumn("__part", F.pmod(F.xxhash64(col("l." + ORD)), F.lit(parts)))
        r = r.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        keys.append("__part")
    pairs = l.where("__a IS NOT NULL").join(r, keys)
    pairs = pairs.withColumn("__score", similarity(metric, F.col("__a"), F.col("__b"))).where(F.col("__score") >= threshold)
    names = set(data(left))
    kept = [col("r." + c).alias(c + "_R" if c in names or c == right_key else c) for c in data(right)]
    score = [F.col("__score").alias(score_column)] if score_column else []
    if how == "inner":
        return pairs.select(*[col("l." + c).alias(c) for c in left.columns], *kept, *score)
    found = pairs.select(col("l." + ORD).alias("__o"), *[col("r." + c) for c in data(right)], "__score")
    out = renamed(left, "l.").join(found, col("l." + ORD) == F.col("__o"), "left")
    return out.select(*[col("l." + c).alias(c) for c in left.columns], *kept, *score)


def similarity(metric: str, a: Column, b: Column) -> Column:
    if metric == "levenshtein":
        longest = F.greatest(F.char_length(a), F.char_length(b))
        return F.when(longest == 0, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)
    if metric == "jaccard":
        words = lambda c: F.filter(F.array_distinct(F.split(c, r"\s+")), lambda w: w != "")
        union = F.size(F.array_union(words(a), words(b)))
        return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(words(a), words(b))) / union)
    if metric == "jaro_winkler":
        return jaro_winkler(a, b)
    raise PlanError(f"there is no metric {metric!r}")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler by array functions: p = 0.1 for up to four leading characters, whatever the Jaro value."""
    # greedy matching as a fold over the characters of a; taken holds the matched positions of b, in order of a
    reach = F.greatest(F.floor(F.greatest(F.char_length(a), F.char_length(b)) / 2) - 1, F.lit(0)).cast("int")

    def match(acc: Column, i: Column) -> Column:
        free = F.filter(F.sequence(F.greatest(i - reach, F.lit(1)), F.least(i + reach, F.char_length(b)).cast("int")), lambda j: (a.substr(i, F.lit(1)) == b.substr(j, F.lit(1))) & ~F.array_contains(acc, j))
        able = (F.greatest(i - reach, F.lit(1)) <= F.least(i + reach, F.char_length(b)))
        return F.when(able & (F.size(free) > 0), F.concat(acc, F.slice(free, 1, 1))).otherwise(acc)

    empty = F.array().cast("array<int>")
    taken = F.when((F.char_length(a) > 0) & (F.char_length(b) > 0), F.aggregate(F.sequence(F.lit(1), F.char_length(a).cast("int")), empty, match)).otherwise(empty)
    m = F.size(taken)
    in_order = F.sort_array(taken)
    # the matched characters of a, in a's order, are those of taken's positions in b
    moved = F.size(F.filter(F.zip_with(taken, in_order, lambda x, y: b.substr(x, F.lit(1)) != b.substr(y, F.lit(1))), lambda x: x))
    jaro = F.when((F.char_length(a) == 0) & (F.char_length(b) == 0), 1.0).when(m == 0, 0.0).otherwise((m / F.char_length(a) + m / F.char_length(b) + (m - moved / 2) / m) / 3)
    prefix = F.lit(0)
    for k in range(4, 0, -1):
        prefix = F.when((F.char_length(a) >= k) & (F.char_length(b) >= k) & (F.left(a, F.lit(k)) == F.left(b, F.lit(k))) & (prefix == 0), k).otherwise(prefix)
    return jaro + prefix * 0.1 * (1 - jaro)
