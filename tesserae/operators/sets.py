"""Unions, set operations and table comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..relation import ORD, PlanError, col, data, need, operation, text_of
from .joins import same_keys


def alike(left: DataFrame, right: DataFrame) -> None:
    if [(c, left.schema[c].dataType) for c in data(left)] != [(c, right.schema[c].dataType) for c in data(right)]:
        raise PlanError("the schemas differ")


def bare(df: DataFrame) -> DataFrame:
    return df.drop(ORD)


@operation("table.concat", "B", inputs=-1)
def concat(*frames: DataFrame, ignore_index: bool = False) -> DataFrame:
    for f in frames[1:]:
        alike(frames[0], f)
    out = bare(frames[0])
    for f in frames[1:]:
        out = out.union(bare(f))
    return out


@operation("table.concat_by_name", "B", inputs=-1)
def concat_by_name(*frames: DataFrame, strict: bool = False) -> DataFrame:
    types: dict[str, object] = {}
    for f in frames:
        if strict and data(f) != data(frames[0]):
            raise PlanError("the columns differ")
        for c in data(f):
            if types.setdefault(c, f.schema[c].dataType) != f.schema[c].dataType:
                raise PlanError(f"column {c!r} differs in type")
    out = bare(frames[0])
    for f in frames[1:]:
        out = out.unionByName(bare(f), allowMissingColumns=True)
    return out


@operation("table.union_distinct", "BB")
def union_distinct(left: DataFrame, right: DataFrame) -> DataFrame:
    alike(left, right)
    return bare(left).union(bare(right)).distinct()


@operation("table.intersect", "BB")
def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    alike(left, right)
    return bare(left).intersect(bare(right))


@operation("table.except", "BB")
def except_(left: DataFrame, right: DataFrame) -> DataFrame:
    alike(left, right)
    return bare(left).subtract(bare(right))


@operation("table.table_diff", "BB")
def table_diff(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], compare_columns: list[str] = (), include_unchanged: str = "no", separator: str = "#") -> DataFrame:
    """One full join on the keys; a key that is there twice on a side ends the query."""
    same_keys(left, right, left_keys, right_keys)
    compared = list(compare_columns) or [c for c in data(left) if c not in left_keys and c in right.columns]
    need(left, *compared)
    need(right, *compared)

    def side(df: DataFrame, keys: list[str], p: str) -> DataFrame:
        n = F.count(F.lit(1)).over(Window.partitionBy(*[col(k) for k in keys]))
        df = df.withColumn("__n", n).where(F.when(F.col("__n") > 1, F.raise_error(F.lit("rejected: validation.duplicate_key"))).otherwise(F.lit(True))).drop("__n")
        return df.select(*[col(c).alias(p + c) for c in data(df)], F.lit(True).alias(p + "__there"))

    l, r = side(left, left_keys, "l."), side(right, right_keys, "r.")
    on = [col("l." + a).eqNullSafe(col("r." + b)) for a, b in zip(left_keys, right_keys, strict=True)]
    both = l.join(r, on, "full")
    old, new = col("l.__there").isNotNull(), col("r.__there").isNotNull()
    changed = F.array().cast("array<string>") if not compared else F.filter(F.array(*[F.when(~col("l." + c).eqNullSafe(col("r." + c)), F.lit(c)) for c in compared]), lambda x: x.isNotNull())
    both = both.withColumn("__changed", changed)
    status = F.when(~new, "DELETED").when(~old, "ADDED").when(F.size("__changed") > 0, "MODIFIED").otherwise("UNCHANGED")
    both = both.withColumn("_diff_status", status)
    if include_unchanged != "yes":
        both = both.where("_diff_status <> 'UNCHANGED'")
    olds = F.array(*[F.when(~col("l." + c).eqNullSafe(col("r." + c)), F.coalesce(text_of(col("l." + c), left.schema[c].dataType), F.lit(""))) for c in compared]) if compared else F.array().cast("array<string>")
    modified = F.col("_diff_status") == "MODIFIED"
    keys = [F.coalesce(col("r." + b), col("l." + a)).alias(a) for a, b in zip(left_keys, right_keys, strict=True)]
    values = [F.when(new, col("r." + c)).otherwise(col("l." + c)).alias(c) if "r." + c in both.columns else col("l." + c).alias(c) for c in data(left) if c not in left_keys]
    return both.select(*keys, *values, "_diff_status", F.when(modified, F.array_join("__changed", separator)).otherwise("").alias("_diff_columns"), F.when(modified, F.array_join(F.filter(olds, lambda x: x.isNotNull()), separator)).otherwise("").alias("_diff_old_values"))


