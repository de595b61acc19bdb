"""Filters, limits and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..relation import ORD, PlanError, col, is_number, kind, need, operation, text_of, to_text, with_order

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def parsed(value: object, t: T.DataType) -> Column | None:
    """A literal to compare a number with: exact for integers, else a double."""
    if isinstance(value, bool) or value is None:
        return None
    text = str(value).strip()
    if isinstance(t, (*INTEGERS, T.DecimalType)):
        try:
            n = int(text)
            return F.lit(n) if -(1 << 63) <= n < 1 << 63 else F.lit(text).cast("decimal(38,0)")
        except ValueError:
            pass
    try:
        return F.lit(float(text))
    except ValueError:
        return None


def test(df: DataFrame, column: str, operator: str, value: object = None) -> Column:
    """The condition of one comparison. Null passes only isnull; NaN passes no ordered test but equals itself."""
    t = kind(df, column)
    c = col(column)
    if operator == "isnull":
        return c.isNull()
    if operator == "notnull":
        return c.isNotNull()
    shown = "true" if value is True else "false" if value is False else "" if value is None else str(value)
    if operator in ("contains", "startswith", "endswith"):
        text = text_of(c, t)
        if operator == "contains":
            return F.contains(F.lower(text), F.lit(shown.lower()))
        return text.startswith(shown) if operator == "startswith" else text.endswith(shown)
    # comparing the column itself, not a cast of it, lets the scan push the filter down
    literal = parsed(value, t) if is_number(t) else None
    if operator in ("==", "!="):
        if literal is not None:
            same = c == literal
        elif isinstance(t, T.StringType):
            same = c == F.lit(shown)
        else:
            same = text_of(c, t) == F.lit(shown)
        return same if operator == "==" else c.isNotNull() & ~same
    not_nan = ~F.isnan(c) if isinstance(t, (T.FloatType, T.DoubleType)) else F.lit(True)
    if operator == "between":
        low, _, high = shown.partition(",")
        return test(df, column, ">=", low.strip()) & test(df, column, "<=", high.strip())
    if is_number(t):
        if literal is None:
            raise PlanError(f"{value!r} is not a number")
        x: Column = c
    else:
        x, literal = (c if isinstance(t, T.StringType) else text_of(c, t)), F.lit(shown)
    out = {">": x > literal, ">=": x >= literal, "<": x < literal, "<=": x <= literal}
    if operator not in out:
        raise PlanError(f"there is no operator {operator!r}")
    return out[operator] & not_nan if isinstance(t, (T.FloatType, T.DoubleType)) else out[operator]


@operation("table.filter")
def filter_(df: DataFrame, column: str, operator: str, value: object = None) -> DataFrame:
    return df.where(test(df, column, operator, value))


@operation("table.limit")
def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + n in input order: a top-k of n + offset rows, not a sort of all."""
    out = with_order(df).orderBy(ORD)
    return out.offset(offset).limit(n) if offset else out.limit(n)


@operation("table.sample", "B")
def sample(df: DataFrame, n: int = 100, fraction: float | None = None, random_state: int | None = None, stratify_column: str | None = None) -> DataFrame:
    """An exact number of rows, those of the smallest seeded hashes; strata by group sizes."""
    df = with_order(df)
    draw = F.xxhash64(F.col(ORD), F.lit(random_state or 0))
    if stratify_column is None:
        k = n if fraction is None else round(df.count() * fraction)
        return df.orderBy(draw, ORD).limit(k)
    need(df, stratify_column)
    sizes = df.groupBy(to_text(df, stratify_column).alias("__stratum")).agg(F.count(F.lit(1)).alias("__size"))
    total = F.sum("__size").over(Window.partitionBy(F.lit(0)))
    share = F.floor(F.col("__size") * fraction) if fraction is not None else F.floor(F.col("__size") * n / total)
    sizes = sizes.withColumn("__take", F.greatest(share, F.lit(1)))
    marked = df.withColumn("__stratum", to_text(df, stratify_column)).withColumn("__draw", draw)
    both = marked.join(sizes, marked["__stratum"].eqNullSafe(sizes["__stratum"]))
    ranked = both.withColumn("__n", F.row_number().over(Window.partitionBy(sizes["__stratum"]).orderBy("__draw", ORD)))
    return ranked.where("__n <= __take").select(*[col(c) for c in df.columns])
