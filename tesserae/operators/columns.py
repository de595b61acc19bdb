"""Projection: choosing, naming and computing columns row by row."""

from __future__ import annotations

import json
import math
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..relation import ORD, PlanError, col, data, is_number, kind, literal, need, new_name, no_repeats, number, operation, ranges, refuse, to_text, with_order
from .filters import test

ATOMS = {"str": "string", "string": "string", "utf8": "string", "int": "long", "int64": "long", "float": "double", "float64": "double", "bool": "boolean", "boolean": "boolean", "date32": "date", "date": "date", "timestamp_millis": "timestamp_ntz", "decimal128": "decimal(38,10)", "uint64": "decimal(20,0)", "binary": "binary"}


@operation("table.select_columns")
def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    if not columns:
        raise PlanError("no columns are chosen")
    need(df, *columns)
    no_repeats(columns)
    return df.select(*[col(c) for c in columns], *[col(ORD)] * (ORD in df.columns))


@operation("table.drop_columns")
def drop_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[col(c) for c in df.columns if c not in columns])


@operation("table.rename")
def rename(df: DataFrame, renames: list[dict]) -> DataFrame:
    to = {r["old_name"]: new_name(r["new_name"]) for r in renames}
    no_repeats([to.get(c, c) for c in df.columns])
    return df.select(*[col(c).alias(to.get(c, c)) for c in df.columns])


@operation("table.reorder_columns")
def reorder_columns(df: DataFrame, columns: list[str] = (), alphabetical: bool = False) -> DataFrame:
    need(df, *columns)
    rest = [c for c in data(df) if c not in columns]
    if alphabetical:
        rest.sort(key=str.lower)
    return df.select(*[col(c) for c in [*columns, *rest]], *[col(ORD)] * (ORD in df.columns))


@operation("table.align_schema")
def align_schema(df: DataFrame, columns: list[dict], keep_extra: bool = False) -> DataFrame:
    """columns: {name, type, default}. Types have to agree; nothing is cast."""
    out = []
    for c in columns:
        want = T._parse_datatype_string(ATOMS.get(c["type"], c["type"]))
        if c["name"] in df.columns:
            if kind(df, c["name"]) != want:
                raise PlanError(f"column {c['name']!r} has another type")
            out.append(col(c["name"]))
        else:
            out.append(literal(c.get("default")).cast(want).alias(c["name"]))
    names = [c["name"] for c in columns]
    extra = [c for c in df.columns if c not in names and (keep_extra or c == ORD)]
    return df.select(*out, *[col(c) for c in extra])


@operation("table.add_row_number", "B")
def add_row_number(df: DataFrame, output_column: str = "row_number", start: int = 1, partition_column: str | None = None, order_column: str | None = None, ascending: bool = True) -> DataFrame:
    """Numbers rows in input order. Without a partition the numbers come from counts per partition, so no task sees all rows."""
    if order_column is not None:
        raise PlanError("order_column is not supported: rows are numbered in input order")
    df = with_order(df)
    if partition_column is not None:
        need(df, partition_column)
        return df.withColumn(new_name(output_column), F.row_number().over(Window.partitionBy(col(partition_column)).orderBy(ORD)).cast("long") + (start - 1))
    return numbered(df, output_column, start)


def numbered(df: DataFrame, name: str, start: int) -> DataFrame:
    """Global row numbers over a range exchange: ranges of ORD are counted, then numbered within."""
    marked = df.withColumn("__bucket", ranges(df)[0])
    # at most as many rows as shuffle partitions
    counts = marked.groupBy("__bucket").count().withColumn("__before", F.sum("count").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = F.broadcast(counts.select("__bucket", F.coalesce("__before", F.lit(0)).alias("__before")))
    row = F.row_number().over(Window.partitionBy("__bucket").orderBy(ORD))
    return marked.join(before, "__bucket").withColumn(new_name(name), (row + F.col("__before") + (start - 1)).cast("long")).drop("__bucket", "__before")


@operation("table.uuid_generator")
def uuid_generator(df: DataFrame, output_column: str = "uuid") -> DataFrame:
    """Random identifiers of version 4: a digest of a secret of this call and the row's position, so a row that is computed again keeps its own."""
    names, df = df.columns, with_order(df)
    h = F.sha2(F.concat_ws(":", F.lit(uuid.uuid4().hex), F.col(ORD).cast("string")), 256)
    variant = F.substr(F.lit("89ab"), F.conv(F.substr(h, F.lit(17), F.lit(1)), 16, 10).cast("int") % 4 + 1, F.lit(1))
    parts = [F.substr(h, F.lit(1), F.lit(8)), F.substr(h, F.lit(9), F.lit(4)), F.concat(F.lit("4"), F.substr(h, F.lit(14), F.lit(3))), F.concat(variant, F.substr(h, F.lit(18), F.lit(3))), F.substr(h, F.lit(21), F.lit(12))]
    out = df.withColumn(new_name(output_column), F.concat_ws("-", *parts))
    return out if ORD in names else out.drop(ORD)


@operation("table.coalesce")
def coalesce(df: DataFrame, columns: list[str], output_column: str) -> DataFrame:
    need(df, *columns)
    if len({str(kind(df, c)) for c in columns}) != 1:
        raise PlanError("the columns differ in type")
    return df.withColumn(new_name(output_column), F.coalesce(*[col(c) for c in columns]))


@operation("table.conditional")
def conditional(df: DataFrame, column: str, conditions: list[dict], default_value: object = "", output_column: str = "result") -> DataFrame:
    """conditions: {operator, value, result}. The output is a number if every result is one or empty, else text."""
    results = [c["result"] for c in conditions] + [default_value]

    def as_number(v: object) -> float | None:
        if isinstance(v, bool):
            return math.nan
        if v is None or v == "":
            return None
        try:
            return float(str(v).replace(",", "."))
        except ValueError:
            return math.nan

    numbers = [as_number(v) for v in results]
    if all(n is None or not math.isnan(n) for n in numbers):
        value = lambda k: F.lit(numbers[k]).cast("double")
    else:
        value = lambda k: F.lit("" if results[k] is None else json.dumps(results[k]) if not isinstance(results[k], str) else results[k])
    out = None
    for k, c in enumerate(conditions):
        t = test(df, column, c["operator"], c.get("value"))
        out = F.when(t, value(k)) if out is None else out.when(t, value(k))
    out = value(-1) if out is None else out.otherwise(value(len(results) - 1))
    return df.withColumn(new_name(output_column), out)


@operation("table.lookup")
def lookup(df: DataFrame, column: str, mapping: dict, default: object = None, output_column: str | None = None) -> DataFrame:
    """Maps texts by a dictionary; large dictionaries are joined instead of written into the plan."""
    text = to_text(df, column)
    shown = lambda v: v if isinstance(v, str) else json.dumps(v)
    out = new_name(output_column or column)
    miss = text if default is None else F.lit(shown(default))
    if len(mapping) <= 1000:
        pairs = [F.lit(x) for k, v in mapping.items() for x in (k, shown(v))]
        hit = F.try_element_at(F.create_map(*pairs), text) if pairs else F.lit(None).cast("string")
        return df.withColumn(out, F.when(text.isNotNull(), F.coalesce(hit, miss)))
    side = df.sparkSession.createDataFrame([(k, shown(v)) for k, v in mapping.items()], "__key string, __value string")
    return df.withColumn("__key", text).join(side, "__key", "left").withColumn(out, F.when(F.col("__key").isNotNull(), F.coalesce("__value", F.lit(None).cast("string") if default is None else F.lit(shown(default)), F.col("__key")))).drop("__key", "__value")


def equal_bins(low: float, high: float, bins: int) -> list[float]:
    """The edges of bins of equal width; the first one is put a little below the least value."""
    if low == high:
        pad = abs(low) * 0.001 or 0.001
        return [low - pad + k * (2 * pad) / bins for k in range(bins + 1)]
    edges = [low + k * (high - low) / bins for k in range(bins + 1)]
    edges[0] -= (high - low) * 0.001
    edges[-1] = high
    return edges


def intervals(edges: list[float]) -> list[str]:
    return [f"({a:.6g}, {b:.6g}]" for a, b in zip(edges, edges[1:], strict=False)]


@operation("table.bin", "B")
def bin_(df: DataFrame, column: str, bins: int | list[float] = 10, labels: list[str] | None = None, output_column: str | None = None) -> DataFrame:
    """Right-closed intervals; the first one also holds its left edge. The range for equal widths is an aggregate of one row that is joined."""
    x = number(df, column)
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    many = bins if isinstance(bins, int) else len(bins) - 1
    if isinstance(bins, int) and not 2 <= bins <= 100:
        raise PlanError("2 to 100 bins are possible")
    if not isinstance(bins, int) and (not 2 <= many <= 100 or any(a >= b for a, b in zip(bins, bins[1:], strict=False))):
        raise PlanError("3 to 101 rising edges are needed")
    if labels is not None and len(labels) != many:
        raise PlanError("a label for each bin is needed")
    name, names = new_name(output_column or f"{column}_bin"), df.columns
    if isinstance(bins, int):

        def lay(low: pa.Array, high: pa.Array) -> pa.Array:
            found = [None if a is None else equal_bins(a, b, bins) for a, b in zip(low.to_pylist(), high.to_pylist(), strict=True)]
            rows = [None if e is None else {"edges": e, "labels": labels or intervals(e)} for e in found]
            return pa.array(rows, pa.struct([("edges", pa.list_(pa.float64())), ("labels", pa.list_(pa.string()))]))

        laid = F.arrow_udf(lay, T._parse_datatype_string("struct<edges: array<double>, labels: array<string>>"))
        # one row, so this is no product
        df = df.crossJoin(F.broadcast(df.where(finite).agg(F.min(x).alias("low"), F.max(x).alias("high")).select(laid("low", "high").alias("__bins"))))
        edges = [F.col("__bins.edges")[k] for k in range(many + 1)]
        shown = [F.col("__bins.labels")[k] for k in range(many)]
        x = refuse(F.col("__bins").isNull(), "no finite value to bin", x)
    else:
        edges = [F.lit(float(e)) for e in bins]
        shown = [F.lit(t) for t in labels or intervals([float(e) for e in bins])]
    out = None
    for k in range(many):
        inside = finite & ((x >= edges[k]) if k == 0 else (x > edges[k])) & (x <= edges[k + 1])
        out = F.when(inside, shown[k]) if out is None else out.when(inside, shown[k])
    return df.withColumn(name, out).select(*[col(c) for c in names if c != name], col(name)) if name not in names else df.withColumn(name, out).select(*[col(c) for c in names])


@operation("table.concat_columns")
def concat_columns(df: DataFrame, columns: list[str], output_column: str = "concat", separator: str = " ", skip_null: bool = True) -> DataFrame:
    need(df, *columns)
    for c in columns:
        if not isinstance(kind(df, c), T.StringType):
            raise PlanError(f"column {c!r} is not text")
    if skip_null:
        any_ = F.coalesce(*[col(c) for c in columns]).isNotNull()
        return df.withColumn(new_name(output_column), F.when(any_, F.concat_ws(separator, *[col(c) for c in columns])))
    return df.withColumn(new_name(output_column), F.concat_ws(separator, *[F.coalesce(col(c), F.lit("")) for c in columns]))


@operation("table.split_column")
def split_column(df: DataFrame, column: str, new_columns: list[str], delimiter: str = ",", max_splits: int = -1) -> DataFrame:
    """Splits at a literal; the last column takes the rest."""
    need(df, column)
    no_repeats(new_columns)
    limit = len(new_columns) if max_splits <= 0 else min(len(new_columns), max_splits + 1)
    parts = F.split(col(column), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", limit)
    out = df.withColumn("__parts", parts)
    for k, n in enumerate(new_columns):
        out = out.withColumn(new_name(n), F.get("__parts", F.lit(k)))
    return out.drop("__parts")


def numeric(df: DataFrame, names: list[str]) -> bool:
    return all(is_number(kind(df, n)) for n in names)
