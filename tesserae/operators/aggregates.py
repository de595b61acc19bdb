"""Aggregation, statistics, pivots, duplicates, sorting and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..relation import ORD, PlanError, col, data, demand, is_number, kind, need, new_name, no_repeats, number, operation, ranges, to_text, with_order
from .columns import numbered


def real(c: Column) -> Column:
    """Without NaN, which minimum and maximum pass over."""
    return F.when(~F.isnan(c), c)


def spread(c: Column, ddof: int, root: bool) -> Column:
    n = F.count(c)
    v = F.when(n > ddof, F.var_samp(c) if ddof == 1 else F.var_pop(c) * n / (n - ddof))
    return F.sqrt(v) if root else v


@operation("table.aggregate", "B")
def aggregate(df: DataFrame, group_by: list[str], aggregations: list[dict] = ()) -> DataFrame:
    """aggregations: {column, function, output, skip_null, distinct, ddof, quantile, separator}.

    All but first, last and concat combine on the map side. first and last keep one value
    for each group, the one of the smallest or largest position.
    """
    if not group_by:
        raise PlanError("at least one key is needed")
    need(df, *group_by)
    if not aggregations:
        return df.groupBy(*[col(g) for g in group_by]).agg(F.count(F.lit(1)).alias("count"))
    if any(a["function"] in ("first", "last", "concat") for a in aggregations):
        df = with_order(df)
    names = [a["column"] for a in aggregations]
    outs, made = [], []
    for a in aggregations:
        c, f = a["column"], a["function"]
        name = new_name(a.get("output") or (f"{c}_{f}" if names.count(c) > 1 else c))
        made.append(name)
        outs.append(one(df, c, f, a).alias(name))
    no_repeats([*group_by, *made])
    return df.groupBy(*[col(g) for g in group_by]).agg(*outs)


def one(df: DataFrame, c: str, f: str, a: dict) -> Column:
    text = to_text(df, c)
    if f == "count":
        return F.count(col(c))
    if f == "nunique":
        # these types have a text for each value, so the values can be counted themselves
        plain = is_number(kind(df, c)) or isinstance(kind(df, c), (T.StringType, T.BooleanType, T.DateType))
        n = F.count_distinct(col(c) if plain else text)
        return n if a.get("skip_null", True) else n + F.max(col(c).isNull().cast("int")).cast("long")
    if f in ("first", "last"):
        return (F.min_by if f == "first" else F.max_by)(F.struct(text.alias("v")), F.col(ORD))["v"]
    if f == "concat":
        pairs = F.sort_array(F.collect_list(F.when(col(c).isNotNull(), F.struct(F.col(ORD), text.alias("v")))))
        values = F.transform(pairs, lambda p: p["v"])
        return F.array_join(F.array_distinct(values) if a.get("distinct") else values, a.get("separator", ","))
    x = number(df, c)
    if a.get("distinct"):
        if f == "sum":
            out = F.sum_distinct(x)
        elif f in ("mean", "avg"):
            out = F.sum_distinct(x) / F.count_distinct(x)
        elif f in ("min", "max"):
            out = F.min(real(x)) if f == "min" else F.max(real(x))
        else:
            raise PlanError(f"{f} can't be distinct")
    else:
        ddof = a.get("ddof", 1)
        table = {"sum": lambda: F.sum(x), "mean": lambda: F.avg(x), "avg": lambda: F.avg(x), "min": lambda: F.min(real(x)), "max": lambda: F.max(real(x)), "variance": lambda: spread(x, ddof, False), "var": lambda: spread(x, ddof, False), "stddev": lambda: spread(x, ddof, True), "std": lambda: spread(x, ddof, True), "median": lambda: F.percentile(x, 0.5), "quantile": lambda: F.percentile(x, a.get("quantile", 0.5))}
        if f not in table:
            raise PlanError(f"there is no aggregate {f!r}")
        out = table[f]()
    return out if a.get("skip_null", True) else F.when(F.count(F.when(col(c).isNull(), 1)) == 0, out)


@operation("table.statistics", "B")
def statistics(df: DataFrame, column: str, group_by: str | None = None, stats: list[str] = ("count", "min", "max", "mean", "median", "std"), output_prefix: str = "") -> DataFrame:
    """Group statistics on every row: aggregated once and joined back, so a large group isn't gathered in a window."""
    x = number(df, column)
    table = {"count": F.count(x).cast("double"), "min": F.min(real(x)), "max": F.max(real(x)), "sum": F.sum(x), "mean": F.avg(x), "median": F.percentile(x, 0.5), "std": F.stddev_samp(x), "var": F.var_samp(x), "q25": F.percentile(x, 0.25), "q75": F.percentile(x, 0.75)}
    prefix = output_prefix or column
    outs = [F.when(F.count(x) > 0, table[s]).alias(new_name(f"{prefix}_{s}")) for s in stats]
    kept = [col(c) for c in df.columns if c not in [f"{prefix}_{s}" for s in stats]]
    if group_by is None:
        # one row
        return df.select(*kept).crossJoin(F.broadcast(df.agg(*outs)))
    need(df, group_by)
    groups = df.groupBy(col(group_by).alias("__g")).agg(*outs)
    return df.select(*kept).join(groups, col(group_by).eqNullSafe(F.col("__g"))).drop("__g")


@operation("table.pivot", "B")
def pivot(df: DataFrame, index_col: str, column: str, value_col: str, aggr_func: str = "first", mapping: dict | None = None, max_columns: int = 10_000) -> DataFrame:
    """Output columns are the sorted texts of the pivot column, read beforehand unless a mapping names them; more than max_columns are refused."""
    keys = [k.strip() for k in index_col.split(",")]
    need(df, *keys, column, value_col)
    df = with_order(df)
    p = to_text(df, column)
    values = list(mapping) if mapping else sorted(r[0] for r in df.select(p.alias("p")).where("p IS NOT NULL").distinct().limit(max_columns + 1).collect())
    if not mapping and len(values) > max_columns:
        raise PlanError(f"more than {max_columns} values can't become columns")
    outs = []
    for v in values:
        hit = p == F.lit(v)
        if aggr_func in ("first", "last"):
            t = F.struct(to_text(df, value_col).alias("v"))
            x = (F.min_by if aggr_func == "first" else F.max_by)(F.when(hit, t), F.when(hit, F.col(ORD)))["v"]
        elif aggr_func == "count":
            x = F.when(F.count(F.when(hit, 1)) > 0, F.count(F.when(hit, col(value_col))))
        elif aggr_func == "concat":
            x = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(hit & col(value_col).isNotNull(), F.struct(F.col(ORD), to_text(df, value_col).alias("v"))))), lambda s: s["v"]), ",")
            x = F.when(F.count(F.when(hit, 1)) > 0, x)
        else:
            n = number(df, value_col)
            x = {"sum": F.sum, "mean": F.avg, "min": lambda c: F.min(real(c)), "max": lambda c: F.max(real(c))}[aggr_func](F.when(hit, n))
        outs.append(x.alias(new_name((mapping or {}).get(v, v))))
    if not outs:
        return df.select(*[col(k) for k in keys]).distinct()
    return df.groupBy(*[col(k) for k in keys]).agg(*outs)


def shown(df: DataFrame, c: str) -> Column:
    """A column as a sort key: numbers, texts and truth values by value, others by text."""
    t = kind(df, c)
    return col(c) if (is_number(t) and not isinstance(t, T.DecimalType)) or isinstance(t, (T.StringType, T.BooleanType)) else to_text(df, c)


def directed(df: DataFrame, columns: list[str], ascending: bool) -> list[Column]:
    need(df, *columns)
    return [shown(df, c).asc_nulls_last() if ascending else shown(df, c).desc_nulls_first() for c in columns]


@operation("table.sort", "B")
def sort(df: DataFrame, columns: list[str], ascending: bool = True) -> DataFrame:
    df = with_order(df)
    return df.orderBy(*directed(df, columns, ascending), ORD)


@operation("table.top_n", "B")
def top_n(df: DataFrame, columns: list[str], n: int, descending: bool = True) -> DataFrame:
    return sort(df, columns, not descending).limit(n)


@operation("table.distinct", "B")
def distinct(df: DataFrame, subset: list[str] = (), keep: str = "first") -> DataFrame:
    """Keeps the first, the last or, with false, only rows whose key is there once."""
    keys = list(subset) or data(df)
    need(df, *keys)
    if keep in (False, "false", "none"):
        keep = "false"
    if keep not in ("first", "last", "false"):
        raise PlanError(f"there is no rule {keep!r}")
    if keep != "false" and set(keys) == set(data(df)) and ORD not in df.columns:
        return df.distinct()  # equal rows: any survivor will do, and Spark combines before the shuffle
    df = with_order(df)
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[col(c) for c in rest])
    # one row for each key is kept while aggregating, so a frequent key isn't gathered
    best = F.max_by(row, F.col(ORD)) if keep == "last" else F.min_by(row, F.col(ORD))
    out = df.groupBy(*[col(k) for k in keys]).agg(best.alias("__r"), F.count(F.lit(1)).alias("__n"))
    if keep == "false":
        out = out.where("__n = 1")
    return out.select(*[col(c) if c in keys else F.col("__r")[c].alias(c) for c in df.columns])


@operation("table.dedup_advanced", "B")
def dedup_advanced(df: DataFrame, subset: list[str], keep: str = "first", order_column: str | None = None, ascending: bool = True) -> DataFrame:
    if keep not in ("first", "last"):
        raise PlanError("keep is first or last")
    df = with_order(df)
    order = directed(df, [order_column], ascending) if order_column else []
    if keep == "last":
        back = [shown(df, order_column).desc_nulls_first() if ascending else shown(df, order_column).asc_nulls_last()] if order_column else []
        rank = Window.partitionBy(*[col(c) for c in subset]).orderBy(*back, F.col(ORD).desc())
    else:
        rank = Window.partitionBy(*[col(c) for c in subset]).orderBy(*order, ORD)
    need(df, *subset)
    return df.withColumn("__n", F.row_number().over(rank)).where("__n = 1").drop("__n").orderBy(*order, ORD)


def frame(df: DataFrame, group_by: str | None, order_column: str | None) -> tuple[DataFrame, list[Column], list[Column]]:
    df = with_order(df)
    by = [col(group_by)] if group_by else [F.lit(0)]
    order = [*(directed(df, [order_column], True) if order_column else []), F.col(ORD)]
    return df, by, order


#: Rows of a stretch of the row order that one task takes in windows without groups; wider windows make longer ones.
STRETCH = 1 << 20


def stretched(df: DataFrame, back: int, ahead: int) -> tuple[DataFrame, Column, Column]:
    """df cut into stretches of the row order for windows that reach so many rows back and ahead.

    Rows near the ends are copied to the next or the previous stretch. Also: the stretch, and
    whether a row is one of its own stretch.
    """
    size = max(STRETCH, back, ahead)
    at = numbered(df, "__at", 0)
    own, place = F.floor(F.col("__at") / size).cast("long"), F.col("__at") % size
    to = F.array_compact(F.array(own, F.when(place >= size - back, own + 1) if back else F.lit(None).cast("long"), F.when(place < ahead, own - 1) if ahead else F.lit(None).cast("long")))
    return at.withColumn("__stretch", F.explode(to)), F.col("__stretch"), F.col("__stretch") == own


def carried(df: DataFrame, by: str, sums: dict[str, Column]) -> DataFrame:
    """df by ranges of a column, with the sums of all earlier ranges and, as all_<name>, of all of them; a carried row for each range."""
    bucket, _ = ranges(df, by)
    marked = df.withColumn("__bucket", bucket)
    each_ = marked.groupBy("__bucket").agg(*[c.alias(n) for n, c in sums.items()])
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    rows = each_.select("__bucket", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in sums], *[F.sum(n).over(Window.partitionBy()).alias("all_" + n) for n in sums])
    # as many rows as ranges
    return marked.join(F.broadcast(rows), "__bucket")


def ungrouped(df: DataFrame, x: Column, function: str, offset: int, buckets: int | None) -> tuple[DataFrame, Column]:
    """A window function over all rows in their order, without a task that sees them all."""
    if function in ("lag", "lead", "pct_change"):
        back, ahead = (0, max(0, offset)) if function == "lead" else (max(0, offset), 0)
        if offset < 0:
            back, ahead = (-offset, 0) if function == "lead" else (0, -offset)
        out, stretch, own = stretched(df, back, ahead)
        w = Window.partitionBy(stretch).orderBy(ORD)
        other = (F.lead if function == "lead" else F.lag)(x, offset).over(w)
        value = other if function != "pct_change" else F.when(other != 0, (x - other) / other)
        return out.withColumn("__w", value).where(own), F.col("__w")
    if function in ("cumsum", "running_mean", "cumcount", "ntile"):
        out = carried(df, ORD, {"__rows": F.count(F.lit(1)), "__n": F.count(x), "__sum": F.sum(x)})
        w = Window.partitionBy("__bucket").orderBy(ORD)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        position = F.row_number().over(w) - 1 + F.col("__rows")
        total = F.coalesce(F.sum(x).over(upto), F.lit(0.0)) + F.col("__sum")
        every = F.col("all___rows")
        table = {"cumsum": F.when(x.isNotNull(), total), "running_mean": F.when(x.isNotNull(), total / (F.count(x).over(upto) + F.col("__n"))), "cumcount": position, "ntile": F.floor(position * F.least(F.lit(buckets or 4), every) / every) + 1}
        return out, table[function]
    out = carried(df.withColumn("__x", x), "__x", {"__n": F.count("__x"), "__kinds": F.count_distinct("__x")})
    valued = Window.partitionBy("__bucket", F.col("__x").isNull()).orderBy("__x")
    low, n = F.rank().over(valued) + F.col("__n"), F.col("all___n")
    ties = F.count(F.lit(1)).over(Window.partitionBy("__bucket", "__x")) - 1
    table = {"rank": low + ties / 2, "dense_rank": F.dense_rank().over(valued) + F.col("__kinds"), "percent_rank": F.when(n <= 1, 0.0).otherwise((low - 1) / (n - 1)), "cume_dist": (low + ties) / n}
    return out, F.when(F.col("__x").isNotNull(), table[function])


FUNCTIONS = {"rank", "dense_rank", "percent_rank", "cume_dist", "cumsum", "running_mean", "cumcount", "lag", "lead", "pct_change", "ntile"}


@operation("table.window_function", "B")
def window_function(df: DataFrame, column: str, function: str, group_by: str | None = None, order_column: str | None = None, offset: int = 1, buckets: int | None = None, output_column: str | None = None) -> DataFrame:
    if function not in FUNCTIONS:
        raise PlanError(f"there is no window function {function!r}")
    names = df.columns
    df, by, order = frame(df, group_by, order_column)
    x = number(df, column)
    name = new_name(output_column or f"{column}_{function}")
    # a named order of other columns needs a sort of all rows, unless only the values count
    if not group_by and (not order_column or function in ("rank", "dense_rank", "percent_rank", "cume_dist")):
        out, value = ungrouped(df, x, function, offset, buckets)
        return out.withColumn(name, value.cast("double")).select(*[col(c) for c in names if c != name], *([ORD] if ORD not in names else []), col(name))
    positional = Window.partitionBy(*by).orderBy(*order)
    upto = positional.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valued = Window.partitionBy(*by, x.isNull()).orderBy(x)
    peers = Window.partitionBy(*by, x)
    everyone = Window.partitionBy(*by)
    n = F.count(x).over(everyone)
    low = F.rank().over(valued)
    ranked = {
        "rank": lambda: low + (F.count(F.lit(1)).over(peers) - 1) / 2,
        "dense_rank": lambda: F.dense_rank().over(valued),
        "percent_rank": lambda: F.when(n <= 1, 0.0).otherwise((low - 1) / (n - 1)),
        "cume_dist": lambda: (low - 1 + F.count(F.lit(1)).over(peers)) / n,
    }
    previous = F.lag(x, offset).over(positional)
    position = F.row_number().over(positional) - 1
    placed = {
        "cumsum": lambda: F.when(x.isNotNull(), F.sum(x).over(upto)),
        "running_mean": lambda: F.when(x.isNotNull(), F.avg(x).over(upto)),
        "cumcount": lambda: position,
        "lag": lambda: previous,
        "lead": lambda: F.lead(x, offset).over(positional),
        "pct_change": lambda: F.when(previous != 0, (x - previous) / previous),
        "ntile": lambda: F.floor(position * F.least(F.lit(buckets or 4), F.count(F.lit(1)).over(everyone)) / F.count(F.lit(1)).over(everyone)) + 1,
    }
    out = F.when(x.isNotNull(), ranked[function]()) if function in ranked else placed[function]()
    return df.withColumn(name, out.cast("double"))


@operation("table.rolling_window", "B")
def rolling_window(df: DataFrame, column: str, function: str, window: int, output_column: str, group_by: str | None = None, order_column: str | None = None, min_periods: int = 1, ddof: int = 1) -> DataFrame:
    if window < 1:
        raise PlanError("the window holds at least one row")
    names = df.columns
    df, by, order = frame(df, group_by, order_column)
    x = number(df, column)
    whole = not group_by and not order_column
    if whole:
        df, stretch, own = stretched(df, window - 1, 0)
        by = [stretch]
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - window, 0)
    n = F.count(x).over(w)
    table = {"sum": lambda: F.sum(x).over(w), "mean": lambda: F.avg(x).over(w), "min": lambda: F.min(real(x)).over(w), "max": lambda: F.max(real(x)).over(w)}
    if function == "stddev":
        v = F.when(n > ddof, F.sqrt(F.var_pop(x).over(w) * n / (n - ddof)))
    elif function in table:
        v = table[function]()
    else:
        raise PlanError(f"there is no rolling function {function!r}")
    out = df.withColumn(new_name(output_column), F.when(n >= min_periods, v))
    if not whole:
        return out
    return out.where(own).select(*[col(c) for c in names if c != output_column], *([ORD] if ORD not in names else []), col(output_column))


@operation("table.melt", "B")
def melt(df: DataFrame, id_columns: list[str], value_columns: list[str] = (), var_name: str = "variable", value_name: str = "value", type_policy: str = "reject") -> DataFrame:
    values = list(value_columns) or [c for c in data(df) if c not in id_columns]
    need(df, *id_columns, *values)
    mixed = len({str(kind(df, c)) for c in values}) > 1
    if mixed and type_policy != "string":
        raise PlanError("the value columns differ in type")

    def free(name: str) -> str:
        k = 0
        while (name if not k else f"{name}_{k}") in id_columns:
            k += 1
        return name if not k else f"{name}_{k}"

    shown_ = [(to_text(df, c) if mixed else col(c)).alias(c) for c in values]
    return df.select(*[col(c) for c in id_columns], *shown_).unpivot([col(c) for c in id_columns], [col(c) for c in values], free(var_name), free(value_name))


@operation("table.transpose", "B")
def transpose(df: DataFrame, id_column: str | None = None, output_columns: list[str] = (), type_policy: str = "reject", max_rows: int = 4096) -> DataFrame:
    """Rows become columns. The row count becomes the width of the table, so it is bounded by max_rows and checked."""
    df = with_order(df)
    names = [c for c in data(df) if c != id_column]
    mixed = len({str(kind(df, c)) for c in names}) > 1
    if mixed and type_policy != "string":
        raise PlanError("the columns differ in type")
    read = df.select(*[to_text(df, c).alias(c) for c in data(df)], ORD) if mixed else df
    rows = read.orderBy(ORD).limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise PlanError(f"more than {max_rows} rows can't become columns")
    if not rows:
        return df
    if output_columns:
        heads = list(output_columns)
    elif id_column:
        heads = [str(r[id_column]) for r in rows]
    else:
        heads = [f"col_{k}" for k in range(len(rows))]
    if len(heads) != len(rows):
        raise PlanError("an output column for each row is needed")
    no_repeats(["column", *heads])
    value = T.StringType() if mixed else kind(df, names[0])
    schema = T.StructType([T.StructField("column", T.StringType(), False), *[T.StructField(h, value) for h in heads]])
    return df.sparkSession.createDataFrame([(c, *[r[c] for r in rows]) for c in names], schema)


@operation("table.explode", "B")
def explode(df: DataFrame, column: str, output_column: str | None = None, empty_policy: str = "null") -> DataFrame:
    if not isinstance(kind(df, column), T.ArrayType):
        raise PlanError(f"column {column!r} is not a list")
    if empty_policy != "null":
        raise PlanError("an empty list gives a row with null")
    out = new_name(output_column or column)
    return df.select(*[col(c) for c in df.columns if c not in (column, out)] if out == column else [col(c) for c in df.columns if c != out], F.explode_outer(col(column)).alias(out)).select(*[col(c) for c in (df.columns if out in df.columns else [*df.columns, out])])


@operation("table.unnest")
def unnest(df: DataFrame, column: str, prefix: str = "", drop_source: bool = True) -> DataFrame:
    t = kind(df, column)
    if not isinstance(t, T.StructType):
        raise PlanError(f"column {column!r} is not a struct")
    rest = [c for c in df.columns if not (drop_source and c == column)]
    names = [prefix + f.name for f in t.fields]
    no_repeats([*rest, *names])
    return df.select(*[col(c) for c in rest], *[col(column).getField(f.name).alias(prefix + f.name) for f in t.fields])


@operation("table.flatten_json")
def flatten_json(df: DataFrame, column: str, prefix: str = "", max_level: int = 1, output_columns: list[str] = ()) -> DataFrame:
    """Declared columns <prefix>a.b as texts. Without a declaration their names are found by one aggregate over the keys."""
    need(df, column)
    c = col(column)
    v = F.try_parse_json(c)
    bad = c.isNotNull() & v.isNull()
    object_ = F.ltrim(c).startswith("{")
    df = demand(demand(df, bad, "json.invalid_syntax"), c.isNotNull() & ~object_, "json.root_not_object")
    names = list(output_columns) or [prefix + p for p in paths(df, column, max_level)]
    for n in names:
        path = n.removeprefix(prefix)
        df = df.withColumn(n, leaf(c, path))
    return df


def leaf(c: Column, path: str) -> Column:
    """The text at a dotted path; null in JSON is an empty text, what is absent is null."""
    at = "$" + "".join(f"['{p}']" for p in path.split("."))
    keys = c if "." not in path else F.get_json_object(c, "$" + "".join(f"['{p}']" for p in path.split(".")[:-1]))
    there = F.array_contains(F.json_object_keys(keys), path.split(".")[-1])
    return F.when(there, F.coalesce(F.get_json_object(c, at), F.lit("")))


def paths(df: DataFrame, column: str, depth: int) -> list[str]:
    """Leaf paths up to a depth, from the distinct keys of each level."""
    out, todo = [], [""]
    for level in range(depth + 1):
        following = []
        for p in todo:
            here = col(column) if not p else F.get_json_object(col(column), "$" + "".join(f"['{k}']" for k in p.split(".")))
            found = df.select(F.explode(F.json_object_keys(here)).alias("k"), here.alias("o")).select("k", F.get_json_object("o", "$")).groupBy("k").count().orderBy("k").collect()
            for r in found:
                path = f"{p}.{r[0]}" if p else r[0]
                inner = F.get_json_object(col(column), "$" + "".join(f"['{k}']" for k in path.split(".")))
                nested = df.where(F.ltrim(inner).startswith("{")).limit(1).count() > 0
                if not nested:
                    out.append(path)
                elif level < depth:
                    following.append(path)
        todo = following
    return sorted(out)

