"""Checks that end a query, reconciliation and named rules.

A check is a filter that raises an error in the pass that reads the rows anyway; only
counts of whole tables and keys need an aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import regex
from ..relation import PlanError, col, data, demand, is_number, kind, need, number, operation, refuse, to_text
from .columns import ATOMS
from .filters import parsed
from .joins import same_keys


@operation("table.assert_schema")
def assert_schema(df: DataFrame, fields: list[dict], allow_extra: bool = False, ordered: bool = False) -> DataFrame:
    names = data(df)
    want = [f["name"] for f in fields]
    if ordered and names[: len(want)] != want:
        raise PlanError("the columns are not in the expected order")
    if not allow_extra and set(names) - set(want):
        raise PlanError(f"unexpected columns: {sorted(set(names) - set(want))}")
    for f in fields:
        t = kind(df, f["name"])
        expected = f.get("type") or f.get("data_type")
        if expected and t != T._parse_datatype_string(ATOMS.get(str(expected).lower(), str(expected))):
            raise PlanError(f"column {f['name']!r} has type {t.simpleString()}")
        if f.get("nullable") is not None and df.schema[f["name"]].nullable != f["nullable"]:
            raise PlanError(f"column {f['name']!r} differs in nullability")
    return df


@operation("table.assert_not_null")
def assert_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    need(df, *columns)
    bad = F.lit(False)
    for c in columns:
        bad |= col(c).isNull()
    return demand(df, bad, "validation.required_value_missing")


@operation("table.assert_unique", "B")
def assert_unique(df: DataFrame, columns: list[str], nulls_equal: bool = True) -> DataFrame:
    """Keys are counted with a combine before the shuffle; the rows themselves are not moved."""
    need(df, *columns)
    keys = df.select(*[col(c) for c in columns])
    if not nulls_equal:
        keys = keys.dropna()
    most = keys.groupBy(*[col(c) for c in columns]).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("__most"))
    return df.crossJoin(F.broadcast(most)).where(refuse(F.col("__most") > 1, "validation.duplicate_key", F.lit(True))).drop("__most")


@operation("table.assert_range")
def assert_range(df: DataFrame, column: str, min: float | None = None, max: float | None = None, inclusive_min: bool = True, inclusive_max: bool = True, allow_null: bool = False) -> DataFrame:
    x = number(df, column)
    c = col(column)
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    if min is not None:
        bad |= (c < F.lit(min)) if inclusive_min else (c <= F.lit(min))
    if max is not None:
        bad |= (c > F.lit(max)) if inclusive_max else (c >= F.lit(max))
    bad = F.coalesce(bad, F.lit(not allow_null))
    return demand(df, bad, "validation.value_out_of_range")


@operation("table.assert_regex")
def assert_regex(df: DataFrame, column: str, pattern: str, allow_null: bool = False) -> DataFrame:
    need(df, column)
    return demand(df, F.coalesce(~col(column).rlike(regex(pattern)), F.lit(not allow_null)), "validation.regex_mismatch")


@operation("table.assert_cardinality")
def assert_cardinality(df: DataFrame, exact_rows: int | None = None, min_rows: int | None = None, max_rows: int | None = None) -> DataFrame:
    """The rows, and behind them an aggregate that gives no row but an error where their number is wrong."""
    n = F.col("n")
    wrong = F.lit(False)
    for limit, bad in ((exact_rows, n != F.lit(exact_rows)), (min_rows, n < F.lit(min_rows)), (max_rows, n > F.lit(max_rows))):
        wrong |= bad if limit is not None else F.lit(False)
    counted = df.agg(F.count(F.lit(1)).alias("n")).where(F.when(wrong, F.raise_error(F.concat(F.lit("rejected: validation.row_count ("), n.cast("string"), F.lit(" rows)")))).otherwise(F.lit(False)))
    none = counted.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    out = df.unionByName(none)
    for f in df.schema.fields:
        out = out.withMetadata(f.name, f.metadata) if f.metadata else out
    return out


@operation("table.assert_metadata")
def assert_metadata(df: DataFrame, expected: dict, allow_extra: bool = True, metadata: dict | None = None) -> DataFrame:
    """Table metadata is what with_metadata() has put on the frame's columns."""
    have = metadata if metadata is not None else table_metadata(df)
    wrong = {k for k, v in expected.items() if have.get(k) != v}
    if wrong or not allow_extra and set(have) - set(expected):
        raise PlanError(f"the metadata differ: {sorted(wrong) or sorted(set(have) - set(expected))}")
    return df


def with_metadata(df: DataFrame, **entries: str) -> DataFrame:
    """Entries are kept on the first column, which is where Spark can carry them."""
    first = df.columns[0]
    return df.withMetadata(first, {**df.schema[first].metadata, "table": {**table_metadata(df), **entries}})


def table_metadata(df: DataFrame) -> dict:
    out: dict = {}
    for f in df.schema.fields:
        out |= f.metadata.get("table", {})
    return out


@operation("table.assert_foreign_key", "BB")
def assert_foreign_key(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], allow_null: bool = False) -> DataFrame:
    same_keys(left, right, left_keys, right_keys)
    any_null = F.lit(False)
    for k in left_keys:
        any_null |= col(k).isNull()
    if not allow_null:
        left = demand(left, any_null, "validation.foreign_key_null")
    r = right.select(*[col(b).alias(f"__k{n}") for n, b in enumerate(right_keys)]).distinct().withColumn("__there", F.lit(True))
    out = left.join(r, [col(a) == F.col(f"__k{n}") for n, a in enumerate(left_keys)], "left")
    return out.where(refuse(F.col("__there").isNull() & ~any_null, "validation.foreign_key_missing", F.lit(True))).select(*[col(c) for c in left.columns])


@operation("table.reconcile", "BB")
def reconcile(left: DataFrame, right: DataFrame, left_keys: list[str], right_keys: list[str], nulls_equal: bool = True) -> DataFrame:
    """Five numbers about two multisets of keys: counts per key meet in one full join."""
    same_keys(left, right, left_keys, right_keys)

    def counted(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        return df.groupBy(*[col(k).alias(f"k{n}") for n, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias(name))

    l, r = counted(left, left_keys, "a"), counted(right, right_keys, "b")
    ks = [f"k{n}" for n in range(len(left_keys))]
    on = [l[k].eqNullSafe(r[k]) if nulls_equal else l[k] == r[k] for k in ks]
    both = l.join(r, on, "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    one = both.agg(
        F.sum(F.least("a", "b")).alias("m"),
        F.sum(F.greatest(F.col("a") - F.col("b"), F.lit(0))).alias("l"),
        F.sum(F.greatest(F.col("b") - F.col("a"), F.lit(0))).alias("r"),
        F.sum(F.greatest(F.col("a") - 1, F.lit(0))).alias("ld"),
        F.sum(F.greatest(F.col("b") - 1, F.lit(0))).alias("rd"),
    )
    return one.select(F.expr("stack(5, 'matched_rows', coalesce(m, 0L), 'left_only_rows', coalesce(l, 0L), 'right_only_rows', coalesce(r, 0L), 'left_duplicate_rows', coalesce(ld, 0L), 'right_duplicate_rows', coalesce(rd, 0L)) as (metric, value)"))


def passes(df: DataFrame, rule: dict) -> Column:
    c, t, op = rule["column"], kind(df, rule["column"]), rule["operator"]
    x = col(c)
    if op == "isnull":
        return x.isNull()
    if op == "notnull":
        return x.isNotNull()
    if op == "regex":
        ok = to_text(df, c).rlike(regex(rule["value"]))
    elif op == "range":
        ok = F.lit(True)
        if rule.get("min") is not None:
            ok &= number(df, c) >= rule["min"]
        if rule.get("max") is not None:
            ok &= number(df, c) <= rule["max"]
    else:
        v = parsed(rule["value"], t) if is_number(t) else None
        a, b = (x, v) if v is not None else (to_text(df, c), F.lit(str(rule["value"])))
        table = {"eq": a == b, "ne": a != b, "gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}
        if op not in table:
            raise PlanError(f"there is no rule {op!r}")
        ok = table[op]
    return F.coalesce(ok, F.lit(False))


@operation("table.validate_rules")
def validate_rules(df: DataFrame, rules: list[dict], output_mode: str = "annotate") -> DataFrame:
    """rules: {name, column, operator, value, min, max, severity}."""
    names = [r["name"] for r in rules]
    if len(set(names)) != len(names) or not rules:
        raise PlanError("rules need different names")
    failed = {r["name"]: ~passes(df, r) for r in rules}
    severe = {r["name"]: r.get("severity", "error") == "error" for r in rules}
    if output_mode == "annotate":
        listed = lambda on: F.array_join(F.filter(F.array(*[F.when(failed[n], F.lit(n)) for n in names if severe[n] == on] or [F.lit(None).cast("string")]), lambda x: x.isNotNull()), ";")
        df = df.withColumn("_errors", listed(True)).withColumn("_warnings", listed(False))
        return df.select(*[col(c) for c in df.columns if c not in ("_errors", "_warnings")], (F.col("_errors") == "").alias("_valid"), "_errors", "_warnings")
    if output_mode != "summary":
        raise PlanError(f"there is no mode {output_mode!r}")
    one = df.agg(*[F.coalesce(F.sum(failed[n].cast("long")), F.lit(0)).alias(f"n{k}") for k, n in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), (F.col(f"n{k}") if severe[n] else F.lit(0).cast("long")).alias("errors"), (F.lit(0).cast("long") if severe[n] else F.col(f"n{k}")).alias("warnings")) for k, n in enumerate(names)])
    return one.select(F.inline(rows))

