"""Text operations and cleansing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import groups, pattern, replacement
from ..functions.formats import regex as java_regex
from ..relation import ORD, PlanError, col, data, is_number, kind, need, new_name, operation, ranges, refuse, to_text, with_order


@operation("table.string_pad")
def string_pad(df: DataFrame, column: str, width: int, side: str = "left", fill_char: str = " ", output_column: str | None = None) -> DataFrame:
    if len(fill_char) != 1:
        raise PlanError("fill_char is one character")
    c = col(column)
    need(df, column)
    if side == "both":
        gap = F.lit(width) - F.char_length(c)
        left = F.floor(gap / 2).cast("int")
        padded = F.concat(F.repeat(F.lit(fill_char), left), c, F.repeat(F.lit(fill_char), (gap - left).cast("int")))
    elif side in ("left", "right"):
        padded = (F.lpad if side == "left" else F.rpad)(c, width, fill_char)
    else:
        raise PlanError(f"there is no side {side!r}")
    return df.withColumn(new_name(output_column or column), F.when(F.char_length(c) < width, padded).otherwise(c))


@operation("table.string_length")
def string_length(df: DataFrame, column: str, output_column: str | None = None) -> DataFrame:
    need(df, column)
    return df.withColumn(new_name(output_column or f"{column}_length"), F.char_length(col(column)).cast("long"))


@operation("table.string_extract")
def string_extract(df: DataFrame, column: str, pattern: str, output_column: str | None = None, extract_all: bool = False) -> DataFrame:
    """Named groups give a column each; else the first group, or the match."""
    need(df, column)
    names = groups(pattern)
    java = java_regex(pattern)
    c = col(column)
    try:
        compiled = re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern))
    except re.error as e:
        raise PlanError(f"the pattern is not valid: {e}") from None
    hit = c.rlike(java)
    if names and not extract_all:
        for n in names:
            df = df.withColumn(new_name(n), F.when(hit, F.regexp_extract(c, java, compiled.groupindex[n])))
        return df
    which = 1 if compiled.groups else 0
    out = new_name(output_column or f"{column}_extracted")
    if extract_all:
        return df.withColumn(out, F.when(hit, F.array_join(F.regexp_extract_all(c, F.lit(java), F.lit(which)), ",")))
    return df.withColumn(out, F.when(hit, F.regexp_extract(c, java, which)))


#: Letters with marks and what they are without; built from Unicode's own decompositions.
def _plain_letters() -> tuple[str, str]:
    import unicodedata

    marked, plain = [], []
    for k in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFKD", chr(k))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(k):
            marked.append(chr(k))
            plain.append(base)
    return "".join(marked), "".join(plain)


def without_accents(c: Column) -> Column:
    marked, plain = _plain_letters()
    return F.regexp_replace(F.translate(c, marked, plain), r"\p{M}+", "")


def title(c: Column) -> Column:
    """The first letter of each run of letters and digits in upper case, the rest in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(r.substr(1, 1)), F.lower(F.substring(r, 2, 2**31 - 1)))), "")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s  - 　]+|[\s  - 　]+$", "")


NORMAL = {
    "trim": stripped,
    "lower": F.lower,
    "upper": F.upper,
    "title": title,
    "strip_accents": without_accents,
    "strip_double_spaces": lambda c: F.regexp_replace(c, r"\s{2,}", " "),
    "full": lambda c: F.regexp_replace(without_accents(F.lower(stripped(c))), r"\s+", " "),
}


@operation("table.text_normalize")
def text_normalize(df: DataFrame, columns: list[str], operations: str | list[str] = "full", overwrite: bool = True) -> DataFrame:
    """In place, or to <column>_normalized."""
    steps = [operations] if isinstance(operations, str) else list(operations)
    for c in columns:
        need(df, c)
        x = col(c)
        for s in steps:
            if s not in NORMAL:
                raise PlanError(f"there is no normalisation {s!r}")
            x = NORMAL[s](x)
        df = df.withColumn(c if overwrite else new_name(f"{c}_normalized"), x)
    return df


@operation("table.replace")
def replace(df: DataFrame, column: str, old_value: str, new_value: str, regex: bool = False) -> DataFrame:
    """A literal replaces whole cells that equal it; a pattern replaces every match."""
    need(df, column)
    t = to_text(df, column)
    if regex:
        return df.withColumn(column, F.regexp_replace(t, java_regex(old_value), replacement(new_value)))
    return df.withColumn(column, F.when(t == old_value, F.lit(new_value)).otherwise(t))


@operation("table.fill_na")
def fill_na(df: DataFrame, column: str | None = None, method: str = "value", value: object = None) -> DataFrame:
    """Fills with a value, or with the last or next value in input order.

    For ffill and bfill the order is global: rows are cut into ranges of ORD, the last value of each
    range is carried over by a window over one row per range, and each range fills itself.
    """
    names = [column] if column else data(df)
    for n in names:
        if not (is_number(kind(df, n)) or isinstance(kind(df, n), (T.StringType, T.BooleanType))):
            raise PlanError(f"column {n!r} can't be filled")
    if method == "value":
        for n in names:
            df = df.withColumn(n, F.coalesce(col(n), F.lit(value).cast(kind(df, n))))
        return df
    if method not in ("ffill", "bfill"):
        raise PlanError(f"there is no method {method!r}")
    df = with_order(df)
    marked = df.withColumn("__bucket", ranges(df)[0])
    forward = method == "ffill"
    pick = F.max_by if forward else F.min_by
    carried = marked.groupBy("__bucket").agg(*[pick(F.when(col(n).isNotNull(), F.struct(col(n).alias("v"))), F.when(col(n).isNotNull(), F.col(ORD))).alias(f"__c{k}") for k, n in enumerate(names)])
    # one row for each range, of which there are as many as shuffle partitions
    over = Window.orderBy(F.col("__bucket") if forward else F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("__bucket", *[F.last(f"__c{k}", ignorenulls=True).over(over).alias(f"__c{k}") for k in range(len(names))])
    w = Window.partitionBy("__bucket").orderBy(F.col(ORD) if forward else F.col(ORD).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = marked.join(F.broadcast(carried), "__bucket")
    for k, n in enumerate(names):
        out = out.withColumn(n, F.coalesce(F.last(col(n), ignorenulls=True).over(w), F.col(f"__c{k}.v")))
    return out.select(*[col(c) for c in df.columns])


TRUE, FALSE = ["true", "1", "yes", "si", "sì", "vero", "t", "y", "s"], ["false", "0", "no", "falso", "f", "n"]
DATES = ["%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%Y/%m/%d"]
TIMES = ["%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S", "%d/%m/%Y %H:%M:%S"]


def moment(text: Column, formats: list[str]) -> Column:
    """The first format that reads a text, as a timestamp without zone."""
    tries = [F.try_to_timestamp(text, F.lit(pattern(f))).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def cast_value(df: DataFrame, column: str, target: str, date_format: str | None, precision: int | None, scale: int | None) -> tuple[Column, str]:
    """The converted column (null where that fails) and the cause of failures."""
    t, c, text = kind(df, column), col(column), stripped(to_text(df, column))
    if target in ("str", "dictionary_utf8"):
        return to_text(df, column), "conversion.invalid_text"
    if target == "binary_utf8":
        return c if isinstance(t, T.BinaryType) else to_text(df, column).cast("binary"), "conversion.invalid_text"
    if target == "bool":
        low = F.lower(text)
        return F.when(low.isin(TRUE), True).when(low.isin(FALSE), False), "conversion.invalid_boolean"
    if target in ("int", "uint64"):
        x = c.try_cast("decimal(38,10)") if is_number(t) else F.regexp_replace(text, ",", ".").try_cast("decimal(38,10)")
        whole = F.when(x == F.floor(x), F.floor(x))
        if target == "int":
            return F.when(whole.between(F.lit(-(2**63)).cast("decimal(38,0)"), F.lit(2**63 - 1).cast("decimal(38,0)")), whole).try_cast("long"), "conversion.invalid_integer"
        return F.when(whole.between(F.lit(0), F.lit("18446744073709551615").cast("decimal(20,0)")), whole).try_cast("decimal(20,0)"), "conversion.invalid_integer"
    if target == "float":
        x = c.cast("double") if is_number(t) else F.regexp_replace(text, ",", ".").try_cast("double")
        return x, "conversion.invalid_float"
    if target == "decimal128":
        return (c if is_number(t) else F.regexp_replace(text, ",", ".")).try_cast(f"decimal({precision or 38},{scale if scale is not None else 10})"), "conversion.invalid_decimal"
    formats = [date_format] if date_format else [*TIMES, *DATES]
    at = c.cast("timestamp_ntz") if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else moment(text, formats)
    if target in ("date", "date32"):
        return at.cast("date"), "conversion.invalid_datetime"
    if target in ("datetime", "timestamp_millis"):
        return F.date_trunc("millisecond", at).cast("timestamp_ntz"), "conversion.invalid_datetime"
    raise PlanError(f"there is no type {target!r}")


@operation("table.type_cast")
def type_cast(df: DataFrame, column: str, target_type: str = "str", date_format: str | None = None, errors: str = "coerce", precision: int | None = None, scale: int | None = None, timezone: str | None = None) -> DataFrame:
    """A cell that can't be converted ends the query, whether errors is coerce or raise; with ignore it becomes null."""
    out, cause = cast_value(df, column, target_type, date_format, precision, scale)
    if timezone is not None and target_type in ("datetime", "timestamp_millis"):
        out = F.to_utc_timestamp(out, timezone)
    if errors not in ("coerce", "raise", "ignore"):
        raise PlanError(f"there is no error policy {errors!r}")
    if errors != "ignore":
        out = refuse(col(column).isNotNull() & out.isNull(), cause, out)
    return df.withColumn(column, out)

