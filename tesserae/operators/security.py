"""Hashes, fingerprints and masks."""

from __future__ import annotations

import hashlib
import hmac
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..relation import PlanError, col, data, kind, need, new_name, no_repeats, operation, refuse, to_text

SEPARATOR = "\u001f"


def prepared(df: DataFrame, name: str, normalize: bool, null_policy: str, null_literal: str) -> Column:
    t = to_text(df, name)
    t = F.lower(F.trim(t)) if normalize else t
    if null_policy == "empty":
        return F.coalesce(t, F.lit(""))
    if null_policy == "literal":
        return F.coalesce(t, F.lit(null_literal))
    if null_policy in ("error", "reject"):
        return refuse(col(name).isNull(), "validation.required_value_missing", t)
    raise PlanError(f"there is no null policy {null_policy!r}")


@operation("table.md5_hash")
def md5_hash(df: DataFrame, columns: list[str], output_column: str = "hash", normalize: bool = True, null_policy: str = "empty", null_literal: str = "") -> DataFrame:
    names = sorted(set(columns))
    need(df, *names)
    return df.withColumn(new_name(output_column), F.md5(F.concat_ws(SEPARATOR, *[prepared(df, n, normalize, null_policy, null_literal) for n in names])))


def framed(value: Column) -> Column:
    """A value's bytes behind their length as eight bytes."""
    b = value.cast("binary")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(b).cast("long")), 16, "0")), b)


def type_name(t: T.DataType) -> str:
    names = {"string": "Utf8", "bigint": "Int64", "double": "Float64", "boolean": "Boolean", "date": "Date32", "binary": "Binary", "int": "Int32", "float": "Float32"}
    return names.get(t.simpleString(), t.simpleString())


def record(df: DataFrame, names: list[str], tag: str, values: dict[str, Column]) -> Column:
    """Tag, then name, type, presence and value of each column, so that no two rows read alike."""
    parts = [F.lit(tag + "\0").cast("binary")]
    for n in names:
        v = values[n]
        parts += [framed(F.lit(n)), framed(F.lit(type_name(kind(df, n)))), F.when(v.isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), framed(F.coalesce(v, F.lit("")))))]
    return F.concat(*parts)


@operation("table.sha256_hash")
def sha256_hash(df: DataFrame, columns: list[str], output_column: str = "sha256", normalize: bool = False, null_policy: str = "empty", null_literal: str = "") -> DataFrame:
    names = sorted(set(columns))
    need(df, *names)
    values = {n: prepared(df, n, normalize, null_policy, null_literal) for n in names}
    return df.withColumn(new_name(output_column), F.sha2(record(df, names, "row-sha256-v1", values), 256))


@operation("table.stable_fingerprint")
def stable_fingerprint(df: DataFrame, columns: list[str] = (), output_column: str = "fingerprint", algorithm: str = "sha256") -> DataFrame:
    names = list(columns) or data(df)
    no_repeats(names)
    need(df, *names)
    framed_ = record(df, names, "row-fingerprint-v1", {n: to_text(df, n) for n in names})
    if algorithm not in ("sha256", "md5"):
        raise PlanError(f"there is no algorithm {algorithm!r}")
    return df.withColumn(new_name(output_column), F.sha2(framed_, 256) if algorithm == "sha256" else F.md5(framed_))


@operation("table.hmac_sha256")
def hmac_sha256(df: DataFrame, columns: list[str], key_env: str, output_column: str = "hmac", null_policy: str = "empty") -> DataFrame:
    """HMAC over U+001F-joined texts. The key comes from an environment variable and travels as a broadcast, not in the plan."""
    need(df, *columns)
    if null_policy not in ("empty", "null", "skip"):
        raise PlanError(f"there is no null policy {null_policy!r}")
    if not os.environ.get(key_env):
        raise PlanError(f"the variable {key_env} holds no key")
    key = df.sparkSession.sparkContext.broadcast(os.environ[key_env].encode())

    @F.arrow_udf(T.StringType())
    def sign(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else hmac.new(key.value, t.encode(), hashlib.sha256).hexdigest() for t in texts.to_pylist()], pa.string())

    parts = [to_text(df, n) for n in columns]
    if null_policy == "skip":
        text = F.concat_ws(SEPARATOR, *parts)
    else:
        text = F.concat_ws(SEPARATOR, *[F.coalesce(p, F.lit("")) for p in parts])
    if null_policy == "null":
        text = F.when(F.concat(*parts).isNotNull(), text)
    return df.withColumn(new_name(output_column), sign(text))


def stars(c: Column, first: int, last: int, char: str = "*") -> Column:
    n = F.char_length(c)
    return F.when(n > first + last, F.concat(F.left(c, F.lit(first)), F.repeat(F.lit(char), (n - first - last).cast("int")), F.right(c, F.lit(last)) if last else F.lit(""))).otherwise(c)


def masked(c: Column, m: dict) -> Column:
    how = m.get("type") or m.get("mask_type")
    if how == "cf":
        return stars(c, 3, 3)
    if how == "iban":
        return stars(c, 4, 4)
    if how == "email":
        at = F.instr(c, "@")
        name, domain = F.substring_index(c, "@", 1), F.substr(c, at)
        return F.when(at > 1, F.concat(F.left(name, F.lit(1)), F.repeat(F.lit("*"), F.greatest(F.char_length(name) - 1, F.lit(0)).cast("int")), domain)).otherwise(c)
    if how == "phone":
        digits = F.regexp_replace(c, "[^0-9+]", "")
        return F.when(F.char_length(digits) < 6, c).otherwise(stars(digits, 3, 4))
    if how == "custom":
        return stars(c, m.get("start", 0), m.get("end", 0), m.get("char", "*"))
    raise PlanError(f"there is no mask {how!r}")


@operation("table.mask_data")
def mask_data(df: DataFrame, maskings: list[dict], overwrite: bool = True) -> DataFrame:
    for m in maskings:
        need(df, m["column"])
        df = df.withColumn(m["column"] if overwrite else new_name(m["column"] + "_masked"), masked(to_text(df, m["column"]), m))
    return df
