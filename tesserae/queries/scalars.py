"""A query for each function and operator of expression trees, over customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import apply
from . import query, read


def column(name: str) -> dict:
    return {"column": name}


def call(name: str, *arguments: object) -> dict:
    return {"function": name, "arguments": [a if isinstance(a, dict) else {"literal": a} for a in arguments]}


def binary(name: str, left: object, right: object) -> dict:
    left, right = (x if isinstance(x, dict) else {"literal": x} for x in (left, right))
    return {"binary": name, "left": left, "right": right}


def unary(name: str, operand: dict) -> dict:
    return {"unary": name, "operand": operand}


CUSTOMER = ("customer", "c_custkey AS id", "c_name AS name", "c_acctbal AS n", "if(c_custkey % 4 = 0, null, c_acctbal / 7) AS m", "concat(' ', c_mktsegment, '  ') AS padded", "if(c_custkey % 3 = 0, null, c_mktsegment) AS t")
CUSTOMER_SQL = "(SELECT c_custkey AS id, c_name AS name, c_acctbal AS n, CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 7 END AS m, ' ' || c_mktsegment || '  ' AS padded, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS t FROM customer)"
ORDERS = ("orders", "o_orderkey AS id", "cast(o_orderdate AS date) AS d", "date_format(o_orderdate, 'yyyy-MM-dd') AS t")
ORDERS_SQL = "(SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y-%m-%d') AS t FROM orders)"
N, M, T, NAME, PADDED, D = map(column, ("n", "m", "t", "name", "padded", "d"))


def scalar(name: str, tree: dict, sql: str, source: tuple = CUSTOMER, table: str = CUSTOMER_SQL) -> None:
    @query(f"scalar_{name}", f"SELECT id, {sql} AS x FROM {table}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = read(spark, folder, source[0]).selectExpr(*source[1:])
        # SQL's quotient of doubles by 0 is a value as well
        return apply("table.expression", df, output_column="x", expression=tree, non_finite="keep").select("id", "x")


for _name, _sign in {"add": "+", "subtract": "-", "multiply": "*", "divide": "/"}.items():
    scalar(_name, binary(_name, N, binary("add", M, 3)), f"n {_sign} (m + 3)")
for _name, _sign in {"equal": "=", "not_equal": "<>", "greater": ">", "greater_equal": ">=", "less": "<", "less_equal": "<="}.items():
    scalar(_name, binary(_name, call("floor", binary("divide", N, 1000)), call("floor", binary("divide", M, 100))), f"floor(n / 1000) {_sign} floor(m / 100)")
scalar("and", binary("and", binary("greater", N, 0), binary("greater", M, 500)), "n > 0 AND m > 500")
scalar("or", binary("or", binary("greater", N, 0), binary("greater", M, -50)), "n > 0 OR m > -50")
scalar("not", unary("not", binary("greater", M, 0)), "NOT (m > 0)")
scalar("negate", unary("negate", M), "-m")
scalar("is_null", unary("is_null", M), "m IS NULL")
scalar("is_not_null", unary("is_not_null", T), "t IS NOT NULL")
scalar("coalesce", call("coalesce", M, N), "coalesce(m, n)")
scalar("null_if", call("null_if", T, "BUILDING"), "nullif(t, 'BUILDING')")
scalar("lower", call("lower", T), "lower(t)")
scalar("upper", call("upper", call("lower", NAME)), "upper(name)")
scalar("trim", call("trim", PADDED), "trim(padded)")
scalar("length", call("length", PADDED), "CAST(length(padded) AS DOUBLE)")
scalar("concat", call("concat", NAME, "/", T), "name || '/' || t")
scalar("contains", call("contains", T, "IL"), "contains(t, 'IL')")
scalar("starts_with", call("starts_with", T, "MA"), "starts_with(t, 'MA')")
scalar("ends_with", call("ends_with", T, "E"), "ends_with(t, 'E')")
scalar("abs", call("abs", M), "abs(m)")
scalar("round", call("round", binary("divide", N, 8), 0), "CASE WHEN n >= 0 THEN floor(n / 8 + 0.5) ELSE ceil(n / 8 - 0.5) END")
scalar("floor", call("floor", M), "CAST(floor(m) AS DOUBLE)")
scalar("ceil", call("ceil", M), "CAST(ceil(m) AS DOUBLE)")
scalar("power", call("power", binary("divide", M, 100), 2), "power(m / 100, 2)")
scalar("substring", call("substring", NAME, 3, 5), "substr(name, 4, 5)")
scalar("substring_to_end", call("substring", T, 2), "substr(t, 3)")
scalar("regex_replace", call("regex_replace", NAME, "0+([1-9])", "-$1"), "regexp_replace(name, '0+([1-9])', '-\\1', 'g')")
scalar("between", call("between", N, M, 5000), "n BETWEEN m AND 5000")
scalar("in", call("in", T, "BUILDING", "MACHINERY"), "t IN ('BUILDING', 'MACHINERY')")
scalar("greatest", call("greatest", N, M, 100), "CASE WHEN m IS NOT NULL THEN greatest(n, m, 100) END")
scalar("least", call("least", N, M, 100), "CASE WHEN m IS NOT NULL THEN least(n, m, 100) END")
scalar("case", {"case": [{"when": binary("greater", M, 500), "then": {"literal": "high"}}, {"when": unary("is_null", T), "then": NAME}], "else": T}, "CASE WHEN m > 500 THEN 'high' WHEN t IS NULL THEN name ELSE t END")
scalar("year", call("year", D), "CAST(year(d) AS DOUBLE)", ORDERS, ORDERS_SQL)
scalar("year_of_text", call("year", T), "CAST(year(d) AS DOUBLE)", ORDERS, ORDERS_SQL)
for _unit in ("year", "month", "day"):
    scalar(f"date_trunc_{_unit}", call("date_trunc", _unit, D), f"CAST(date_trunc('{_unit}', d) AS DATE)", ORDERS, ORDERS_SQL)
