"""Queries for the table operations."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import apply
from ..relation import ORD, with_order
from . import query, read


def simple(op: str, table: str, columns: str, config: dict, sql: str | None, key: str | None = None, extra: str = "") -> None:
    """A query of one operation over some columns of one table. key: the column that gives the row order."""

    @query(op.replace(".", "_") + extra, sql)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = read(spark, folder, table).selectExpr(*[c.strip() for c in columns.split(";")])
        if key:
            df = with_order(df, key)
        return apply(op, df, **config).drop(ORD)


C = "c_custkey; c_name; c_nationkey; c_acctbal; c_mktsegment"
simple("table.select_columns", "customer", C, {"columns": ["c_name", "c_custkey"]}, "SELECT c_name, c_custkey FROM customer")
simple("table.drop_columns", "customer", C, {"columns": ["c_name", "nope"]}, "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
simple("table.rename", "customer", "c_custkey; c_name", {"renames": [{"old_name": "c_custkey", "new_name": "c_name"}, {"old_name": "c_name", "new_name": "c_custkey"}]}, "SELECT c_custkey AS c_name, c_name AS c_custkey FROM customer")
simple("table.reorder_columns", "customer", C, {"columns": ["c_name"], "alphabetical": True}, "SELECT c_name, c_acctbal, c_custkey, c_mktsegment, c_nationkey FROM customer")
simple("table.align_schema", "customer", "c_custkey; c_name", {"columns": [{"name": "c_name", "type": "string"}, {"name": "score", "type": "float64", "default": 1.5}, {"name": "note", "type": "string"}]}, "SELECT c_name, CAST(1.5 AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS note FROM customer")
simple("table.add_row_number", "orders", "o_orderkey; o_orderstatus", {"output_column": "n", "start": 10}, "SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) + 9 AS n FROM orders", "o_orderkey")
simple("table.add_row_number", "orders", "o_orderkey; o_orderstatus", {"output_column": "n", "partition_column": "o_orderstatus"}, "SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders", "o_orderkey", "_partitioned")
simple("table.coalesce", "orders", "o_orderkey; if(o_orderkey % 3 = 0, null, o_orderstatus) as a; o_orderpriority as b", {"columns": ["a", "b"], "output_column": "c"}, "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END AS a, o_orderpriority AS b, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderstatus END, o_orderpriority) AS c FROM orders")
simple("table.conditional", "customer", "c_custkey; c_acctbal", {"column": "c_acctbal", "conditions": [{"operator": "<", "value": 0, "result": "debt"}, {"operator": ">=", "value": 5000, "result": "rich"}], "default_value": "plain", "output_column": "band"}, "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal >= 5000 THEN 'rich' ELSE 'plain' END AS band FROM customer")
simple("table.conditional", "customer", "c_custkey; c_mktsegment", {"column": "c_mktsegment", "conditions": [{"operator": "startswith", "value": "A", "result": "1,5"}, {"operator": "contains", "value": "ui", "result": 2}], "default_value": "", "output_column": "w"}, "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment LIKE 'A%' THEN 1.5 WHEN lower(c_mktsegment) LIKE '%ui%' THEN 2.0 END AS w FROM customer", None, "_numeric")
simple("table.lookup", "orders", "o_orderkey; o_orderstatus", {"column": "o_orderstatus", "mapping": {"O": "open", "F": "filled"}, "output_column": "s"}, "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' ELSE o_orderstatus END AS s FROM orders")
simple("table.bin", "lineitem", "l_orderkey; l_linenumber; l_quantity", {"column": "l_quantity", "bins": [0, 10, 25, 50], "labels": ["low", "mid", "high"], "output_column": "b"}, "SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity BETWEEN 0 AND 10 THEN 'low' WHEN l_quantity <= 25 AND l_quantity > 10 THEN 'mid' WHEN l_quantity > 25 AND l_quantity <= 50 THEN 'high' END AS b FROM lineitem")
simple("table.bin", "customer", "c_custkey; c_acctbal", {"column": "c_acctbal", "bins": 4, "labels": ["a", "b", "c", "d"], "output_column": "b"}, "WITH r AS (SELECT min(c_acctbal) lo, max(c_acctbal) hi FROM customer) SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal <= lo + (hi - lo) / 4 THEN 'a' WHEN c_acctbal <= lo + 2 * (hi - lo) / 4 THEN 'b' WHEN c_acctbal <= lo + 3 * (hi - lo) / 4 THEN 'c' ELSE 'd' END AS b FROM customer, r", None, "_equal")
simple("table.filter", "lineitem", "l_orderkey; l_linenumber; l_quantity", {"column": "l_quantity", "operator": "between", "value": "10,20"}, "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 20")
simple("table.filter", "part", "p_partkey; p_name; p_type", {"column": "p_type", "operator": "contains", "value": "st"}, "SELECT p_partkey, p_name, p_type FROM part WHERE lower(p_type) LIKE '%st%'", None, "_text")
simple("table.limit", "orders", "o_orderkey; o_totalprice", {"n": 25, "offset": 5}, "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 5", "o_orderkey")
simple("table.concat_columns", "customer", "c_custkey; c_name; if(c_custkey % 4 = 0, null, c_mktsegment) as seg", {"columns": ["c_name", "seg"], "output_column": "j", "separator": "-"}, "SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS seg, concat_ws('-', c_name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END) AS j FROM customer")
simple("table.split_column", "part", "p_partkey; p_name", {"column": "p_name", "new_columns": ["a", "b"], "delimiter": " "}, "SELECT p_partkey, p_name, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, 1, instr(p_name, ' ') - 1) ELSE p_name END AS a, CASE WHEN instr(p_name, ' ') > 0 THEN substr(p_name, instr(p_name, ' ') + 1) END AS b FROM part")
simple("table.string_pad", "nation", "n_nationkey; n_name", {"column": "n_name", "width": 9, "side": "right", "fill_char": "."}, "SELECT n_nationkey, CASE WHEN length(n_name) < 9 THEN rpad(n_name, 9, '.') ELSE n_name END AS n_name FROM nation")
simple("table.string_length", "documents", "doc_id; text", {"column": "text", "output_column": "n"}, "SELECT doc_id, text, length(text) AS n FROM documents")
simple("table.string_extract", "customer", "c_custkey; c_name", {"column": "c_name", "pattern": r"(\d+)$", "output_column": "num"}, r"SELECT c_custkey, c_name, CASE WHEN regexp_matches(c_name, '(\d+)$') THEN regexp_extract(c_name, '(\d+)$', 1) END AS num FROM customer")
simple("table.text_normalize", "customer", "c_custkey; concat('  ', c_name, '  x ') as t", {"columns": ["t"], "operations": ["trim", "lower", "strip_double_spaces"]}, "SELECT c_custkey, lower(c_name) || ' x' AS t FROM customer")
simple("table.replace", "orders", "o_orderkey; o_orderpriority", {"column": "o_orderpriority", "old_value": r"^(\d)-", "new_value": "$1/", "regex": True}, r"SELECT o_orderkey, regexp_replace(o_orderpriority, '^(\d)-', '\1/', 'g') AS o_orderpriority FROM orders")
simple("table.replace", "orders", "o_orderkey; o_orderstatus", {"column": "o_orderstatus", "old_value": "O", "new_value": "open"}, "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END AS o_orderstatus FROM orders", None, "_literal")
E = "event_id; if(event_id % 5 < 3, null, value) as v"
EV = "(SELECT event_id, CASE WHEN event_id % 5 < 3 THEN NULL ELSE value END AS v FROM events)"
simple("table.fill_na", "events", E, {"column": "v", "value": 0.0}, f"SELECT event_id, coalesce(v, 0.0) AS v FROM {EV}")
simple("table.fill_na", "events", E, {"column": "v", "method": "ffill"}, f"SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id) AS v FROM {EV}", "event_id", "_ffill")
simple("table.fill_na", "events", E, {"column": "v", "method": "bfill"}, f"SELECT event_id, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v FROM {EV}", "event_id", "_bfill")
simple("table.type_cast", "orders", "o_orderkey; cast(o_totalprice as string) as p", {"column": "p", "target_type": "float"}, "SELECT o_orderkey, o_totalprice AS p FROM orders")
simple("table.type_cast", "orders", "o_orderkey; date_format(o_orderdate, 'dd/MM/yyyy') as d", {"column": "d", "target_type": "date32"}, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders", None, "_date")
D = "o_orderkey; date_format(o_orderdate, 'yyyy-MM-dd') as d"
DS = "strftime(o_orderdate, '%Y-%m-%d') AS d"
simple("table.date_extract", "orders", D, {"column": "d", "parts": ["year", "month", "quarter", "weekday", "week"], "prefix": "x_"}, f"SELECT o_orderkey, {DS}, year(o_orderdate) AS x_year, month(o_orderdate) AS x_month, quarter(o_orderdate) AS x_quarter, isodow(o_orderdate) - 1 AS x_weekday, weekofyear(o_orderdate) AS x_week FROM orders")
simple("table.date_format", "orders", D, {"column": "d", "input_format": "%Y-%m-%d", "output_format": "%d/%m/%y", "output_column": "f"}, f"SELECT o_orderkey, {DS}, strftime(o_orderdate, '%d/%m/%y') AS f FROM orders")
simple("table.date_add", "orders", D, {"column": "d", "input_format": "%Y-%m-%d", "amount": -1, "unit": "months", "output_column": "f"}, f"SELECT o_orderkey, {DS}, strftime(CAST(o_orderdate AS DATE) - INTERVAL 1 MONTH, '%Y-%m-%d') AS f FROM orders")
simple("table.date_diff", "orders", "o_orderkey; date_format(o_orderdate, 'yyyy-MM-dd') as d; '1995-06-15' as e", {"start_column": "d", "end_column": "e", "input_format": "%Y-%m-%d", "unit": "days", "output_column": "n"}, f"SELECT o_orderkey, {DS}, '1995-06-15' AS e, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1995-06-15') AS DOUBLE) AS n FROM orders")
simple("table.timezone_convert", "orders", "o_orderkey; date_format(o_orderdate, 'yyyy-MM-dd 12:00:00') as d", {"column": "d", "input_format": "%Y-%m-%d %H:%M:%S", "source_timezone": "UTC", "target_timezone": "Asia/Tokyo", "output_column": "t"}, "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d 12:00:00') AS d, strftime(o_orderdate, '%Y-%m-%d 21:00:00') AS t FROM orders")
simple("table.formula", "lineitem", "l_orderkey; l_linenumber; l_extendedprice; l_discount; l_tax", {"new_column": "charge", "formula": "l_extendedprice * (1 - l_discount) * (1 + l_tax)"}, "SELECT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_tax, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
simple("table.expression", "customer", "c_custkey; c_name; c_acctbal", {"output_column": "x", "expression": {"case": [{"when": {"binary": "and", "left": {"binary": "greater", "left": {"column": "c_acctbal"}, "right": {"literal": 0}}, "right": {"function": "ends_with", "arguments": [{"column": "c_name"}, {"literal": "7"}]}}, "then": {"function": "round", "arguments": [{"binary": "divide", "left": {"column": "c_acctbal"}, "right": {"literal": 3}}, {"literal": 2}]}}], "else": {"unary": "negate", "operand": {"function": "length", "arguments": [{"column": "c_name"}]}}}}, "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_acctbal > 0 AND c_name LIKE '%7' THEN round(c_acctbal / 3, 2) ELSE CAST(-length(c_name) AS DOUBLE) END AS x FROM customer")
simple("table.md5_hash", "customer", "c_custkey; c_name; c_mktsegment", {"columns": ["c_name", "c_mktsegment"], "output_column": "h"}, "SELECT c_custkey, c_name, c_mktsegment, md5(lower(trim(c_mktsegment)) || chr(31) || lower(trim(c_name))) AS h FROM customer")
FRAME = "unhex(lpad(printf('%X', strlen({0})), 16, '0')) || encode({0})"


def frame_sql(name: str, type_: str, value: str) -> str:
    return " || ".join([FRAME.format(f"'{name}'"), FRAME.format(f"'{type_}'"), "unhex('01')", FRAME.format(value)])


simple("table.sha256_hash", "customer", "c_custkey; c_name", {"columns": ["c_name"], "output_column": "h"}, f"SELECT c_custkey, c_name, sha256(encode('row-sha256-v1') || unhex('00') || {frame_sql('c_name', 'Utf8', 'c_name')}) AS h FROM customer")
simple("table.stable_fingerprint", "customer", "c_custkey; c_name; c_mktsegment", {"columns": ["c_name", "c_mktsegment"], "output_column": "h", "algorithm": "sha256"}, f"SELECT c_custkey, c_name, c_mktsegment, sha256(encode('row-fingerprint-v1') || unhex('00') || {frame_sql('c_name', 'Utf8', 'c_name')} || {frame_sql('c_mktsegment', 'Utf8', 'c_mktsegment')}) AS h FROM customer")
simple("table.mask_data", "customer", "c_custkey; c_name", {"maskings": [{"column": "c_name", "type": "cf"}]}, "SELECT c_custkey, substr(c_name, 1, 3) || repeat('*', length(c_name) - 6) || right(c_name, 3) AS c_name FROM customer")


PADS = [bytes((b"demo".ljust(64, b"\0")[k]) ^ x for k in range(64)).hex() for x in (0x5C, 0x36)]


@query("table_hmac_sha256", f"SELECT c_custkey, c_name, sha256(unhex('{PADS[0]}') || unhex(sha256(unhex('{PADS[1]}') || encode(c_name)))) AS hmac FROM customer")
def hmac_sha256(spark: SparkSession, folder: str) -> DataFrame:
    os.environ.setdefault("TESSERAE_DEMO_KEY", "demo")
    return apply("table.hmac_sha256", read(spark, folder, "customer").select("c_custkey", "c_name"), columns=["c_name"], key_env="TESSERAE_DEMO_KEY")


@query("table_uuid_generator", "SELECT n_nationkey, 36 AS n FROM nation")
def uuid_generator(spark: SparkSession, folder: str) -> DataFrame:
    return apply("table.uuid_generator", read(spark, folder, "nation")).select("n_nationkey", F.length("uuid").alias("n"))


simple("table.aggregate", "lineitem", "l_orderkey; l_linenumber; l_returnflag; l_linestatus; l_quantity; l_extendedprice; l_orderkey * 10 + l_linenumber as k", {"group_by": ["l_returnflag", "l_linestatus"], "aggregations": [{"column": "l_quantity", "function": f} for f in ("sum", "mean", "min", "max", "stddev", "median", "count", "nunique")]}, "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS l_quantity_sum, avg(l_quantity) AS l_quantity_mean, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max, stddev_samp(l_quantity) AS l_quantity_stddev, quantile_cont(l_quantity, 0.5) AS l_quantity_median, count(l_quantity) AS l_quantity_count, count(DISTINCT l_quantity) AS l_quantity_nunique FROM lineitem GROUP BY ALL")
simple("table.aggregate", "orders", "o_orderkey; o_custkey; o_orderstatus", {"group_by": ["o_custkey"], "aggregations": [{"column": "o_orderstatus", "function": "first", "output": "f"}, {"column": "o_orderstatus", "function": "last", "output": "l"}, {"column": "o_orderkey", "function": "concat", "output": "c"}]}, "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS f, arg_max(o_orderstatus, o_orderkey) AS l, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS c FROM orders GROUP BY o_custkey", "o_orderkey", "_positional")
simple("table.statistics", "orders", "o_orderkey; o_orderstatus; o_totalprice", {"column": "o_totalprice", "group_by": "o_orderstatus", "stats": ["count", "mean", "median", "std"], "output_prefix": "p"}, "SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(count(o_totalprice) OVER w AS DOUBLE) AS p_count, avg(o_totalprice) OVER w AS p_mean, quantile_cont(o_totalprice, 0.5) OVER w AS p_median, stddev_samp(o_totalprice) OVER w AS p_std FROM orders WINDOW w AS (PARTITION BY o_orderstatus)")
simple("table.pivot", "orders", "o_orderkey; o_orderpriority; o_orderstatus; o_totalprice", {"index_col": "o_orderpriority", "column": "o_orderstatus", "value_col": "o_totalprice", "aggr_func": "max", "mapping": {"F": "f", "O": "o"}}, "SELECT o_orderpriority, max(o_totalprice) FILTER (o_orderstatus = 'F') AS f, max(o_totalprice) FILTER (o_orderstatus = 'O') AS o FROM orders GROUP BY o_orderpriority", "o_orderkey")
simple("table.distinct", "orders", "o_orderkey; o_custkey; o_orderstatus", {"subset": ["o_custkey"], "keep": "last"}, "SELECT max(o_orderkey) AS o_orderkey, o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey", "o_orderkey")
simple("table.distinct", "orders", "o_orderkey; o_custkey", {"subset": ["o_custkey"], "keep": "false"}, "SELECT max(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1", "o_orderkey", "_unique")
simple("table.dedup_advanced", "orders", "o_orderkey; o_custkey; o_totalprice", {"subset": ["o_custkey"], "order_column": "o_totalprice", "ascending": False}, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1", "o_orderkey")
simple("table.sort", "supplier", "s_suppkey; s_nationkey; s_acctbal", {"columns": ["s_nationkey", "s_acctbal"], "ascending": False}, "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey DESC, s_acctbal DESC", "s_suppkey")
simple("table.top_n", "lineitem", "l_orderkey; l_linenumber; l_extendedprice; l_orderkey * 10 + l_linenumber as k", {"columns": ["l_extendedprice", "k"], "n": 50}, "SELECT l_orderkey, l_linenumber, l_extendedprice, l_orderkey * 10 + l_linenumber AS k FROM lineitem ORDER BY l_extendedprice DESC, k DESC LIMIT 50", "k")
W = "o_orderkey; o_custkey; o_totalprice"
for _f, _sql in {
    "rank": "CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_custkey, o_totalprice) - 1) / 2.0 AS DOUBLE)",
    "dense_rank": "CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS DOUBLE)",
    "percent_rank": "percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice)",
    "cume_dist": "cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_totalprice)",
    "cumsum": "sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)",
    "running_mean": "avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)",
    "cumcount": "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS DOUBLE)",
    "lag": "lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "lead": "lead(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "pct_change": "o_totalprice / lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1",
    "ntile": "CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) * least(4, count(*) OVER (PARTITION BY o_custkey)) / count(*) OVER (PARTITION BY o_custkey)) + 1 AS DOUBLE)",
}.items():
    simple("table.window_function", "orders", W, {"column": "o_totalprice", "function": _f, "group_by": "o_custkey", "output_column": "w"}, f"SELECT o_orderkey, o_custkey, o_totalprice, {_sql} AS w FROM orders", "o_orderkey", f"_{_f}")
for _f in ("sum", "mean", "min", "max", "stddev"):
    _a = {"mean": "avg", "stddev": "stddev_samp"}.get(_f, _f)
    simple("table.rolling_window", "events", "event_id; user_id; value", {"column": "value", "function": _f, "group_by": "user_id", "window": 4, "min_periods": 2, "output_column": "r"}, f"SELECT event_id, user_id, value, CASE WHEN count(value) OVER w >= 2 THEN {_a}(value) OVER w END AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)", "event_id", f"_{_f}")
simple("table.melt", "lineitem", "l_orderkey; l_linenumber; l_quantity; l_discount; l_tax", {"id_columns": ["l_orderkey", "l_linenumber"]}, "SELECT l_orderkey, l_linenumber, 'l_quantity' AS variable, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem")
simple("table.transpose", "region", "r_regionkey; r_name", {"type_policy": "string"}, "SELECT 'r_regionkey' AS \"column\", '0' AS col_0, '1' AS col_1, '2' AS col_2, '3' AS col_3, '4' AS col_4 UNION ALL SELECT 'r_name', max(r_name) FILTER (r_regionkey = 0), max(r_name) FILTER (r_regionkey = 1), max(r_name) FILTER (r_regionkey = 2), max(r_name) FILTER (r_regionkey = 3), max(r_name) FILTER (r_regionkey = 4) FROM region", "r_regionkey")
simple("table.explode", "embeddings", "vec_id; embedding as e", {"column": "e"}, "SELECT vec_id, unnest(embedding) AS e FROM embeddings")
simple("table.unnest", "customer", "c_custkey; named_struct('a', c_name, 'b', c_acctbal) as s", {"column": "s", "prefix": "s_"}, "SELECT c_custkey, c_name AS s_a, c_acctbal AS s_b FROM customer")
simple("table.flatten_json", "events", "event_id; props", {"column": "props", "prefix": "p_", "output_columns": ["p_k"]}, "SELECT event_id, props, json_extract_string(props, '$.k') AS p_k FROM events")
simple("table.assert_schema", "nation", "n_nationkey; n_name", {"fields": [{"name": "n_name", "type": "string"}], "allow_extra": True}, "SELECT n_nationkey, n_name FROM nation")
simple("table.assert_not_null", "nation", "n_nationkey; n_name", {"columns": ["n_name"]}, "SELECT n_nationkey, n_name FROM nation")
simple("table.assert_unique", "orders", "o_orderkey; o_custkey", {"columns": ["o_orderkey"]}, "SELECT o_orderkey, o_custkey FROM orders")
simple("table.assert_range", "lineitem", "l_orderkey; l_discount", {"column": "l_discount", "min": 0, "max": 1}, "SELECT l_orderkey, l_discount FROM lineitem")
simple("table.assert_regex", "customer", "c_custkey; c_name", {"column": "c_name", "pattern": r"\d+$"}, "SELECT c_custkey, c_name FROM customer")
simple("table.assert_cardinality", "region", "r_regionkey; r_name", {"exact_rows": 5}, "SELECT r_regionkey, r_name FROM region")
simple("table.validate_rules", "customer", "c_custkey; c_acctbal; c_mktsegment", {"rules": [{"name": "solvent", "column": "c_acctbal", "operator": "ge", "value": 0}, {"name": "auto", "column": "c_mktsegment", "operator": "regex", "value": "^A", "severity": "warning"}]}, "SELECT c_custkey, c_acctbal, c_mktsegment, c_acctbal >= 0 AS _valid, CASE WHEN c_acctbal >= 0 THEN '' ELSE 'solvent' END AS _errors, CASE WHEN c_mktsegment LIKE 'A%' THEN '' ELSE 'auto' END AS _warnings FROM customer")
simple("table.validate_rules", "customer", "c_custkey; c_acctbal", {"rules": [{"name": "solvent", "column": "c_acctbal", "operator": "ge", "value": 0}, {"name": "rich", "column": "c_acctbal", "operator": "gt", "value": 9000, "severity": "warning"}], "output_mode": "summary"}, "SELECT 'solvent' AS rule, count(*) FILTER (c_acctbal < 0) AS errors, CAST(0 AS BIGINT) AS warnings FROM customer UNION ALL SELECT 'rich', 0, count(*) FILTER (c_acctbal <= 9000) FROM customer", None, "_summary")


@query("table_assert_metadata", "SELECT r_regionkey, r_name FROM region")
def assert_metadata(spark: SparkSession, folder: str) -> DataFrame:
    from ..operators.quality import with_metadata

    return apply("table.assert_metadata", with_metadata(read(spark, folder, "region"), owner="demo"), expected={"owner": "demo"})


@query("table_sample", "SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS ids")
def sample(spark: SparkSession, folder: str) -> DataFrame:
    out = apply("table.sample", with_order(read(spark, folder, "orders"), "o_orderkey"), n=100, random_state=7)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("ids"))


def two(op: str, left: tuple[str, str], right: tuple[str, str], config: dict, sql: str, extra: str = "", key: str | None = None, right_key: str | None = None) -> None:
    @query(op.replace(".", "_") + extra, sql)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        a, b = (read(spark, folder, t).selectExpr(*[c.strip() for c in cs.split(";")]) for t, cs in (left, right))
        return apply(op, with_order(a, key) if key else a, with_order(b, right_key) if right_key else b, **config).drop(ORD)


ORDERS, CUSTOMERS = ("orders", "o_orderkey; o_custkey; o_totalprice"), ("customer", "c_custkey; c_name")
KEYS = {"left_keys": ["o_custkey"], "right_keys": ["c_custkey"]}
two("table.join", ORDERS, CUSTOMERS, KEYS, "SELECT o_orderkey AS \"o_orderkey_L\", o_custkey, o_totalprice AS \"o_totalprice_L\", c_name AS \"c_name_R\" FROM orders JOIN customer ON o_custkey = c_custkey")
HALF = ("customer", "c_custkey + 700 as c_custkey; c_name")
for _how, _sql in {"left": "LEFT", "right": "RIGHT", "outer": "FULL"}.items():
    two("table.join", ORDERS, HALF, {**KEYS, "how": _how}, f"SELECT o_orderkey AS \"o_orderkey_L\", {'o_custkey' if _how == 'left' else 'coalesce(o_custkey, k)'} AS o_custkey, o_totalprice AS \"o_totalprice_L\", c_name AS \"c_name_R\" FROM orders {_sql} JOIN (SELECT c_custkey + 700 AS k, c_name FROM customer) ON o_custkey = k", f"_{_how}")
RICH = ("customer", "if(c_acctbal > 5000, c_custkey, null) as c_custkey")
two("table.semi_join", ORDERS, RICH, KEYS, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
two("table.anti_join", ORDERS, RICH, KEYS, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
two("table.cross_join", ("nation", "n_nationkey; n_name as name"), ("region", "r_regionkey; r_name as name"), {}, "SELECT n_nationkey, n_name AS name_x, r_regionkey, r_name AS name_y FROM nation, region")
A, B = ("events", "event_id; user_id; event_id as at"), ("events", "event_id as other; user_id; event_id * 2 + 1 as at; value")
for _d, _sql in {
    "backward": "SELECT max(at) FROM b WHERE b.user_id = a.user_id AND b.at <= a.at",
    "forward": "SELECT min(at) FROM b WHERE b.user_id = a.user_id AND b.at >= a.at",
}.items():
    _j = "a.user_id = b.user_id AND a.at >= b.at" if _d == "backward" else "a.user_id = b.user_id AND a.at <= b.at"
    two("table.asof_join", A, B, {"left_on": "at", "right_on": "at", "left_by": ["user_id"], "right_by": ["user_id"], "direction": _d}, f"WITH a AS (SELECT event_id, user_id, event_id AS at FROM events), b AS (SELECT event_id AS other, user_id, event_id * 2 + 1 AS at, value FROM events) SELECT a.event_id, a.user_id, a.at, b.other, b.value FROM a ASOF LEFT JOIN b ON {_j}", f"_{_d}", "event_id", "other")
two("table.asof_join", A, B, {"left_on": "at", "right_on": "at", "left_by": ["user_id"], "right_by": ["user_id"], "direction": "nearest", "tolerance": 500}, "WITH a AS (SELECT event_id, user_id, event_id AS at FROM events), b AS (SELECT event_id AS other, user_id, event_id * 2 + 1 AS at, value FROM events), p AS (SELECT a.*, b.other, b.value, b.at AS bat FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.at >= b.at), n AS (SELECT a.event_id, b.other, b.value, b.at AS bat FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.at <= b.at), x AS (SELECT p.event_id, p.user_id, p.at, CASE WHEN p.at - p.bat <= 500 THEN p.bat END AS pb, p.other AS po, p.value AS pv, CASE WHEN n.bat - p.at <= 500 THEN n.bat END AS nb, n.other AS n_o, n.value AS nv FROM p JOIN n USING (event_id)) SELECT event_id, user_id, x.at, CASE WHEN pb IS NOT NULL AND (nb IS NULL OR x.at - pb <= nb - x.at) THEN po WHEN nb IS NOT NULL THEN n_o END AS other, CASE WHEN pb IS NOT NULL AND (nb IS NULL OR x.at - pb <= nb - x.at) THEN pv WHEN nb IS NOT NULL THEN nv END AS value FROM x", "_nearest", "event_id", "other")
N1, N2 = ("nation", "n_nationkey; n_name as name"), ("nation", "n_nationkey as other; concat(n_name, 'A') as name")
for _m, _sql in {"levenshtein": "1.0 - levenshtein(lower(a.n_name), lower(b.name)) / greatest(length(a.n_name), length(b.name))", "jaro_winkler": "jaro_winkler_similarity(lower(a.n_name), lower(b.name))"}.items():
    two("table.fuzzy_join", N1, N2, {"left_key": "name", "right_key": "name", "metric": _m, "threshold": 0.7, "score_column": "score"}, f"SELECT n_nationkey, n_name AS name, other, b.name AS \"name_R\", {_sql} AS score FROM nation a JOIN (SELECT n_nationkey AS other, n_name || 'A' AS name FROM nation) b ON left(lower(n_name), 2) = left(lower(b.name), 2) WHERE {_sql} >= 0.7" if _sql else None, f"_{_m}", "n_nationkey")  # type: ignore[arg-type]
S1, S2 = ("customer", "c_nationkey; c_mktsegment"), ("customer", "(c_nationkey + 13) % 30 as c_nationkey; c_mktsegment")
Q1, Q2 = "SELECT c_nationkey, c_mktsegment FROM customer", "SELECT CAST((c_nationkey + 13) % 30 AS INTEGER) AS c_nationkey, c_mktsegment FROM customer"
two("table.concat", S1, S2, {}, f"{Q1} UNION ALL {Q2}")
two("table.concat_by_name", S1, ("customer", "c_mktsegment; c_custkey"), {}, "SELECT c_nationkey, c_mktsegment, NULL AS c_custkey FROM customer UNION ALL SELECT NULL, c_mktsegment, c_custkey FROM customer")
two("table.union_distinct", S1, S2, {}, f"{Q1} UNION {Q2}")
two("table.intersect", S1, S2, {}, f"{Q1} INTERSECT {Q2}")
two("table.except", S1, S2, {}, f"{Q1} EXCEPT {Q2}")
two("table.table_diff", ("customer", "c_custkey; c_name; c_mktsegment"), ("customer", "c_custkey + 5 as c_custkey; if(c_custkey % 2 = 0, c_name, 'x') as c_name; c_mktsegment"), {"left_keys": ["c_custkey"], "right_keys": ["c_custkey"], "compare_columns": ["c_name"]}, "WITH l AS (SELECT c_custkey AS k, c_name AS n, c_mktsegment AS m FROM customer), r AS (SELECT c_custkey + 5 AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'x' END AS n, c_mktsegment AS m FROM customer), d AS (SELECT coalesce(r.k, l.k) AS c_custkey, CASE WHEN r.k IS NULL THEN l.n ELSE r.n END AS c_name, CASE WHEN r.k IS NULL THEN l.m ELSE r.m END AS c_mktsegment, CASE WHEN r.k IS NULL THEN 'DELETED' WHEN l.k IS NULL THEN 'ADDED' WHEN l.n <> r.n THEN 'MODIFIED' END AS _diff_status, l.n AS o FROM l FULL JOIN r ON l.k = r.k) SELECT c_custkey, c_name, c_mktsegment, _diff_status, CASE WHEN _diff_status = 'MODIFIED' THEN 'c_name' ELSE '' END AS _diff_columns, CASE WHEN _diff_status = 'MODIFIED' THEN o ELSE '' END AS _diff_old_values FROM d WHERE _diff_status IS NOT NULL")
two("table.assert_foreign_key", ORDERS, CUSTOMERS, KEYS, "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
two("table.reconcile", ("orders", "o_custkey as k"), ("customer", "c_custkey as k"), {"left_keys": ["k"], "right_keys": ["k"]}, "WITH a AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT c_custkey AS k, count(*) AS m FROM customer GROUP BY 1), f AS (SELECT coalesce(n, 0) AS n, coalesce(m, 0) AS m FROM a FULL JOIN b ON a.k = b.k) SELECT 'matched_rows' AS metric, CAST(sum(least(n, m)) AS BIGINT) AS value FROM f UNION ALL SELECT 'left_only_rows', sum(greatest(n - m, 0)) FROM f UNION ALL SELECT 'right_only_rows', sum(greatest(m - n, 0)) FROM f UNION ALL SELECT 'left_duplicate_rows', sum(greatest(n - 1, 0)) FROM f UNION ALL SELECT 'right_duplicate_rows', sum(greatest(m - 1, 0)) FROM f")
