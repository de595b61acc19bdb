"""Whole plans, the flagship among them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .. import plans
from . import query, read

REVENUE = {
    "version": 4,
    "inputs": ["lineitem", "orders", "customer"],
    "nodes": [
        {"id": "shipped", "op": "table.filter", "inputs": ["lineitem"], "config": {"column": "l_quantity", "operator": ">", "value": 10}},
        {"id": "priced", "op": "table.formula", "inputs": ["shipped"], "config": {"new_column": "revenue", "formula": "l_extendedprice * (1 - l_discount)"}},
        {"id": "slim", "op": "table.select_columns", "inputs": ["priced"], "config": {"columns": ["l_orderkey", "revenue"]}},
        {"id": "sold", "op": "table.join", "inputs": ["slim", "orders"], "config": {"left_keys": ["l_orderkey"], "right_keys": ["o_orderkey"]}},
        {"id": "who", "op": "table.join", "inputs": ["sold", "customer"], "config": {"left_keys": ["o_custkey_R"], "right_keys": ["c_custkey"]}},
        {"id": "by", "op": "table.aggregate", "inputs": ["who"], "config": {"group_by": ["c_mktsegment_R"], "aggregations": [{"column": "revenue_L_L", "function": "sum", "output": "revenue"}, {"column": "revenue_L_L", "function": "count", "output": "n"}]}},
        {"id": "top", "op": "table.sort", "inputs": ["by"], "config": {"columns": ["revenue"], "ascending": False}},
    ],
    "output": "top",
}


@query("plan_revenue", "SELECT c_mktsegment AS \"c_mktsegment_R\", sum(l_extendedprice * (1 - l_discount)) AS revenue, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_quantity > 10 GROUP BY c_mktsegment")
def revenue(spark: SparkSession, folder: str) -> DataFrame:
    return plans.run(REVENUE, {t: read(spark, folder, t) for t in REVENUE["inputs"]})
