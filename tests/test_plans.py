"""Plans, sources and streams."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae import plans, sources, streaming
from tesserae.__main__ import main as command
from tesserae.relation import PlanError

PLAN = {
    "version": 4,
    "inputs": ["a", "b"],
    "nodes": [
        {"id": "big", "op": "table.filter", "inputs": ["a"], "config": {"column": "n", "operator": ">=", "value": 2}},
        {"id": "both", "op": "table.join", "inputs": ["big", "b"], "config": {"left_keys": ["k"], "right_keys": ["k"]}},
        {"id": "sum", "op": "table.aggregate", "inputs": ["both"], "config": {"group_by": ["v_R"], "aggregations": [{"column": "n_L", "function": "sum", "output": "total"}]}},
    ],
}


@pytest.fixture(scope="module")
def frames(spark):
    return {"a": spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "n long, k string"), "b": spark.createDataFrame([("x", "one"), ("y", "two")], "k string, v string")}


def test_a_plan_runs_as_one_query(spark, frames):
    out = plans.run(PLAN, frames)
    assert sorted(map(tuple, out.collect())) == [("one", 2.0), ("two", 3.0)]
    schema = plans.validate(spark, PLAN, {k: f.schema for k, f in frames.items()})
    assert schema.names == ["v_R", "total"]
    assert "PhysicalPlan" in plans.explain(PLAN, frames).replace(" ", "")


def changed(**node):
    p = {**PLAN, "nodes": [dict(n) for n in PLAN["nodes"]]}
    p["nodes"][0] |= node
    return p


@pytest.mark.parametrize("bad", [changed(op="table.nope"), changed(inputs=["zzz"]), changed(inputs=["sum"]), changed(config={"column": "zzz", "operator": ">", "value": 1}), changed(config={"colum": "n"}), changed(id="a"), {**PLAN, "output": "zzz"}, {**PLAN, "output": "both"}, {**PLAN, "more": 1}, {**PLAN, "nodes": []}, changed(inputs=["a", "b"])])
def test_bad_plans_are_refused_before_data_is_read(spark, frames, bad):
    with pytest.raises(PlanError):
        plans.validate(spark, bad, {k: f.schema for k, f in frames.items()})


def test_data_dependent_columns_are_not_for_plans(spark, frames):
    p = {"inputs": ["a"], "nodes": [{"id": "p", "op": "table.pivot", "inputs": ["a"], "config": {"index_col": "k", "column": "k", "value_col": "n"}}]}
    with pytest.raises(PlanError):
        plans.validate(spark, p, {"a": frames["a"].schema})


def node(name, op, inputs, **config):
    return {"id": name, "op": op, "inputs": inputs, "config": config}


def test_plans_with_counts_and_ranges_are_validated_without_data(spark):
    schema = T.StructType([T.StructField("v", T.DoubleType()), T.StructField("k", T.LongType())])
    plan = {"inputs": ["rows"], "nodes": [node("a", "table.bin", ["rows"], column="v", bins=3), node("b", "table.assert_cardinality", ["a"], min_rows=2)]}
    assert plans.validate(spark, plan, {"rows": schema}).names == ["v", "k", "v_bin"]
    df = spark.createDataFrame([(0.0, 1), (3.0, 2), (None, 3)], schema)
    assert {r.k: r.v_bin for r in plans.run(plan, {"rows": df}).collect()} == {1: "(-0.003, 1]", 2: "(2, 3]", 3: None}
    with pytest.raises(Exception, match="row_count"):
        plans.run(plan, {"rows": df.limit(1)}).collect()


def test_filters_reach_the_scan(spark, frames, tmp_path):
    frames["a"].write.parquet(f"{tmp_path}/a")
    plan = plans.explain({"inputs": ["a"], "nodes": [{"id": "f", "op": "table.filter", "inputs": ["a"], "config": {"column": "n", "operator": "==", "value": 2}}, {"id": "s", "op": "table.select_columns", "inputs": ["f"], "config": {"columns": ["n"]}}]}, {"a": spark.read.parquet(f"{tmp_path}/a")})
    assert "EqualTo(n,2)" in plan and "ReadSchema: struct<n:bigint>" in plan


def test_arrow_files(spark, tmp_path):
    t = pa.table({"i": pa.array([1, None], pa.int32()), "d": pa.array(["x", "y"]).dictionary_encode(), "u": pa.array([2**63, 1], pa.uint64())})
    with pa.OSFile(f"{tmp_path}/t.arrow", "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    df = sources.read(spark, f"{tmp_path}/t.arrow", "arrow")
    assert [tuple(map(str, r)) for r in df.collect()] == [("1", "x", str(2**63)), ("None", "y", "1")]
    sources.write(df, f"{tmp_path}/out", "arrow")
    assert sources.read(spark, f"{tmp_path}/out", "arrow").count() == 2
    with pytest.raises(PlanError):
        sources.write(df, f"{tmp_path}/out", "arrow")
    sources.write(df, f"{tmp_path}/pq")
    assert sources.read(spark, f"{tmp_path}/pq").count() == 2


def test_streams(spark, frames, tmp_path):
    source = f"{tmp_path}/in"
    events = spark.range(100).select(F.timestamp_seconds(F.col("id") * 30).alias("ts"), (F.col("id") % 2).alias("u"), F.col("id").alias("n"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("k"))
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    p = {"inputs": ["s", "b"], "nodes": [{"id": "f", "op": "table.filter", "inputs": ["s"], "config": {"column": "n", "operator": "<", "value": 50}}, {"id": "j", "op": "table.join", "inputs": ["f", "b"], "config": {"left_keys": ["k"], "right_keys": ["k"]}}]}
    out = streaming.run(p, {"s": stream, "b": frames["b"]})
    streaming.start(out, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50
    w = streaming.windowed(stream, "ts", "10 minutes", "0 seconds", ["u"], "n")
    streaming.start(w, f"{tmp_path}/w", f"{tmp_path}/ck2").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/w").where("u = 0").agg(F.max("count")).first()[0] == 10
    with pytest.raises(PlanError):
        streaming.run({"inputs": ["s"], "nodes": [{"id": "x", "op": "table.sort", "inputs": ["s"], "config": {"columns": ["n"]}}]}, {"s": stream})


def test_fingerprints_steps_and_limits():
    turned = {**PLAN, "nodes": PLAN["nodes"][::-1], "output": "sum"}
    assert plans.fingerprint(PLAN) == plans.fingerprint(turned) != plans.fingerprint(changed(config={"column": "n", "operator": ">", "value": 2}))
    assert [(s["id"], s["kind"]) for s in plans.steps(turned)] == [("big", "S"), ("both", "BB"), ("sum", "B")]
    chain = [node(f"n{k}", "table.limit", [f"n{k - 1}" if k else "a"], n=1) for k in range(plans.MOST_DEPTH + 1)]
    with pytest.raises(PlanError, match="levels"):
        plans.parse({"inputs": ["a"], "nodes": chain})
    with pytest.raises(PlanError, match="inputs"):
        plans.parse({"inputs": list("abcdefghijklmnopq"), "nodes": [node("x", "table.limit", ["a"], n=1)]})


def test_the_command_line(spark, frames, tmp_path, capsys):
    (tmp_path / "plan.json").write_text(json.dumps(PLAN))
    for name, f in frames.items():
        f.write.parquet(f"{tmp_path}/{name}")
    given = [f"{tmp_path}/plan.json", f"a={tmp_path}/a", f"b=parquet:{tmp_path}/b"]
    assert command(["run", *given, "--output", f"{tmp_path}/out"]) == 0
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [("one", 2.0), ("two", 3.0)]
    capsys.readouterr()
    assert command(["validate", *given]) == 0 and "total" in capsys.readouterr().out
    assert command(["fingerprint", given[0]]) == 0 and capsys.readouterr().out.strip() == plans.fingerprint(PLAN)
    assert command(["operations"]) == 0 and "geo.sjoin" in capsys.readouterr().out
    assert command(["run", given[0]]) == 2 and command(["steps", "/nowhere.json"]) == 2
