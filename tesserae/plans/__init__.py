"""JSON plans: a directed acyclic graph of named operations, checked whole before a row is read.

{"version": 4, "inputs": ["orders"], "nodes": [{"id": "f", "op": "table.filter", "inputs":
["orders"], "config": {...}}], "output": "f"}

validate() builds every node over empty frames of the inputs' schemas, so that wrong
names, types and configurations are found from schemas alone; run() then folds the same
graph over the data into one DataFrame, which Catalyst optimises as a whole.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import OPERATIONS, apply
from ..relation import ORD, PlanError, with_order

MOST_NODES, MOST_EDGES, MOST_DEPTH, MOST_READERS, MOST_INPUTS = 1024, 4096, 256, 64, 16
#: Their output columns depend on data, so they can't be inside a plan unless these options fix them.
DATA_DEPENDENT = {"table.pivot": "mapping", "table.transpose": None, "table.flatten_json": "output_columns"}


@dataclass(frozen=True)
class Node:
    id: str
    op: str
    inputs: tuple[str, ...]
    config: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Plan:
    inputs: tuple[str, ...]
    nodes: tuple[Node, ...]
    output: str


def parse(text: str | dict) -> Plan:
    """Reads a plan and checks its structure; the nodes come back in topological order."""
    raw = json.loads(text) if isinstance(text, str) else text
    unknown = set(raw) - {"version", "schema_version", "inputs", "nodes", "output"}
    if unknown:
        raise PlanError(f"unknown entries of the plan: {sorted(unknown)}")
    if not isinstance(raw.get("nodes"), list) or not 1 <= len(raw["nodes"]) <= MOST_NODES:
        raise PlanError(f"a plan has 1 to {MOST_NODES} nodes")
    nodes = []
    for n in raw["nodes"]:
        if set(n) - {"id", "op", "inputs", "config"}:
            raise PlanError(f"unknown entries of node {n.get('id')!r}")
        nodes.append(Node(n["id"], n["op"], tuple(n.get("inputs", [])), n.get("config", {})))
    inputs = tuple(raw.get("inputs", []))
    names = [*inputs, *[n.id for n in nodes]]
    if len(set(names)) != len(names):
        raise PlanError("a name is used twice")
    by_name = {n.id: n for n in nodes}
    output = raw.get("output") or nodes[-1].id
    if output not in by_name:
        raise PlanError(f"there is no node {output!r}")
    for n in nodes:
        if n.op not in OPERATIONS:
            raise PlanError(f"there is no operation {n.op!r}")
        want = OPERATIONS[n.op].inputs
        if want >= 0 and len(n.inputs) != want or not n.inputs:
            raise PlanError(f"node {n.id!r} has {len(n.inputs)} inputs")
        for i in n.inputs:
            if i not in names:
                raise PlanError(f"node {n.id!r} reads {i!r}, which is not there")
    ordered: list[Node] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        stack = [(name, iter(by_name[name].inputs))]
        state[name] = 1
        while stack:
            here, rest = stack[-1]
            for i in rest:
                if i in by_name and state.get(i) == 1:
                    raise PlanError("the plan has a cycle")
                if i in by_name and i not in state:
                    state[i] = 1
                    stack.append((i, iter(by_name[i].inputs)))
                    break
            else:
                state[here] = 2
                ordered.append(by_name[here])
                stack.pop()

    visit(output)
    if len(ordered) != len(nodes):
        raise PlanError(f"nodes without a use: {sorted(set(by_name) - {n.id for n in ordered})}")
    readers = Counter(i for n in nodes for i in n.inputs)
    depth: dict[str, int] = {}
    for n in ordered:
        depth[n.id] = 1 + max((depth.get(i, 0) for i in n.inputs), default=0)
    for what, found, most in (("inputs", len(inputs), MOST_INPUTS), ("edges", sum(readers.values()), MOST_EDGES), ("levels", depth[output], MOST_DEPTH), ("readers of one node", max(readers.values()), MOST_READERS)):
        if found > most:
            raise PlanError(f"the plan has {found} {what}; {most} are allowed")
    return Plan(inputs, tuple(ordered), output)


def fingerprint(plan: Plan | str | dict) -> str:
    """SHA-256 of what a plan computes: the same for other orders of nodes and keys and for other layouts of its text."""
    p = plan if isinstance(plan, Plan) else parse(plan)
    nodes = sorted([n.id, n.op, list(n.inputs), n.config] for n in p.nodes)
    return hashlib.sha256(json.dumps([sorted(p.inputs), nodes, p.output], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


#: What an operation asks of the cluster.
COSTS = {"S": "row by row, inside the scan's stage", "B": "needs its whole input: a shuffle or an aggregate", "BB": "brings two inputs together: shuffles of both"}


def steps(plan: Plan | str | dict) -> list[dict]:
    """The nodes in the order of their work, with what each one costs."""
    p = plan if isinstance(plan, Plan) else parse(plan)
    return [{"id": n.id, "op": n.op, "inputs": list(n.inputs), "kind": OPERATIONS[n.op].kind, "cost": COSTS[OPERATIONS[n.op].kind]} for n in p.nodes]


def fold(plan: Plan, frames: Mapping[str, DataFrame]) -> DataFrame:
    missing = set(plan.inputs) - set(frames)
    if missing:
        raise PlanError(f"missing inputs: {sorted(missing)}")
    held: dict[str, DataFrame] = dict(frames)
    for n in plan.nodes:
        try:
            held[n.id] = apply(n.op, *[held[i] for i in n.inputs], **n.config)
        except PlanError as e:
            raise PlanError(f"node {n.id!r}: {e}") from None
        except TypeError as e:
            raise PlanError(f"node {n.id!r}: {e}") from None
    return held[plan.output]


def validate(spark: SparkSession, plan: Plan | str | dict, schemas: Mapping[str, T.StructType]) -> T.StructType:
    """The schema of the output, from the schemas of the inputs; no data is read."""
    p = plan if isinstance(plan, Plan) else parse(plan)
    for n in p.nodes:
        if n.op in DATA_DEPENDENT and not (DATA_DEPENDENT[n.op] and n.config.get(DATA_DEPENDENT[n.op])):
            raise PlanError(f"node {n.id!r}: the columns of {n.op} depend on data")
    out = fold(p, {k: spark.createDataFrame([], s) for k, s in schemas.items()})
    return T.StructType([f for f in out.schema.fields if f.name != ORD])


def run(plan: Plan | str | dict, frames: Mapping[str, DataFrame], order: Mapping[str, str] | None = None) -> DataFrame:
    """The plan's output as one lazy DataFrame. order: the column that gives an input its row order."""
    p = plan if isinstance(plan, Plan) else parse(plan)
    with_orders = {k: with_order(f, *([order[k]] if order and k in order else [])) for k, f in frames.items()}
    return fold(p, with_orders).drop(ORD)


def explain(plan: Plan | str | dict, frames: Mapping[str, DataFrame]) -> str:
    return run(plan, frames)._jdf.queryExecution().explainString(frames[next(iter(frames))]._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
