"""python -m tesserae COMMAND: plans from the command line.

operations             lists the operations and what each one costs
fingerprint PLAN       the plan's digest
steps PLAN             its nodes in the order of their work
validate PLAN TABLES   the output's schema, from the schemas of the tables
explain PLAN TABLES    Spark's plan
run PLAN TABLES --output PATH
                       computes the output and publishes it once

PLAN is a file of JSON; TABLES are NAME=PATH or NAME=FORMAT:PATH for each input.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from . import plans, sources
from .operators import OPERATIONS
from .relation import PlanError


def tables(spark: SparkSession, given: list[str]) -> dict[str, DataFrame]:
    out = {}
    for t in given:
        name, _, path = t.partition("=")
        kind, colon, rest = path.partition(":")
        known = colon and kind in (*sources.FORMATS, "arrow", "ipc")
        if not path:
            raise PlanError(f"{t!r} is not NAME=PATH")
        out[name] = sources.read(spark, rest, kind) if known else sources.read(spark, path)
    return out


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tesserae", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["operations", "fingerprint", "steps", "validate", "explain", "run"])
    parser.add_argument("plan", nargs="?")
    parser.add_argument("tables", nargs="*")
    parser.add_argument("--output")
    parser.add_argument("--format", default="parquet")
    a = parser.parse_args(arguments)
    if a.command == "operations":
        for name in sorted(OPERATIONS):
            print(f"{name}\t{plans.COSTS[OPERATIONS[name].kind]}")
        return 0
    try:
        if not a.plan or a.command == "run" and not a.output:
            raise PlanError("a plan, and for run an output, are needed")
        with open(a.plan, encoding="utf-8") as f:
            plan = plans.parse(f.read())
        if a.command in ("fingerprint", "steps"):
            print(plans.fingerprint(plan) if a.command == "fingerprint" else json.dumps(plans.steps(plan), indent=1))
            return 0
        spark = SparkSession.builder.appName("tesserae").getOrCreate()
        frames = tables(spark, a.tables)
        if a.command == "validate":
            print(plans.validate(spark, plan, {k: f.schema for k, f in frames.items()}).json())
        elif a.command == "explain":
            print(plans.explain(plan, frames))
        else:
            sources.write(plans.run(plan, frames), a.output, a.format)
    except (PlanError, OSError, ValueError) as e:
        print(f"tesserae: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
