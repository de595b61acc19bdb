"""Row order, texts of values and rejection of bad data: what all operators share.

Row order is part of the data model here, but not of a DataFrame. A frame may carry it in
the long column ORD. with_order() adds it without a shuffle; operators keep it where rows
keep their identity and make a new one where they don't.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORD = "__ord"


class PlanError(ValueError):
    """A plan or a configuration that can't be run on these schemas."""


def with_order(df: DataFrame, *by: str) -> DataFrame:
    """df with ORD: by the given columns' order if there are any, else by position in the files.

    Positions cost nothing. An order by columns is a global sort of the keys only where rank()
    is asked for; one long column that is already unique is taken as it is.
    """
    if ORD in df.columns:
        return df
    if len(by) == 1 and isinstance(df.schema[by[0]].dataType, (T.LongType, T.IntegerType)):
        return df.withColumn(ORD, F.col(q(by[0])).cast("long"))
    return df.withColumn(ORD, F.monotonically_increasing_id())


def durable(df: DataFrame) -> DataFrame:
    """df, checkpointed to the folder that driver and executors share; in one process without such a folder, to one of our own."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not context.master.startswith("local["):
                raise PlanError("set spark.checkpoint.dir to a folder that driver and executors share")
            path = tempfile.mkdtemp(prefix="tesserae-")
        context.setCheckpointDir(path)
    return df.checkpoint()


#: Plans of these nodes give rows in the same partitions and order whenever they are computed.
STABLE = re.compile(r"Project|Filter|LogicalRelation|Relation|LocalRelation|Range|SubqueryAlias|LogicalRDD|ArrowEvalPython|BatchEvalPython|CollectMetrics")


def steady(df: DataFrame) -> DataFrame:
    """with_order(df) such that a row keeps its position however often the frame is computed.

    Behind a shuffle, positions depend on the order in which blocks arrive; without an order
    column such a frame is written to the shared folder once.
    """
    if ORD in df.columns:
        return df
    nodes, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        nodes.append(node.nodeName())
        below = node.children()
        todo += [below.apply(k) for k in range(below.size())]
    return with_order(df) if all(STABLE.match(n) for n in nodes) else durable(with_order(df))


def ranges(df: DataFrame, name: str = ORD) -> tuple[Column, int]:
    """The number of the range of a numeric column that a row is in, and how many ranges there are: about as many as shuffle partitions, by quantiles.

    The edges form a balanced tree of comparisons, so a row costs the logarithm of their
    number. Equal values are in one range; null is in the last one.
    """
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.approxQuantile(name, [k / parts for k in range(1, parts)], 0.001) or []
    edges = sorted({int(x) if name == ORD else float(x) for x in found if x == x})

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(name) <= edges[middle], tree(low, middle)).otherwise(tree(middle + 1, high))

    return tree(0, len(edges)), len(edges) + 1


def data(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ORD]


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def need(df: DataFrame, *names: str) -> None:
    have = set(df.columns)
    for n in names:
        if n not in have:
            raise PlanError(f"there is no column {n!r}")


def no_repeats(names: list[str]) -> None:
    if len(set(names)) != len(names):
        raise PlanError("a column is named twice")


def new_name(name: str) -> str:
    if not name.strip() or len(name.encode()) > 1024:
        raise PlanError("an output column needs a name of at most 1024 bytes")
    return name


def kind(df: DataFrame, name: str) -> T.DataType:
    need(df, name)
    return df.schema[name].dataType


NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
FLOATS = (T.FloatType, T.DoubleType)


def is_number(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def number(df: DataFrame, name: str) -> Column:
    """A column as double; other types than numbers are an error."""
    if not is_number(kind(df, name)):
        raise PlanError(f"column {name!r} is not a number")
    return col(name).cast("double")


def to_text(df: DataFrame, name: str) -> Column:
    return text_of(col(name), kind(df, name))


def text_of(c: Column, t: T.DataType) -> Column:
    """The canonical text of a value: whole floats without a fraction, no exponents."""
    if isinstance(t, FLOATS):
        d = c.cast("double")
        plain = F.regexp_replace(d.cast("string").cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
        whole = (d == F.floor(d)) & (F.abs(d) < 9e18)
        large = F.format_string("%.0f", d)
        special = F.when(F.isnan(d), "NaN").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf")
        return F.coalesce(special, F.when(whole, F.floor(d).cast("string")).when(F.abs(d) >= 9e18, large).when(d.cast("string").contains("E") & (F.abs(d) < 1e19), plain).otherwise(d.cast("string")))
    if isinstance(t, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")
    if isinstance(t, T.TimestampNTZType):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return c.cast("string")


def literal(value: object) -> Column:
    return F.lit(value)


def refuse(bad: Column, cause: str, value: Column) -> Column:
    """value, or an error that ends the query where bad is true. It is raised where the rows are, without a pass of its own."""
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(f"rejected: {cause}"))).otherwise(value)


def demand(df: DataFrame, bad: Column, cause: str) -> DataFrame:
    """df, refused as a whole if bad holds in any row. A filter: no later pruning takes the check away."""
    return df.where(refuse(bad, cause, F.lit(True)))


def report(df: DataFrame, bad: Column, cause: str, examples: int = 10) -> dict:
    """Counts rows that would be refused, with the positions of the first ones. One pass; each task sends a count and so many positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first = 0, np.zeros(0, np.int64)
        for b in batches:
            n += b.num_rows
            first = np.sort(np.concatenate([first, b.column(0).to_numpy()]))[:examples]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([first.tolist()], pa.list_(pa.int64()))], names=["n", "first"])

    found = with_order(df).where(F.coalesce(bad, F.lit(False))).select(ORD).mapInArrow(run, "n long, first array<long>").collect()
    return {"cause": cause, "rows": sum(r.n for r in found), "examples": sorted(x for r in found for x in r["first"])[:examples]}


@dataclass(frozen=True)
class Operation:
    name: str
    run: Callable[..., DataFrame]
    inputs: int
    #: S: row by row; B: needs the whole input; BB: two inputs.
    kind: str


OPERATIONS: dict[str, Operation] = {}


def operation(name: str, kind: str = "S", inputs: int | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function of one or two frames, and its configuration as keywords, under a name."""

    def register(run: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        OPERATIONS[name] = Operation(name, run, inputs if inputs is not None else 2 if kind == "BB" else 1, kind)
        return run

    return register


def apply(name: str, *frames: DataFrame, **config: object) -> DataFrame:
    if name not in OPERATIONS:
        raise PlanError(f"there is no operation {name!r}")
    op = OPERATIONS[name]
    if op.inputs >= 0 and len(frames) != op.inputs:
        raise PlanError(f"{name} takes {op.inputs} inputs")
    import inspect

    known = inspect.signature(op.run).parameters
    for k in config:
        if k not in known:
            raise PlanError(f"{name} has no option {k!r}")
    return op.run(*frames, **config)
