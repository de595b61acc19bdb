"""Plans over unbounded input, by Structured Streaming.

Operations that work row by row run on a stream as they are. Aggregation over event time
takes a window and a watermark, so that state stays bounded.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import OPERATIONS
from ..plans import Plan, fold, parse
from ..relation import PlanError, col, number


def run(plan: Plan | str | dict, frames: Mapping[str, DataFrame]) -> DataFrame:
    """The plan's output as a streaming frame. Joins may have one streaming side; other operations have to be row by row."""
    p = plan if isinstance(plan, Plan) else parse(plan)
    moving = {k for k, f in frames.items() if f.isStreaming}
    for n in p.nodes:
        streams = [i for i in n.inputs if i in moving]
        if not streams:
            continue
        kind = OPERATIONS[n.op].kind
        if kind == "B" and n.op not in ("table.concat", "table.melt", "table.explode") or n.op in ("table.uuid_generator",):
            raise PlanError(f"{n.op} needs its whole input, which a stream doesn't have")
        if kind == "BB" and (len(streams) != 1 or n.inputs[0] not in moving or n.op not in ("table.join", "table.semi_join", "table.cross_join")):
            raise PlanError(f"{n.op} needs a stream on the left and a table on the right")
        moving.add(n.id)
    return fold(p, frames)


def windowed(df: DataFrame, time_column: str, window: str, watermark: str, group_by: list[str] = (), value_column: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts, and sums of a column, in tumbling or sliding windows of event time."""
    w = F.window(col(time_column), window, slide) if slide else F.window(col(time_column), window)
    outs = [F.count(F.lit(1)).alias("count")]
    if value_column:
        x = number(df, value_column)
        outs += [F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max")]
    out = df.withWatermark(time_column, watermark).groupBy(w.alias("window"), *[col(g) for g in group_by]).agg(*outs)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *[c for c in out.columns if c != "window"])


def sessions(df: DataFrame, time_column: str, gap: str, watermark: str, group_by: list[str]) -> DataFrame:
    """Event counts of sessions that a pause of gap ends."""
    s = F.session_window(col(time_column), gap)
    out = df.withWatermark(time_column, watermark).groupBy(s.alias("session"), *[col(g) for g in group_by]).agg(F.count(F.lit(1)).alias("count"))
    return out.select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *group_by, "count")


def distinct(df: DataFrame, columns: list[str], time_column: str, watermark: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return df.withWatermark(time_column, watermark).dropDuplicatesWithinWatermark(list(columns))


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
