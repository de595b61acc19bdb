"""Reading and writing tables: Parquet and what Spark reads, and Arrow IPC files and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from ..relation import ORD, PlanError

FORMATS = {"parquet", "orc", "json", "csv", "avro"}


def read(spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | None = None, **options: str) -> DataFrame:
    if format in ("arrow", "ipc"):
        return read_ipc(spark, path)
    if format not in FORMATS:
        raise PlanError(f"there is no format {format!r}")
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", partition_by: list[str] = ()) -> None:
    """Publishes a table once: an existing path is an error, and what a failed job wrote is not seen."""
    out = df.drop(ORD)
    if format in ("arrow", "ipc"):
        write_ipc(out, path)
        return
    if format not in FORMATS:
        raise PlanError(f"there is no format {format!r}")
    w = out.write.format(format).mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).save(path)


def opened(raw: bytes):
    """An IPC file, or else a stream."""
    if raw[:6] == b"ARROW1":
        reader = pa.ipc.open_file(pa.BufferReader(raw))
        return reader.schema, (reader.get_batch(k) for k in range(reader.num_record_batches))
    reader = pa.ipc.open_stream(pa.BufferReader(raw))
    return reader.schema, iter(reader)


def plain(t: pa.DataType) -> pa.DataType:
    """The type a column gets: dictionaries as text, wide and narrow numbers as one kind each, milliseconds as microseconds."""
    if pa.types.is_dictionary(t) or pa.types.is_large_string(t):
        return pa.string()
    if pa.types.is_uint64(t):
        return pa.decimal128(20, 0)
    if pa.types.is_integer(t):
        return pa.int64()
    if pa.types.is_float16(t) or pa.types.is_float32(t):
        return pa.float64()
    if pa.types.is_timestamp(t):
        return pa.timestamp("us", t.tz)
    if pa.types.is_map(t) or pa.types.is_interval(t) or pa.types.is_time(t):
        raise PlanError(f"type {t} is not supported")
    return t


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files of a path or folder. Each file is one task's; the driver sees the first one's schema only."""
    files = spark.read.format("binaryFile").load(path)
    first = files.orderBy("path").limit(1).select("content").collect()
    if not first:
        raise PlanError(f"nothing to read at {path!r}")
    schema = pa.schema([pa.field(f.name, plain(f.type), f.nullable) for f in opened(bytes(first[0][0]))[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column(0).to_pylist():
                for batch in opened(raw)[1]:
                    yield pa.RecordBatch.from_arrays([batch.column(f.name).cast(f.type) for f in schema], schema=schema)

    return files.select("content").mapInArrow(run, from_arrow_schema(schema, prefer_timestamp_ntz=True))


def write_ipc(df: DataFrame, path: str) -> None:
    """A folder of Arrow IPC files, one for each task, written under another name and renamed when all are there."""
    from pyarrow import fs

    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(p):
        raise PlanError(f"{path!r} is already there")
    uri = store.makeQualified(p).toString()
    uri = uri if "://" in uri else uri.replace("file:", "file://")
    hidden = uri.rstrip("/") + ".writing"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        files, base = fs.FileSystem.from_uri(hidden)
        files.create_dir(base, recursive=True)
        name, own, rows, out, writer = f"part-{context.partitionId():06d}.arrow", None, 0, None, None
        for b in batches:
            if writer is None:
                own = f"{base}/_{name}-{context.taskAttemptId()}"
                out = files.open_output_stream(own)
                writer = pa.ipc.new_file(out, b.schema)
            writer.write_batch(b)
            rows += b.num_rows
        if writer is not None:
            writer.close()
            out.close()
            files.move(own, f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"rows": pa.array([rows], pa.int64())})

    df.mapInArrow(run, "rows long").agg(F.sum("rows")).collect()
    hidden_path = spark._jvm.org.apache.hadoop.fs.Path(hidden)
    if store.exists(hidden_path):
        store.rename(hidden_path, p)
    else:
        store.mkdirs(p)
