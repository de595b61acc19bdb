"""What the operators of this subpackage share: reading, the shared folder, Arrow helpers."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whole texts in an Arrow batch.
BATCH_ROWS = 2_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only where none is set and all run in one process (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage durably. rows: of an Arrow batch meanwhile."""
    path = shared_path(df.sparkSession, name)
    with small_batches(df.sparkSession, rows):
        df.write.parquet(path)
    give_back(df.sparkSession)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def give_back(spark: SparkSession, share: float = 0.5) -> str:
    """Returns what the driver's JVM has freed to the system; what it says of it, nothing where it can't.

    The C library keeps what the hundreds of threads that plan and run stages have freed. The
    heap, which otherwise grows to its limit, is collected where it takes more than share of that.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for k, x in enumerate(values):
            out[k] = x
        return out

    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() > share * runtime.maxMemory():
        jvm.java.lang.System.gc()
    try:
        named = jvm.java.lang.Class.forName
        kinds = [named(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        # the server's own class isn't open to py4j
        invoke = named("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *kinds))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        arguments = name, "systemTrimNativeHeap", array(jvm.java.lang.Object), array(jvm.java.lang.String)
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, *arguments))
    except Py4JError:  # not HotSpot on Linux, or before 17.0.9
        return ""


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Holds Arrow batches down to so many rows in what is run meanwhile."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if int(before) <= 0 or int(before) > rows:
        spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spend(*frames: DataFrame) -> None:
    """Deletes the folders of stored() frames that nothing unevaluated reads any more."""
    for df in frames:
        forget(df.sparkSession, df.stored_at)


def forget(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def file_system(uri: str):
    """A pyarrow file system and path for a shared folder, usable on driver and executors."""
    from pyarrow import fs

    if "://" not in uri and uri.startswith("file:"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else "file://" + os.path.abspath(uri))


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The texts of a column, null as empty."""
    return ["" if t is None else t for t in column.to_pylist()]


def append_columns(
    df: DataFrame, fields: list[tuple[str, str, pa.DataType]], make: Callable[[pa.RecordBatch], list[pa.Array]], keep: list[str] | None = None
) -> DataFrame:
    """df's columns (or those in keep) and new ones that make() computes from each Arrow batch.

    fields: name, Spark type and Arrow type of each new column. A new column replaces one
    of its name in df. Columns that make() needs have to be in df, kept or not.
    """
    new = {name for name, _, _ in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    schema = df.select(*[F.col(f"`{c}`") for c in kept]).schema
    for name, kind, _ in fields:
        schema = schema.add(name, kind)
    names = [*kept, *[n for n, _, _ in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            made = [a.cast(t) if a.type != t else a for a, (_, _, t) in zip(make(b), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in kept], *made], names=names)

    return df.mapInArrow(run, schema)
