"""What the operators of this subpackage share: the shared folder, stored tables, batches."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes in one Arrow batch, so that very long texts don't pile up in a Python worker.
BATCH_ROWS, BATCH_BYTES = 1024, 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches which Python workers get, by rows and by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


#: How to empty what a Python worker keeps between tasks (vocabularies, words), by the operator that keeps it.
KEPT: dict[str, list[Callable[[], None]]] = {}


def make_room(owner: str = "") -> None:
    """At a task's beginning: empty what other operators keep in this worker."""
    for name, clears in KEPT.items():
        for clear in clears if name != owner else ():
            clear()


def give_back() -> None:
    """Return freed memory to the system: a Python worker stays for other tasks, and would hold what its largest one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def executors_give_back(spark: SparkSession) -> None:
    """Before a stage: each executor's JVM collects its garbage and returns free heap to the system. Else it holds what the largest stage so far took, beside the Python workers of the next."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).collect()  # a task for each core, so one at least for each executor


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, one of our own, if executors are threads of the driver."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def at(spark: SparkSession, path: str):
    """The path and its file system, of the JVM."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors. It goes with the application, or by forget()."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    place, files = at(spark, path)
    files.deleteOnExit(place)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in frames:
        place, files = at(df.sparkSession, df.stored_at)
        files.delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() into the shared folder, for small frames inside loops; Spark removes it with the frame."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def vocabulary(path: str) -> str:
    """A vocabulary's file: a path as it is, a mere name where the public tokenizers are installed (on the executor that asks)."""
    if os.sep in path:
        return path
    import public_tokenizers

    return str(public_tokenizers.path(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, columns: str, function: Callable[[pa.RecordBatch], list], without: tuple[str, ...] = (), owner: str = "") -> DataFrame:
    """df plus the DDL `columns`; `function` gives their arrays (in order) for each non-empty batch of rows. Columns `without` don't come back from Python. What `owner` keeps stays.

    Columns of df that are named as one of the new ones give way to it.
    """
    bounded_batches(df.sparkSession)
    added = T.StructType.fromDDL(columns)
    new = {f.name.lower() for f in added.fields}
    kept = [k for k, f in enumerate(df.schema.fields) if f.name not in without and f.name.lower() not in new]
    schema = T.StructType([*(df.schema.fields[k] for k in kept), *added.fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room(owner)
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), *function(batch)], names)
        give_back()

    return df.mapInArrow(run, schema)


def with_results(df: DataFrame, columns: str, function: Callable[[pa.RecordBatch], list], inputs: list[str]) -> DataFrame:
    """df plus the DDL `columns`, as map_batches, but only `inputs` go to Python (in order) and only results come back: rows with long texts wait in Spark's own queue, which spills.

    Columns of df that are named as one of the new ones give way to it.
    """
    bounded_batches(df.sparkSession)
    added = T.StructType.fromDDL(columns)
    names = added.fieldNames()

    def run(rows: pa.Array) -> pa.Array:
        make_room()
        try:
            return pa.StructArray.from_arrays(function(pa.RecordBatch.from_struct_array(rows)), names)
        finally:
            give_back()

    # Nondeterministic, so that the optimiser doesn't run it again for each use of a result.
    result = F.arrow_udf(run, added).asNondeterministic()(F.struct(*(F.col(f"`{c}`") for c in inputs)))
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]
    return df.withColumn("__results", result).select(*(F.col(f"`{c}`") for c in kept), "__results.*")


def utf8(column: pa.Array) -> list[bytes]:
    """The texts' UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
