"""Small helpers that the operators share: column naming, Arrow batches, shared scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled together in a Python worker; long texts make memory, so slices stay small.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name that df does not use yet (Spark compares names without case)."""
    used = {c.lower() for c in df.columns}
    name = base
    while name.lower() in used:
        name = f"{name}_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names: extra or clashing columns cannot interfere."""
    return df.select(*[F.col(quoted(old)).alias(new) for new, old in columns.items()])


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_slices(df: DataFrame, fn: Callable[[dict[str, list]], dict[str, list]], schema: str, arrow: pa.Schema) -> DataFrame:
    """mapInArrow where fn sees a dict of Python lists and returns one."""

    def run(batches):
        for part in sliced(batches):
            out = fn({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


#: Folders that this process has made below the shared one.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is missing, one machine (a local master, as in tests) uses and sets a folder in the warehouse; on
    a cluster no folder can be trusted to be shared, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    _made.append(f"{root.rstrip('/')}/wayfarer-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: lineage ends, lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch(spark: SparkSession):
    """Removes at its end the folders that operators make inside.  What is lazy has to be written elsewhere before."""
    start = len(_made)
    try:
        yield
    finally:
        for path in _made[start:]:
            remove(spark, path)
        del _made[start:]


def joined_evenly(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of rows with groups (a written table, one row per key, rows of the key in column size).

    Keys that hold a thousandth of all rows or more are at most a thousand: these groups are broadcast, so a hot key is
    joined where its rows lie.  The other keys are joined by shuffle.
    """
    hot = groups.where(F.col(size) * 1000 >= total)
    cold = groups.where(F.col(size) * 1000 < total)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold.hint("merge"), key))
