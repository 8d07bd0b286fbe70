"""Cutting lineage with written tables in the folder that all executors share."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_OWN: dict[str, str] = {}
_SHIPPED: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a folder of our own if all runs on one machine, else an error: executors would not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-stage-")
    return _OWN[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: a lost executor costs no recomputation past this point."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that `staged` wrote, once all that is made from them is written."""
    for df in tables:
        context = df.sparkSession.sparkContext
        own = f"{shared_folder(df.sparkSession)}/"
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if own.split("://")[-1].lstrip("/") in folder:
                path = context._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within: a query's shuffle files go at its end, not when the driver happens to collect garbage.

    For steps whose results are staged: no later query reads their shuffles again.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def counted(df: DataFrame, name: str, what: Column | None = None) -> tuple[DataFrame, int]:
    """`staged`, and how many rows were written (for which `what` holds): counted while writing, without a job of its own."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = staged(df.observe(seen, (F.count(F.lit(1)) if what is None else F.count_if(what)).alias("n")), name)
    return out, seen.get.get("n", 0)


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """`df` marked for broadcast if its counted rows are no more than `max_rows`, else as it is."""
    return F.broadcast(df) if df.count() <= max_rows else df


def hash_sample(df: DataFrame, key: str, n: int, most: int) -> DataFrame:
    """Of the `n` rows of `df`, those with the lowest hashes of `key`: all if `n` <= `most`, else somewhat fewer than `most`.

    A plain filter: no sort, and nothing comes together anywhere. Aimed at 19 / 20 of `most`, so that chance does not pass it.
    """
    if n <= most:
        return df
    steps = 1 << 30
    return df.where(F.pmod(F.xxhash64(key), F.lit(steps)) < int(most * 0.95 / n * steps))


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The schema of `df` with one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])


def map_arrow(df: DataFrame, task: Callable, schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow, with this package sent to the executors once, so that tasks find it wherever they run."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent.parent
        _SHIPPED[sc.applicationId] = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-ship-')}/{package.name}", "zip", package.parent, package.name)
        sc.addPyFile(_SHIPPED[sc.applicationId])
    return df.mapInArrow(task, schema)
