"""Session set-up and the shared folder in which long plans are cut."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Only where the setting is absent, as in tests, a folder of our own is made
    and removed again at exit.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="palimpsest-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


_written: dict[str, list[str]] = {}


def _delete(spark: SparkSession, paths: list[str]) -> int:
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def cleanup(spark: SparkSession) -> int:
    """Deletes what materialize has written in this application; returns how many
    tables.  To be called when no result of it is needed any more."""
    return _delete(spark, _written.pop(spark.sparkContext.applicationId, []))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialised within is deleted at the end: for an application that runs
    many queries, each result being collected or written inside its block."""
    held = _written.setdefault(spark.sparkContext.applicationId, [])
    before = len(held)
    try:
        yield
    finally:
        paths = held[before:]
        del held[before:]
        _delete(spark, paths)


@atexit.register
def _at_exit() -> None:
    """Tables of an application whose session still runs when the process ends."""
    spark = SparkSession.getActiveSession() if _written else None
    if spark is not None and spark.sparkContext._jsc is not None:
        try:
            cleanup(spark)
        except Exception:  # noqa: BLE001, S110
            pass


def materialize(df: DataFrame, name: str, codec: str = "zstd", partition_by: list[str] | None = None) -> DataFrame:
    """Write df once into the shared folder and go on from the written table.

    Used where a plan would otherwise run its input twice (range sampling,
    several consumers) or where rows must stay the same after an executor loss.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/palimpsest/{name}-{uuid.uuid4().hex}"
    df.write.mode("error").option("compression", codec).parquet(path, partitionBy=partition_by)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize has written (without partition_by), once nothing
    reads it any more."""
    spark = df.sparkSession
    paths = [f"{shared_dir(spark)}/palimpsest/{name}" for name in {f.rsplit("/", 2)[1] for f in df.inputFiles()}]
    held = _written.get(spark.sparkContext.applicationId, [])
    held[:] = [p for p in held if p not in paths]
    _delete(spark, paths)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What a query within shuffles is removed when it ends, not when the driver happens to
    collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """The rows over at least as many tasks as there are cores: for rows that are dear to
    treat, read from a table of fewer pieces.  A table of more pieces stays as it lies,
    and so does what comes from a shuffle, which has its own partitions."""
    if "AdaptiveSparkPlan" in df._jdf.queryExecution().executedPlan().nodeName():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def stable_id(*columns) -> F.Column:
    """A key of 64 hexadecimal digits that depends on the values alone."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
