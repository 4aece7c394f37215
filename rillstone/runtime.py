"""Session helpers that every part of the library shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_ADAPTIVE = "spark.sql.adaptive.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that checkpoints go to.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Only where
    that setting is missing on a local master, as in tests, a temporary folder
    is used: a cluster's machines don't share theirs, so there it is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rillstone-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


#: Folders that this process asked for and that are still there.
_made: list[str] = []


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new name beside the checkpoints, which all executors can reach; `remove` or `cleanup` ends it."""
    _made.append(f"{ensure_checkpoint_dir(spark)}/{kind}-{uuid.uuid4().hex}")
    return _made[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that `work_folder` named, or one below it."""
    if not any(path == made or path.startswith(f"{made}/") for made in _made):
        raise ValueError(f"{path} wasn't made here")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _made:
        _made.remove(path)


def cleanup(spark: SparkSession) -> int:
    """Deletes all folders that are still there; results that read from them end with them. How many there were."""
    left = list(_made)
    for path in left:
        remove(spark, path)
    return len(left)


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there.

    The files outlive any executor, so a lost one costs a reread, not a rerun.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return _bounded(df.checkpoint(eager=True))


def _bounded(written: DataFrame) -> DataFrame:
    """A checkpoint whose estimated size is bounded.

    Spark carries the estimate of the plan that was written on to the
    checkpoint, and a join's is the product of its sides'. Where rounds read
    what rounds before wrote, its digits double each round until they fill the
    driver. Such a checkpoint is given Spark's default for rows of no known
    size, and stays dealt and sorted as it was.
    """
    spark = written.sparkSession
    plan = written._jdf.queryExecution().analyzed()
    if plan.stats().sizeInBytes() < 1 << 63:
        return written
    sql, none = spark._jvm.org.apache.spark.sql, spark._jvm.scala.Option.empty()
    plain = sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, spark._jsparkSession, none, none)
    return DataFrame(sql.classic.Dataset.ofRows(spark._jsparkSession, plain), spark)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """`cut`, and the number of rows, counted while they are written."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return out, seen.get["rows"]


@contextmanager
def adaptive(spark: SparkSession, on: bool) -> Iterator[None]:
    """Plans made inside are adaptive, or not.

    Without, rows that were dealt by a key stay known as such when they are
    written, and a later join or aggregate by that key doesn't move them.
    """
    before = spark.conf.get(_ADAPTIVE)
    spark.conf.set(_ADAPTIVE, str(on).lower())
    try:
        yield
    finally:
        spark.conf.set(_ADAPTIVE, before)


@contextmanager
def narrow(spark: SparkSession, on: bool = True) -> Iterator[None]:
    """Where `on`, shuffles inside have two partitions a core at most."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    if on:
        spark.conf.set("spark.sql.shuffle.partitions", str(min(int(before), 2 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def row_key(*columns: str):
    """A key for rows that may repeat or hold nulls: equal rows get equal keys."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
