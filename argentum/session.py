"""Session settings and staged intermediate tables."""

from __future__ import annotations

import sys
import tempfile
import uuid
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Results depend on these, whatever the cluster defaults are.
PINNED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

#: Folders written in each open `staging_noted` block.
_OPEN: list[list[str]] = []

#: A side is hinted as broadcast only when it is known to hold at most this many rows.
BROADCAST_ROWS = 200_000


def pin(spark: SparkSession) -> SparkSession:
    """Pin the settings that results and plans rely on.

    Functions of the package travel to Python workers by value, so that workers need no copy
    of the package on their path.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    for key, value in PINNED.items():
        spark.conf.set(key, value)
    return spark


def get_session(app_name: str = "argentum", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or get) a session with the pinned settings; `conf` adds more."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**PINNED, **conf}.items():
        builder = builder.config(key, value)
    return pin(builder.getOrCreate())


def staging_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only on a local master."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="argentum-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Used where several passes need the same expensive rows. The written table
    cuts the lineage, survives lost executors and prunes columns per pass.
    """
    path = f"{staging_dir(df.sparkSession)}/argentum-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for written in _OPEN:
        written.append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_in = path
    return out


@contextmanager
def staging_noted():
    """The list of folders that `stage` writes inside the block."""
    written: list[str] = []
    _OPEN.append(written)
    try:
        yield written
    finally:
        _OPEN.remove(written)


def unstage(df: DataFrame) -> None:
    """Delete the table of a DataFrame that `stage` returned; whatever derives from it must be written by then."""
    remove_staged(df.sparkSession, [df.staged_in])


def remove_staged(spark: SparkSession, folders: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    for folder in folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def staged(spark: SparkSession):
    """Remove the tables that `stage` writes inside the block once it is left; results must be written by then."""
    with staging_noted() as written:
        try:
            yield
        finally:
            remove_staged(spark, written)


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """At most `max_rows` rows, found without counting further than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting; a larger side takes the shuffled join."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def spread_small(df: DataFrame) -> DataFrame:
    """Spread the rows of an input with fewer files than cores, ahead of work that is heavy per row.

    Large datasets have more files than cores and are left alone: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def literal_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """Rows written in the program as a DataFrame, broadcast when their number allows it."""
    df = spark.createDataFrame(rows, schema)
    return F.broadcast(df) if len(rows) <= BROADCAST_ROWS else df


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and use it many times inside `body`.

    The optimizer merges projections and may copy an expression into a lambda,
    where it would run once per element; binding it as a lambda variable avoids that.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
