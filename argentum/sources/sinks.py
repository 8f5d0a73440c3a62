"""Sinks: every job overwrites its output as a whole."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argentum.sources.readers import MANIFEST, split_facts


def write_stage(df: DataFrame, path: str, **names: str) -> str:
    """Overwrite a stage output as parquet; `{name}` parts of the path are filled."""
    path = path.format(**names) if names else path
    df.write.mode("overwrite").parquet(path)
    return path


def write_splits(df: DataFrame, path: str, column: str = "set") -> str:
    """Named splits of one dataset; readers of one split prune the others.

    A manifest (rows, checksum and schema by split) is written last: `readers.read_splits` takes the
    dataset as a whole or refuses it.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").partitionBy(column).parquet(path)
    # as it will be read: columns may be null, the split stands last
    fields = [T.StructField(f.name, f.dataType, True) for f in df.schema if f.name != column] + [T.StructField(column, df.schema[column].dataType, True)]
    schema = T.StructType(fields)
    facts = split_facts(spark.read.schema(schema).parquet(path), column)
    named = facts.withColumns({"column": F.lit(column), "schema": F.lit(schema.json())})
    nothing = spark.createDataFrame([(None, 0, None, column, schema.json())], "split string, n_rows long, checksum string, column string, schema string")
    # one row per split; a dataset without rows still has its schema
    named.unionByName(nothing).coalesce(1).write.mode("overwrite").parquet(f"{path}/{MANIFEST}")
    return path


def write_metrics(metrics: DataFrame, path: str, **run: object) -> str:
    """Metric rows with the run parameters as csv with a header; bounded by the number of strata."""
    for name, value in run.items():
        metrics = metrics.withColumn(name, F.lit(value))
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_loss_trace(losses: DataFrame, moving: DataFrame, path: str) -> str:
    """The long loss table and the moving loss per sample, side by side under `path`."""
    losses.select("sample_id", "epoch", "loss").write.mode("overwrite").parquet(f"{path}/loss_values")
    moving.select("sample_id", "moving_loss").write.mode("overwrite").parquet(f"{path}/moving_loss")
    return path
