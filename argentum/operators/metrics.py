"""Counts, shares and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, columns: list[str], by: list[str] | None = None, normalize: bool = False) -> DataFrame:
    """Rows per value, optionally within `by` groups and as a share of the group.

    Totals add up the counted values, never raw rows, and join the counts by group: a
    group with many values is not gathered in one task.
    """
    by = by or []
    counts = df.groupBy(*by, *columns).agg(F.count("*").alias("n"))
    if not normalize:
        return counts
    if not by:
        return counts.select(*columns, (F.col("n") / counts.agg(F.sum("n")).scalar()).alias("share"))
    totals = counts.groupBy(*by).agg(F.sum("n").alias("_total"))
    return counts.join(totals, by).select(*by, *columns, (F.col("n") / F.col("_total")).alias("share"))


def distinct_count(df: DataFrame, column: str, exact: bool = True) -> DataFrame:
    count = F.count_distinct(column) if exact else F.approx_count_distinct(column)
    return df.agg(count.alias("n_distinct"))


def all_allowed(df: DataFrame, key: str, value: str, allowed: list) -> DataFrame:
    """Keys whose every non-null value is allowed; keys with nulls only drop out."""
    return (
        df.groupBy(key)
        .agg(F.bool_and(F.col(value).isin(allowed)).alias("_ok"))
        .filter("_ok")
        .select(key)
    )


def error_counts(df: DataFrame, predicted: Column, gold: Column) -> DataFrame:
    """False positives and negatives, with their rates among predicted positives and negatives."""
    counted = df.agg(
        F.count_if(predicted & ~gold).alias("n_false_positive"),
        F.count_if(~predicted & gold).alias("n_false_negative"),
        F.count_if(predicted).alias("n_positive"),
        F.count_if(~predicted).alias("n_negative"),
    )
    return counted.withColumns(
        {
            "false_positive_rate": F.try_divide("n_false_positive", "n_positive"),
            "false_negative_rate": F.try_divide("n_false_negative", "n_negative"),
        }
    )


def binary_scores(df: DataFrame, predicted: str = "prediction", gold: str = "label", by: list[str] | None = None) -> DataFrame:
    """Precision, recall and F1 of class 1, per stratum; 0 where undefined."""
    called, wanted = F.col(predicted) == 1, F.col(gold) == 1
    counted = df.groupBy(*(by or [])).agg(
        F.count_if(called & wanted).alias("tp"),
        F.count_if(called & ~wanted).alias("fp"),
        F.count_if(~called & wanted).alias("fn"),
    )
    ratio = lambda top, bottom: F.coalesce(F.try_divide(top, bottom), F.lit(0.0))
    return counted.withColumns(
        {
            "precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")),
            "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")),
            "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
        }
    )
