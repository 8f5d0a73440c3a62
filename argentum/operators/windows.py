"""First, last and previous rows per key, safe when one key holds much of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first_by(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first `n` rows of every key in the given order.

    The rank filter becomes a group limit ahead of the shuffle, so every task sends at
    most `n` rows per key and no task receives a hot key whole.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def keep_one(
    df: DataFrame,
    col_date: str = "note_datetime",
    how: str = "first",
    key: str = "person_id",
    tie_break: list[str] | None = None,
) -> DataFrame:
    """First or last row per person by date; ties go to the lowest (first) or highest (last) tie key."""
    columns = [F.col(c) for c in [col_date, *(tie_break or [])]]
    order = [c.asc() if how == "first" else c.desc() for c in columns]
    return keep_first_by(df, [key], order)


def last_non_null(
    df: DataFrame,
    key: str = "person_id",
    col_date: str = "note_datetime",
    tie_break: str = "note_id",
) -> DataFrame:
    """Per key and column, the last non-null value by date: columns may come from different rows."""
    order = F.struct(F.col(col_date), F.col(tie_break))
    latest = [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order)).alias(c)
        for c in df.columns
        if c != key
    ]
    return df.groupBy(key).agg(*latest).select(*df.columns)
