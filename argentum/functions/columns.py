"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argentum.sources.fixed_values import MASK


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_prefixes(code: str | Column) -> tuple[Column, Column]:
    """First three and first four characters of a code."""
    return F.substring(col(code), 1, 3), F.substring(col(code), 1, 4)


def order_hash(*keys: str | Column, seed: int | str = 0) -> Column:
    """A reproducible pseudo-random sort key: equal on every run, partitioning and engine."""
    return F.md5(F.concat_ws(":", *[col(k).cast("string") for k in keys], F.lit(str(seed))))


def unit_interval(digest: Column) -> Column:
    """A md5 digest as a number strictly between 0 and 1 (its first 52 bits)."""
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def to_zone(df: DataFrame, zone: str = "Europe/Paris", columns: list[str] | None = None) -> DataFrame:
    """UTC timestamps as local time, for the given or all timestamp columns."""
    if columns is None:
        columns = [
            f.name
            for f in df.schema.fields
            if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))
        ]
    return df.withColumns(
        {c: F.from_utc_timestamp(F.col(c).cast("timestamp"), zone) for c in columns}
    )


def localise(ts: str | Column, zone: str | None) -> Column:
    """Read a naive local timestamp in `zone` as an instant; unchanged without a zone."""
    return F.to_utc_timestamp(col(ts), zone) if zone else col(ts)


def parse_or_drop(df: DataFrame, column: str, fmt: str | None = None) -> DataFrame:
    """Parse a column as timestamp and drop the rows that do not parse."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        parsed = F.try_to_timestamp(column, F.lit(fmt)) if fmt else F.try_to_timestamp(column)
        df = df.withColumn(column, parsed)
    elif not isinstance(kind, T.TimestampType):
        df = df.withColumn(column, F.col(column).cast("timestamp"))
    return df.dropna(subset=[column])


def replace_span(text: Column, start: Column, end: Column, new: str = MASK) -> Column:
    """`text` with the 0-based half-open range [start, end) replaced by `new`."""
    return F.overlay(text, F.lit(new), start + 1, end - start)


def mask_span(df: DataFrame, new: str = MASK) -> DataFrame:
    """Add the snippet with its mention masked, and the offsets of the mask in it."""
    start = F.col("span_start_char")
    return df.withColumns(
        {
            "masked_span": replace_span(F.col("span"), start, F.col("span_end_char"), new),
            "masked_span_start_char": start,
            "masked_span_end_char": start + F.lit(len(new)),
        }
    )


def midpoint(start: str | Column, end: str | Column) -> Column:
    return (col(start) + col(end)) / F.lit(2.0)


def replace_missing_letters(text: str | Column) -> Column:
    """Letters that the downstream vocabulary lacks."""
    return F.translate(col(text), "üö", "uo")


def decode(value: str | Column, mapping: dict, default: object = None) -> Column:
    """Look a code up in a small literal map; unmapped codes give `default`."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), col(value))
    return found if default is None else F.coalesce(found, F.lit(default))


def flag_new_case(gap_days: Column, clean_days: int) -> Column:
    """False when the previous event is within the clean period, else True (no previous included)."""
    return F.when(gap_days <= clean_days, False).otherwise(True)


def flatten_nested(df: DataFrame, column: str) -> Column:
    """All elements of an array of arrays of any depth, in order; null arrays have none."""
    kind, value = df.schema[column].dataType, F.col(column)
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        kind, value = kind.elementType, F.flatten(F.filter(value, lambda x: x.isNotNull()))
    return value
