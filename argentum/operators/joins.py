"""Joins: code families, membership, checked one-to-one attach, as-of."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import SparkRuntimeException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from argentum.functions.columns import code_prefixes
from argentum.session import stage

MICROS = 1_000_000


def join_code_family(events: DataFrame, families: DataFrame, code: str = "condition_source_value") -> DataFrame:
    """Events whose 3- or 4-character prefix equals a dictionary code.

    An OR of two equalities can only run as a nested loop. Exploding the distinct
    prefixes gives an equi-join with the same rows: a code of three characters or
    fewer has equal prefixes and must be probed once.
    """
    prefixes = F.array_distinct(F.array(*code_prefixes(code)))
    return (
        events.filter(F.col(code).isNotNull())
        .withColumn("code", F.explode(prefixes))
        .join(families, "code")
    )


def keep_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key occurs in `keys`.

    Distinct keys combine ahead of the shuffle and keep its partitioning, so a hot key
    weighs nothing on that side; on the other, the adaptive join splits it.
    """
    return df.join(keys.select(*on).distinct(), on, "left_semi")


def exclude_keys(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key does not occur in `keys`."""
    return df.join(keys.select(*on).distinct(), on, "left_anti")


def lookup(df: DataFrame, dim: DataFrame, on: str, fill: dict | None = None) -> DataFrame:
    """Left join to a dimension, with constants for the unmatched."""
    out = df.join(dim, on, "left")
    return out.na.fill(fill) if fill else out


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """`df`, whose plan raises where a key repeats: when the result is written, without a job of its own.

    The count runs in the plan beside the rows, combines ahead of the shuffle, and each key's
    rows meet its count by a join; a null key is a key like any other.
    """
    if any(c.startswith(_CHECK) for c in df.columns):
        raise ValueError(f"column names that begin with {_CHECK} are taken")
    names = [f"{_CHECK}{i}" for i in range(len(keys))]
    repeated = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.count("*").alias(f"{_CHECK}n")).filter(F.col(f"{_CHECK}n") > 1)
    same = [df[k].eqNullSafe(F.col(n)) for k, n in zip(keys, names)]
    joined = df.join(repeated, same, "left")
    fine = F.when(F.col(f"{_CHECK}n").isNull(), True).otherwise(F.raise_error(F.lit(f"{_REPEATED}: {keys}")).cast("boolean"))
    return joined.filter(fine).select(*[df[c] for c in df.columns])


_CHECK = "_unique_"
_REPEATED = "keys are not unique"


def _numbered_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """As `assert_unique`, for rows that are joined by `keys` next, to others that are unique as well.

    Rows are numbered inside their key, in the shuffle and order that the join needs anyway; the second of a
    key raises. So no key gathers rows, and there is no skew that the adaptive join could have split.
    """
    if any(c.startswith(_CHECK) for c in df.columns):
        raise ValueError(f"column names that begin with {_CHECK} are taken")
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*keys))
    fine = F.when(F.col(f"{_CHECK}row") == 1, True).otherwise(F.raise_error(F.lit(f"{_REPEATED}: {keys}")).cast("boolean"))
    return df.withColumn(f"{_CHECK}row", row).filter(fine).drop(f"{_CHECK}row")


@contextmanager
def value_errors():
    """Repeated keys that a job inside the block finds raise ValueError, like other wrong arguments."""
    try:
        yield
    except SparkRuntimeException as error:
        if _REPEATED not in str(error):
            raise
        raise ValueError(str(error)) from error


def attach(
    df: DataFrame,
    other: DataFrame,
    on: list[str],
    how: str = "inner",
    validate: str | None = None,
) -> DataFrame:
    """Equi-join with an optional cardinality check: `one_to_one` or `many_to_one`.

    The check is part of the plan: a repeated key raises when the result is written.
    """
    if validate not in (None, "one_to_one", "many_to_one"):
        raise ValueError(f"unknown check: {validate}")
    if validate == "one_to_one":
        df, other = _numbered_unique(df, on), _numbered_unique(other, on)
    elif validate:
        other = assert_unique(other, on)
    return df.join(other, on, how)


def join_spans(
    left: DataFrame,
    right: DataFrame,
    suffixes: tuple[str, str] = ("", "_right"),
    on: tuple[str, ...] = ("note_id", "text_start_char", "text_end_char"),
    validate: str | None = None,
) -> DataFrame:
    """Exact span join; columns present on both sides take the suffixes."""
    shared = (set(left.columns) & set(right.columns)) - set(on)
    rename = lambda df, suffix: df.withColumnsRenamed({c: c + suffix for c in shared if suffix})
    return attach(rename(left, suffixes[0]), rename(right, suffixes[1]), list(on), "inner", validate)


def known_points(known: DataFrame, key: str, ts: str, value: str | None) -> DataFrame:
    """One row per (key, instant); the highest value wins ties."""
    best = F.max(F.col(value)) if value else F.lit(True)
    if value:
        return known.groupBy(key, ts).agg(best.alias("_value"))
    return known.select(key, ts).distinct().withColumn("_value", best)


def asof_exact(
    probes: DataFrame, known: DataFrame, key: str, left_on: str, right_on: str, value: str | None
) -> DataFrame:
    """As-of join with zero tolerance: a left equi-join on key and instant."""
    points = known_points(known, key, right_on, value).withColumn(left_on, F.col(right_on))
    joined = probes.join(points, [key, left_on], "left")
    return joined if value is None else joined.withColumnRenamed("_value", value)


def asof(
    probes: DataFrame,
    known: DataFrame,
    key: str,
    left_on: str,
    right_on: str,
    value: str | None = None,
    direction: str = "backward",
    tolerance_seconds: float | None = None,
) -> DataFrame:
    """As-of join: per probe the nearest known instant of its key in one direction.

    Keeps every probe. Adds `right_on` and `value` (or a `_value` flag), null without a
    match. Ties on the known side go to the highest value; `nearest` prefers the earlier.

    No probe meets more than one known row, and no task holds a hot key: both sides, read
    once, collapse to one timeline of distinct (key, instant) rows. It is sorted over all
    tasks and written; a piece is what one task of the sort wrote of a key, so a busy key, or
    a busy day of it, has several. Windows run inside pieces, and one summary row per piece
    carries the neighbours across.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction: {direction}")
    if tolerance_seconds == 0:
        return asof_exact(probes, known, key, left_on, right_on, value)
    if tolerance_seconds is not None:
        return asof_band(probes, known, key, left_on, right_on, value, direction, tolerance_seconds)

    points = known.filter(F.col(right_on).isNotNull()).select(key, F.col(right_on).cast("timestamp").alias("_ts"), F.lit(True).alias("_is_known"), (F.col(value) if value else F.lit(True)).alias("_value"))
    empty = F.lit(None).cast(points.schema["_value"].dataType)
    wanted = probes.filter(F.col(left_on).isNotNull()).select(key, F.col(left_on).cast("timestamp").alias("_ts"), F.lit(False).alias("_is_known"), empty.alias("_value"))
    merged = points.unionByName(wanted).groupBy(key, "_ts").agg(F.max("_is_known").alias("_is_known"), F.max("_value").alias("_value"), F.min("_is_known").alias("_no_probe"))
    timeline = stage(merged.orderBy(key, "_ts").withColumn("_piece", F.spark_partition_id()), "timeline")

    at_known = F.when(F.col("_is_known"), F.col("_ts"))
    sides = {"backward": ["backward"], "forward": ["forward"], "nearest": ["backward", "forward"]}[direction]
    edges, carried, inside = [], [], {}
    for side in sides:
        back = side == "backward"
        edges += [(F.max if back else F.min)(at_known).alias(f"_edge_{side}"), (F.max_by if back else F.min_by)("_value", at_known).alias(f"_edge_value_{side}")]
        order = (lambda c: F.col(c).asc()) if side == "backward" else (lambda c: F.col(c).desc())
        before = Window.partitionBy(key).orderBy(order("_piece")).rowsBetween(Window.unboundedPreceding, -1)
        edge = F.when(F.col(f"_edge_{side}").isNotNull(), F.struct(F.col(f"_edge_{side}").alias("_ts"), F.col(f"_edge_value_{side}").alias("_value")))
        carried.append(F.last(edge, ignorenulls=True).over(before).alias(f"_from_{side}"))
        upto = Window.partitionBy(key, "_piece").orderBy(order("_ts")).rowsBetween(Window.unboundedPreceding, 0)
        own = F.when(F.col("_is_known"), F.struct("_ts", "_value"))
        inside[f"_in_{side}"] = F.last(own, ignorenulls=True).over(upto)
    summary = timeline.groupBy(key, "_piece").agg(*edges).select(key, "_piece", *carried)
    found = timeline.withColumns(inside).filter(~F.col("_no_probe")).join(summary, [key, "_piece"])
    found = found.withColumns({f"_{side}": F.coalesce(f"_in_{side}", f"_from_{side}") for side in sides})
    micros = lambda c: F.unix_micros(F.col(c))
    gap = lambda side: F.abs(micros(f"_{side}._ts") - micros("_ts"))
    if direction == "nearest":
        later = F.col("_backward").isNull() | (gap("forward") < gap("backward"))
        match = F.when(later & F.col("_forward").isNotNull(), F.col("_forward")).otherwise(F.col("_backward"))
    else:
        match = F.col(f"_{direction}")
    found = found.select(key, "_ts", match.alias("_match")).filter("_match is not null")
    return _join_back(probes, known, found, key, left_on, right_on, value)


def _join_back(probes: DataFrame, known: DataFrame, found: DataFrame, key: str, left_on: str, right_on: str, value: str | None) -> DataFrame:
    result = found.select(
        key,
        F.col("_ts").cast(probes.schema[left_on].dataType).alias(left_on),
        F.col("_match._ts").cast(known.schema[right_on].dataType).alias(right_on),
        F.col("_match._value").alias(value or "_value"),
    )
    return probes.join(result, [key, left_on], "left")


#: A tolerance is cut into so many cells; a key's distinct instants inside one meet in a window.
CELLS = 4


def asof_band(
    probes: DataFrame,
    known: DataFrame,
    key: str,
    left_on: str,
    right_on: str,
    value: str | None = None,
    direction: str = "backward",
    tolerance_seconds: float = 1,
) -> DataFrame:
    """As-of join within a tolerance: equi-joins on cells of time, without a global order.

    Time is cut into cells of a fraction of the tolerance. Only the distinct instants of a key
    and cell meet in a window, so neither a busy key nor a repeated instant makes a large
    group. What a probe can find beyond its own cell is the edge (last or first known instant) of a
    cell at most `CELLS` away: edges, one per key and cell, go to the cells that they can serve,
    and each cell keeps the nearest.
    """
    reach = int(tolerance_seconds * MICROS)
    width = max(1, -(-reach // CELLS))
    micros = F.unix_micros("_ts")
    cell = (micros - F.pmod(micros, F.lit(width))).alias("_cell")
    points = known.filter(F.col(right_on).isNotNull()).select(key, F.col(right_on).cast("timestamp").alias("_ts"), F.lit(True).alias("_is_known"), (F.col(value) if value else F.lit(True)).alias("_value"))
    empty = F.lit(None).cast(points.schema["_value"].dataType)
    wanted = probes.filter(F.col(left_on).isNotNull()).select(key, F.col(left_on).cast("timestamp").alias("_ts"), F.lit(False).alias("_is_known"), empty.alias("_value"))
    collapsed = lambda df: df.groupBy(key, cell, "_ts").agg(F.max("_is_known").alias("_is_known"), F.max("_value").alias("_value"), F.min("_is_known").alias("_no_probe"))
    rows = collapsed(points.unionByName(wanted))

    sides = {"backward": ["backward"], "forward": ["forward"], "nearest": ["backward", "forward"]}[direction]
    own = F.when(F.col("_is_known"), F.struct("_ts", "_value"))
    ways, edges = {}, None
    for side in sides:
        pick, step = (F.max, width) if side == "backward" else (F.min, -width)
        order = F.col("_ts").asc() if side == "backward" else F.col("_ts").desc()
        ways[f"_in_{side}"] = F.last(own, ignorenulls=True).over(Window.partitionBy(key, "_cell").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
        edge = collapsed(points).groupBy(key, "_cell").agg(pick(F.struct("_ts", "_value")).alias("_edge"))
        served = F.explode(F.array(*[F.col("_cell") + F.lit(k * step) for k in range(1, CELLS + 1)]))
        edge = edge.select(key, served.alias("_cell"), "_edge").groupBy(key, "_cell").agg(pick("_edge").alias(f"_from_{side}"))
        edges = edge if edges is None else edges.join(edge, [key, "_cell"], "full")
    found = rows.withColumns(ways).filter(~F.col("_no_probe")).join(edges, [key, "_cell"], "left")
    found = found.withColumns({f"_{side}": F.coalesce(f"_in_{side}", f"_from_{side}") for side in sides})
    gap = lambda side: F.abs(F.unix_micros(F.col(f"_{side}._ts")) - F.unix_micros("_ts"))
    if direction == "nearest":
        later = F.col("_backward").isNull() | (gap("forward") < gap("backward"))
        match = F.when(later & F.col("_forward").isNotNull(), F.col("_forward")).otherwise(F.col("_backward"))
    else:
        match = F.col(f"_{direction}")
    found = found.select(key, "_ts", match.alias("_match"))
    near = F.abs(F.unix_micros("_match._ts") - F.unix_micros("_ts")) <= reach
    return _join_back(probes, known, found.filter(near), key, left_on, right_on, value)
