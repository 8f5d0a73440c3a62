"""Global order without a single-task sort: dense row ids, lowest-n cuts, exact percentiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from argentum.session import broadcast_if_small, stage

#: Up to this many rows, `limit` after a sort is a cheap per-task top-n.
SMALL_N = 1_000
_ROW_BITS = 33


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Dense 0-based position of every row in a total order.

    A range-partitioned sort spreads the rows (put unique keys last in `order`, so that
    equal values split too). The sorted table is written once with its (partition, row)
    number; positions then need only the row count of each partition, at most one row per
    shuffle partition, which is what gets broadcast.
    """
    sorted_rows = stage(df.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_pos", _ROW_BITS)
    sizes = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    row = F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        sorted_rows.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + row)
        .drop("_part", "_pos", "_before")
    )


def dense_id(df: DataFrame, order: list[Column], name: str = "text_id") -> DataFrame:
    """Row ids 0..n-1 as the first column."""
    ranked = global_rank(df, order, name)
    return ranked.select(name, *[c for c in ranked.columns if c != name])


def cut_at(ranked: DataFrame, positions: list[int], names: list[str]) -> dict[int, Column]:
    """The sort keys at a few positions of a ranked table, as one literal tuple each."""
    rows = ranked.filter(F.col("_rank").isin(positions)).select("_rank", *names).collect()
    typed = lambda r, c: F.lit(r[c]).cast(ranked.schema[c].dataType).alias(c)
    return {r["_rank"]: F.struct(*[typed(r, c) for c in names]) for r in rows}


def key_names(order: list[Column]) -> list[str]:
    return [f"_key{i}" for i in range(len(order))]


def not_above(order: list[Column], cut: Column) -> Column:
    """Rows whose sort keys, compared as one tuple, are at most `cut`."""
    return F.struct(*[c.alias(name) for c, name in zip(order, key_names(order))]) <= cut


def _cut_of(keys: DataFrame, names: list[str], n: int) -> tuple[Column | None, bool]:
    """Sort keys at position n - 1 (None with fewer rows), and whether position n has the same."""
    if n <= SMALL_N:
        rows = keys.orderBy(*names).limit(n + 1).collect()  # narrow rows, few of them
        at = {k: tuple(rows[k]) for k in (n - 1, n) if k < len(rows)}
        typed = [F.lit(v).cast(keys.schema[c].dataType).alias(c) for c, v in zip(names, at.get(n - 1, ()))]
        return (F.struct(*typed) if typed else None), n in at and at[n] == at[n - 1]
    ranked = global_rank(keys, [F.col(name) for name in names], "_rank")
    cuts = cut_at(ranked, [n - 1, n], names)
    if n - 1 not in cuts:
        return None, False
    tied = n in cuts and not ranked.filter((F.col("_rank") == n) & (F.struct(*names) == cuts[n - 1])).isEmpty()
    return cuts[n - 1], tied


def take_lowest(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Exactly the `n` lowest rows in ascending order (fewer when there are fewer rows), whatever `n` is.

    Only the sort keys are ranked; the key at position n - 1 then becomes a filter, so the
    rows themselves, often wide with text, are neither sorted nor moved. Of rows that tie with
    that key in all of `order`, as many stay as are needed, in the order of the written rows.
    """
    if n <= 0:
        return df.limit(0)
    names = key_names(order)
    keys = df.select(*[c.alias(name) for c, name in zip(order, names)])
    cut, tied = _cut_of(keys, names, n)
    if cut is None:
        return df
    if not tied:
        return df.filter(not_above(order, cut))
    own = F.struct(*[c.alias(name) for c, name in zip(order, names)])
    needed = n - df.filter(own < cut).count()
    ties = stage(df.filter(own == cut).withColumn("_row", F.monotonically_increasing_id()), "ties")
    last = take_lowest(ties.select("_row"), [F.col("_row")], needed).agg(F.max("_row")).scalar()
    return df.filter(own < cut).unionByName(ties.filter(F.col("_row") <= last).drop("_row"))


#: Digits of a sort key that one pass counts by, and groups of a key's part that may be counted whole.
_DIGITS, _WHOLE = 3, 4_096


def select_cuts(narrow: DataFrame, group: str, digits: str, need: DataFrame) -> DataFrame:
    """Per group the sort key at position `need` (from 1): (group, cut, left, same), without a sort.

    Sort keys are hexadecimal strings of one length. Each pass counts the rows of every group
    by the next digits of the keys that begin as its cut does, which combines ahead of the
    shuffle, and so finds more digits of the cut; once few rows are left the whole keys are counted.
    `same` rows have the cut as their key, of which the first `left` are within `need`; more than
    `same` are left where the group is smaller than its need.
    """
    state = stage(need.select(group, F.lit("").alias("_prefix"), "need"), "cuts")
    size, depth = narrow.agg(F.max(F.length(digits))).first()[0], 0
    if size is None:
        return state.select(group, F.col("_prefix").alias("cut"), F.col("need").alias("left"), F.lit(0).cast("long").alias("same")).limit(0)
    most = None
    while depth < size:
        depth = size if most is not None and most <= _WHOLE else min(size, depth + _DIGITS)
        near = narrow.join(broadcast_if_small(state), group).filter(F.col(digits).startswith(F.col("_prefix")))
        counts = near.groupBy(group, "need", F.substring(digits, 1, depth).alias("bin")).agg(F.count("*").alias("n"))
        bins = counts.groupBy(group, "need").agg(F.array_sort(F.collect_list(F.struct("bin", "n"))).alias("bins"))

        def fold(acc, x):
            reached = acc["below"] + acc["n"] >= F.col("need")
            below = F.when(reached, acc["below"]).otherwise(acc["below"] + acc["n"])
            return F.struct(below.alias("below"), F.when(reached, acc["bin"]).otherwise(x["bin"]).alias("bin"), F.when(reached, acc["n"]).otherwise(x["n"]).alias("n"))

        zero = F.struct(F.lit(0).cast("long").alias("below"), F.lit("").alias("bin"), F.lit(0).cast("long").alias("n"))
        state = stage(bins.select(group, "need", F.aggregate("bins", zero, fold).alias("x")).select(group, F.col("x.bin").alias("_prefix"), (F.col("need") - F.col("x.below")).alias("need"), F.col("x.n").alias("same")), "cuts")
        most = state.agg(F.max("same")).first()[0]
    return state.select(group, F.col("_prefix").alias("cut"), F.col("need").alias("left"), "same")


def keep_first(df: DataFrame, group: Column, digits: Column, need: DataFrame) -> DataFrame:
    """The first rows of every group that `need` (_group, need) names; rows of other groups all stay.

    Rows are neither sorted nor moved: the cut of a group is a filter. Of rows with the cut as their key as
    many stay as fit, in the order of the written rows.
    """
    narrow = stage(df.select(group.alias("_group"), digits.alias("_digits")).join(broadcast_if_small(need.select("_group")), "_group", "left_semi"), "keys")
    cuts = broadcast_if_small(stage(select_cuts(narrow, "_group", "_digits", need), "cuts"))
    joined = df.withColumns({"_group": group, "_digits": digits}).join(cuts, "_group", "left")
    sure = F.col("cut").isNull() | (F.col("_digits") < F.col("cut")) | ((F.col("_digits") == F.col("cut")) & (F.col("left") >= F.col("same")))
    tied = (F.col("_digits") == F.col("cut")) & (F.col("left") < F.col("same"))
    kept = joined.filter(sure).select(*df.columns)
    short = cuts.filter(F.col("left") < F.col("same"))
    if short.isEmpty():
        return kept
    row = F.lpad(F.hex("_row"), 16, "0")
    ties = stage(joined.filter(tied).select(*df.columns, "_group").withColumn("_row", F.monotonically_increasing_id()), "ties")
    last = select_cuts(ties.select("_group", row.alias("_digits")), "_group", "_digits", short.select("_group", F.col("left").alias("need")))
    first = ties.join(broadcast_if_small(last), "_group").filter(row <= F.col("cut")).select(*df.columns)
    return kept.unionByName(first)


#: Parts that one pass cuts an interval of values into.
_PARTS = 1_024


def order_statistics(values: DataFrame, column: str, positions: list[int]) -> dict[int, float]:
    """The values at positions (from 0) of the order of a double column, without a sort.

    Each pass counts the values of the open intervals in equal parts, with the least and greatest
    value of each part; the part that holds a position is its next interval, until it holds
    one value. Infinite values and NaN, greatest of all, have parts of their own.
    """
    v = F.col(column)
    finite = ~F.isnan(v) & (F.abs(v) != float("inf"))
    edge = values.agg(F.min(F.when(finite, v)).alias("low"), F.max(F.when(finite, v)).alias("high")).first()
    low, high = (edge["low"], edge["high"]) if edge["low"] is not None else (0.0, 0.0)
    found: dict[int, float] = {}
    # interval: (rows below it, positions in it)
    open_: dict[tuple[float, float], tuple[int, list[int]]] = {(low, high): (0, sorted(set(positions)))}
    whole = True
    while open_:
        bounds = list(open_)
        parts = []
        for k, (a, b) in enumerate(bounds):
            width = b / 2 - a / 2
            share = (v / 2 - a / 2) / F.lit(width) if width > 0 else F.when(v == a, 0.0).otherwise(1.0)
            inside = F.least(F.floor(share * _PARTS), F.lit(_PARTS - 1)).cast("int")
            part = F.when(finite & (v >= a) & (v <= b), inside)
            if whole:
                part = F.when(F.isnan(v), _PARTS + 1).when(v == float("inf"), _PARTS).when(v == float("-inf"), -1).otherwise(part)
            parts.append(F.struct(F.lit(k).alias("k"), part.alias("part")))
        rows = values.select(v.alias("v"), F.explode(F.filter(F.array(*parts), lambda x: x["part"].isNotNull())).alias("x"))
        counted = rows.groupBy("x.k", "x.part").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("k", "part").collect()
        following: dict[tuple[float, float], tuple[int, list[int]]] = {}
        for k, bound in enumerate(bounds):
            below, wanted = open_[bound]
            for r in (r for r in counted if r["k"] == k):
                mine = [p for p in wanted if below <= p < below + r["n"]]
                if mine and (r["low"] == r["high"] or r["part"] > _PARTS - 1 or r["part"] < 0):
                    found |= {p: r["low"] for p in mine}
                elif mine:
                    following[r["low"], r["high"]] = (below, mine)
                below += r["n"]
        open_, whole = following, False
    return found


def percentiles(df: DataFrame, column: str, shares: list[float], key: str | None = None) -> list[float]:
    """Exact percentiles with linear interpolation, from order statistics found by counting.

    Only counts of parts of the value range reach the driver. `key` is not needed any more.
    """
    values = stage(df.select(F.col(column).cast("double").alias("_value")).filter(F.col(column).isNotNull()), "values")
    n = values.count()
    if n == 0:
        return []
    positions = [share * (n - 1) for share in shares]
    at = order_statistics(values, "_value", sorted({f(p) for p in positions for f in (math.floor, math.ceil)}))
    low, high = [at[math.floor(p)] for p in positions], [at[math.ceil(p)] for p in positions]
    return [a + (b - a) * (p - math.floor(p)) if a != b else a for a, b, p in zip(low, high, positions)]


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """Index j with bounds[j] <= value < bounds[j+1]; null outside, so the maximum has no bucket."""
    below = F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= value))
    return F.when((below >= 1) & (value < F.lit(float(bounds[-1]))), below - 1)
