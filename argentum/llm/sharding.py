"""Shards of near-equal bytes by histogram sort.

Documents are ordered by (hash of the text, hash of the id, a row number that only separates
repeated ids). Splitters between shards are found without sorting: in each round, every
partition counts exact bytes and rows below all candidate boundaries (probes), the sums go to
the driver (a fixed number of probes per splitter), and the interval of every splitter shrinks
to the two probes around its target. It ends when each splitter is within the tolerance or its
interval holds one row. Then the rows are exchanged once.

Equal texts follow one another in the order, so a group of copies shares a shard unless a
splitter has to cut through it. Null texts count as empty. Repeated rows are placed one by one.
An empty table gives no row. Extra columns are written by `write_shards`, but for those named
shard or slot.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from argentum.session import stage

SHARDS = 40
OVERHEAD = 16
#: Probes per open splitter and round.
PROBES = 15
#: Bytes that a splitter may be off, as a share of a shard.
TOLERANCE = 0.0005
#: Rows of one piece of a shard, which is what a task sorts.
PIECE_ROWS = 500_000

#: A boundary is an integer of three 64-bit digits: the keys below it go to the left.
DIGIT = 1 << 64
LOWEST, HIGHEST = 0, DIGIT**3


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """Key, size, text_crc32 and the three parts of the order, staged once so that they don't change; with the whole row on demand."""
    body = F.coalesce(F.col(text), F.lit(""))
    return stage(
        docs.select(
            F.col(key),
            (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            F.xxhash64(body).alias("k0"),
            F.xxhash64(F.col(key)).alias("k1"),
            F.monotonically_increasing_id().alias("k2"),
            *([F.struct(*[docs[c] for c in docs.columns]).alias("row")] if whole else []),
        ),
        "keyed",
    )


def _unsigned(x: np.ndarray) -> np.ndarray:
    """Signed order as unsigned order."""
    return x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)


def _digits(boundaries: list[int]) -> list[np.ndarray]:
    return [np.array([b // DIGIT**k % DIGIT for b in boundaries], np.uint64) for k in (2, 1, 0)]


def below(keys: list[np.ndarray], boundaries: list[int]) -> np.ndarray:
    """For each row, how many of the sorted boundaries are at or below its key."""
    probes = _digits(boundaries)
    place = np.searchsorted(probes[0], keys[0], side="left")
    to = np.searchsorted(probes[0], keys[0], side="right")
    tied = np.flatnonzero(to > place)  # the first part equals that of a boundary: compare whole keys
    if len(tied):
        n, m = len(tied), len(boundaries)
        rows = [np.concatenate([p, k[tied]]) for p, k in zip(probes, keys, strict=True)]
        order = np.lexsort((np.r_[np.zeros(m), np.ones(n)], rows[2], rows[1], rows[0]))
        seen, mine = np.cumsum(order < m), order >= m
        place[tied[order[mine] - m]] = seen[mine]
    return place


def _counts(rows: DataFrame, boundaries: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows below each of the sorted boundaries."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, n = np.zeros(len(boundaries) + 1, np.int64), np.zeros(len(boundaries) + 1, np.int64)
        for batch in batches:
            k = [_unsigned(batch.column(i).to_numpy()) for i in (1, 2, 3)]
            place = below(k, boundaries)
            np.add.at(size, place, batch.column(0).to_numpy())
            n += np.bincount(place, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(size[at]), pa.array(n[at])], names=["place", "size", "n"])

    parts = rows.select("size", "k0", "k1", "k2").mapInArrow(count, "place long, size long, n long")
    size, n = np.zeros(len(boundaries) + 1, np.int64), np.zeros(len(boundaries) + 1, np.int64)
    for row in parts.groupBy("place").agg(F.sum("size").alias("size"), F.sum("n").alias("n")).collect():  # one row per probe
        size[row["place"]], n[row["place"]] = row["size"], row["n"]
    return np.cumsum(size)[:-1], np.cumsum(n)[:-1]


def splitters(rows: DataFrame, shares: list[float], tolerances: list[float]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Boundaries with about shares[i] of all bytes below them, and the exact bytes and rows below each.

    `tolerances` are in bytes. A boundary whose interval can't shrink any more (one row) stays as near as a whole row allows.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size"), F.count("*").alias("n")).first()
    goals = [s * total["size"] for s in shares]
    low, high = [LOWEST] * len(goals), [HIGHEST] * len(goals)
    at_low, at_high = [(0, 0)] * len(goals), [(total["size"], total["n"])] * len(goals)
    while True:
        live = [i for i in range(len(goals)) if at_high[i][1] - at_low[i][1] > 1 and high[i] - low[i] > 1 and min(abs(goals[i] - at_low[i][0]), abs(at_high[i][0] - goals[i])) > tolerances[i]]
        if not live:
            break
        probes = set()
        for i in live:
            # half of the probes close around the interpolated place, the others evenly over the interval
            span = high[i] - low[i]
            share = (goals[i] - at_low[i][0]) / (at_high[i][0] - at_low[i][0])
            middle = low[i] + int(span * min(max(share, 0.0), 1.0))
            near = max(span // int(max(4, 2 * (at_high[i][1] - at_low[i][1]) ** 0.5)), 1)
            probes |= {low[i] + span * k // (PROBES // 2 + 1) for k in range(1, PROBES // 2 + 1)}
            probes |= {middle + near * k // (PROBES // 4) for k in range(-(PROBES // 4), PROBES // 4 + 1)}
        tried = sorted(p for p in probes if LOWEST < p < HIGHEST)
        size, n = _counts(rows, tried)
        for i in live:
            inside = range(bisect_right(tried, low[i]), bisect_left(tried, high[i]))
            cut = inside.start + int(np.searchsorted(size[inside.start : inside.stop], goals[i], side="right"))
            if cut > inside.start:
                low[i], at_low[i] = tried[cut - 1], (int(size[cut - 1]), int(n[cut - 1]))
            if cut < inside.stop:
                high[i], at_high[i] = tried[cut], (int(size[cut]), int(n[cut]))
    ends = [(low[i], *at_low[i]) if goals[i] - at_low[i][0] <= at_high[i][0] - goals[i] else (high[i], *at_high[i]) for i in range(len(goals))]
    ends = list(accumulate(ends, max))  # in order, also where shards are empty
    return [min(x[0], HIGHEST - 1) for x in ends], np.array([x[1] for x in ends], np.int64), np.array([x[2] for x in ends], np.int64)


def shard(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", tolerance: float = TOLERANCE, piece_rows: int = PIECE_ROWS, whole: bool = False) -> DataFrame:
    """Key, size, text_crc32, law ('bytes'), shard (int) and slot (gapless from 0 in each shard).

    A shard is cut into pieces of about `piece_rows` rows by more splitters of the same kind.
    One exchange brings the rows of a piece together, and a slot is the rank in the piece plus
    the rows of the shard's earlier pieces, which the histograms have counted.
    """
    rows = keyed(docs, key, text, whole)
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    per = max(1, -(-total["n"] // (shards * piece_rows)))
    shares = [k / (shards * per) for k in range(1, shards * per)]
    one = total["size"] / shards
    tolerances = [tolerance * one if k % per == 0 else 0.1 * one / per for k in range(1, shards * per)]  # only shards have to be exact
    bounds, _, rows_below = splitters(rows, shares, tolerances)
    starts = np.append(0, rows_below)
    first = starts[::per].repeat(per)  # rows below the shard's first boundary

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = [_unsigned(batch.column(batch.schema.get_field_index(x)).to_numpy()) for x in ("k0", "k1", "k2")]
            at = below(k, bounds) if bounds else np.zeros(batch.num_rows, np.int64)
            made = pa.Table.from_batches([batch]).append_column("piece", pa.array(at.astype(np.int32))).append_column("ahead", pa.array((starts - first)[at]))
            yield from made.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = rows.mapInArrow(place, f"{schema}, piece int, ahead long")
    in_piece = F.row_number().over(Window.partitionBy("piece").orderBy("k0", "k1", "k2")) - 1
    return placed.select(
        key,
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.floor(F.col("piece") / per).cast("int").alias("shard"),
        (in_piece + F.col("ahead")).cast("long").alias("slot"),
        *(["row"] if whole else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> None:
    """Write whole documents as parquet folders `shard=<n>`, rows with their slot."""
    placed = shard(docs, shards, key, text, whole=True)
    rest = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")]
    placed.select("shard", "slot", *rest).write.partitionBy("shard").parquet(path)
