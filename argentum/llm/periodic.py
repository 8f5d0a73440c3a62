"""Periodic runs of words: stretches that repeat one phrase four times or more.

A dictionary of basic factors names, level by level, all factors of 1, 2, 4, ... words; a factor
of twice the length is the pair of its halves' names. At the level of length b, the next place
of the same factor at most 2 b words on gives every place a step. Places from which three
occurrences follow one another at equal steps form arithmetic progressions: they propose that step as a
period. A proposal is extended to both sides while words one period apart are equal; what is
long enough is a run, and runs that several levels propose are one.

Why the proposals are complete: let a run have the smallest period q, and let b be the power of two with
q <= b < 2 q. Within the run a factor of q words or more recurs at multiples of q only, so its
step is q at the run's first word and at the word q further on. Why each is a
run: a stretch of four periods whose smallest period were less than its step would have that
smaller step.

Factors that occur once can't recur when they grow, so a level looks only at places whose
factor recurs in the document. Words are compared by 64-bit fingerprints. Null and empty texts
have no runs; a null key counts as an empty one; rows are independent, repeated rows repeat;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm.words import SPACED, Words, flat, map_blocks, mix

#: A run has so many words at least, and so many periods.
LEAST_WORDS, PERIODS = 6, 4
_STEP = np.uint64(0x9E3779B97F4A7C15)


def planted(key: int | str | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text of n words, by the corpus contract; None: its own."""
    value = zlib.crc32(("" if key is None else str(key)).encode())
    g = value // 10
    if value % 10 or not n:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    source = np.arange(n)
    source[a:] = a + (source[a:] - a) % p
    return source


def _recurring(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names as small numbers, and which of them occur twice or more."""
    small, _ = pd.factorize(names)
    return small, np.bincount(small)[small] > 1 if len(small) else np.zeros(0, bool)


def _proposals(prints: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(start, end, period) of periodic stretches, per level."""
    total = len(prints)
    names, again = _recurring(mix(prints + doc.astype(np.uint64) * _STEP))
    place = np.flatnonzero(again)
    names = names[again]
    where = np.full(total + 1, -1, np.int64)
    b = 1
    while len(place):
        # the step from each place to the next of its factor, if that is within 2 b
        order = np.argsort(names, kind="stable")
        step = np.zeros(len(place), np.int64)
        gap = np.diff(place[order])
        near = (np.diff(names[order]) == 0) & (gap <= 2 * b)
        step[order[:-1][near]] = gap[near]
        where[:] = -1
        where[place] = np.arange(len(place))
        # three occurrences at equal steps
        onward = np.where(step > 0, where[np.minimum(place + step, total)], -1)
        third = (onward >= 0) & (step[onward] == step) & (step > 0)
        at, d = place[third], step[third]
        if len(at):
            begins = np.ones(len(at), bool)
            begins[1:] = (np.diff(at) != 1) | (np.diff(d) != 0)
            first = np.flatnonzero(begins)
            last = np.append(first[1:], len(at)) - 1
            yield at[first], at[last] + b + d[first], d[first]  # the words of the first factors equal those one step on
        # factors of twice the length
        behind = place + b
        second = np.where(behind < total, where[np.minimum(behind, total)], -1)
        grown = (second >= 0) & (doc[place] == doc[np.minimum(behind, total - 1)])
        place, pairs = place[grown], names[grown] * total + names[second[grown]]
        names, again = _recurring(pairs)
        place, names = place[again], names[again]
        b *= 2


def _equal_for(prints: np.ndarray, a: int, b: int, most: int, way: int) -> int:
    """How many words from places a and b on (way 1) or back (way -1) are equal, at most `most`."""
    done, width = 0, 16
    while done < most:
        n = min(width, most - done)
        if way > 0:
            same = prints[a + done : a + done + n] == prints[b + done : b + done + n]
        else:
            same = (prints[a - done - n + 1 : a - done + 1] == prints[b - done - n + 1 : b - done + 1])[::-1]
        if not same.all():
            return done + int(np.argmin(same))
        done, width = done + n, width * 4
    return done


def find_runs(prints: np.ndarray, bounds: np.ndarray, doc: np.ndarray, least: int = LEAST_WORDS, periods: int = PERIODS) -> np.ndarray:
    """Rows (start, length, period), in order, of all runs; text i has the words bounds[i] to bounds[i + 1]."""
    found: set[tuple[int, int, int]] = set()
    for starts, ends, steps in _proposals(prints, doc):
        covered: dict[int, int] = {}
        for s, e, d in zip(starts.tolist(), ends.tolist(), steps.tolist(), strict=True):
            if s < covered.get(d, -1):  # inside a stretch of this period that is known already
                continue
            low, high = int(bounds[doc[s]]), int(bounds[doc[s] + 1])
            s -= _equal_for(prints, s - 1, s - 1 + d, s - low, -1)
            e += _equal_for(prints, e - d, e, high - e, 1)
            covered[d] = e - d
            if e - s >= max(least, periods * d):
                found.add((s, e - s, d))
    out = np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64)
    return out.reshape(len(found), 3)


SCHEMA = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _rows(blocks: Iterator[pa.RecordBatch], key: str, plant: bool, with_text: bool) -> Iterator[pa.RecordBatch]:
    for block in blocks:
        words = Words(*flat(block.column(1)), SPACED)
        prints, bounds = words.fingerprints(), words.first
        sources: list[np.ndarray | None] = [planted(k, int(n)) if plant else None for k, n in zip(block.column(0).to_pylist(), words.counts, strict=True)]
        for i, source in enumerate(sources):
            if source is not None:
                prints[bounds[i] : bounds[i + 1]] = prints[bounds[i] : bounds[i + 1]][source]
        runs = find_runs(prints, bounds, words.text)
        cuts = np.searchsorted(runs[:, 0], bounds)
        columns: list[list] = [[] for _ in range(7 + with_text)]
        for i, body in enumerate(block.column(1).to_pylist()):
            own = (runs[cuts[i] : cuts[i + 1]] - [bounds[i], 0, 0]).tolist()
            best = min(own, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
            said = "".join(f"{s},{n},{q}\n" for s, n, q in own)
            kept = (body or "").encode().split()  # bytes.split() separates at 0x20 and 0x09 to 0x0D
            if sources[i] is not None:
                kept = [kept[k] for k in sources[i].tolist()]
            if own:
                gone = np.zeros(len(kept) + 1, np.int64)
                for s, n, q in own:
                    gone[s + q] += 1
                    gone[s + n] -= 1
                kept = [w for w, g in zip(kept, np.cumsum(gone).tolist(), strict=False) if not g]
            left = b" ".join(kept)
            values = [len(own), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(left).hexdigest()]
            for column, value in zip(columns, [*values, *([left.decode()] if with_text else [])], strict=True):
                column.append(value)
        kinds = [pa.int64()] * 5 + [pa.string()] * (2 + with_text)
        names = [key, "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *(["collapsed"] if with_text else [])]
        yield pa.RecordBatch.from_arrays([block.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)


def detect_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False, with_text: bool = False) -> DataFrame:
    """Key, number of runs, the longest run, digests of all runs and of the collapsed text; on demand the text itself.

    `plant` first makes the corpus contract's periodic tails.
    """
    kind = docs.schema[key].dataType.simpleString()
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("body"))
    schema = f"`{key}` {kind}, {SCHEMA}{', collapsed string' if with_text else ''}"
    return map_blocks(own, lambda blocks: _rows(blocks, key, plant, with_text), schema, "body")
