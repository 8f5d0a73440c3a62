"""Texts of an Arrow batch as numpy arrays: words, their 64-bit fingerprints, and chunks.

Words are maximal runs of bytes that no separator byte ends. Both word definitions of this
package separate at ASCII bytes only, so cutting UTF-8 by bytes cuts it by characters.
Two words are the same if their fingerprints are: a random polynomial modulo 2 ** 64.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows and bytes that Spark hands to a worker at once; with the blocks they bound a task's memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
#: Text bytes that a task looks at together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20


def _separators(keep: bytes | None, drop: bytes | None) -> np.ndarray:
    table = np.zeros(256, bool)
    if keep is not None:
        table[:128] = True
        table[np.frombuffer(keep, np.uint8)] = False
    if drop is not None:
        table[np.frombuffer(drop, np.uint8)] = True
    return table


#: Words `[^\x20\x09-\x0D]+`.
SPACED = _separators(None, b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of a text whose A-Z are lower-cased.
ALNUM = _separators(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", None)
#: A-Z to a-z, other bytes unchanged.
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _values() -> np.ndarray:
    return np.random.default_rng(20_011).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a uint64 over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts one after the other, and n + 1 offsets; null is empty."""
    texts = texts.cast(pa.large_binary()) if texts.type not in (pa.string(), pa.binary()) else texts
    if texts.null_count:
        texts = texts.fill_null("" if texts.type == pa.string() else b"")
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None and len(texts) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


class Words:
    """Words of several texts: `start`, `end` (bytes), `text` (which text), `first` (word range of text i: first[i] to first[i + 1])."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray):
        inside = ~separators[data]
        # a text's edges separate as well
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        self.data, self.offsets = data, offsets
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(self.counts)), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def fingerprints(self) -> np.ndarray:
        """64-bit fingerprint of each word."""
        n = len(self.data) + 1
        if not _TABLES or len(next(iter(_TABLES.values()))[0]) < n:
            size = 1 << max(16, (n - 1).bit_length())
            _TABLES[0] = _powers(_BASE, size), _powers(_INVERSE, size)
        up, down = _TABLES[0]
        total = np.zeros(n, np.uint64)
        np.cumsum(_values()[self.data] * up[: n - 1], out=total[1:])
        return mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))

    def windows(self, fingerprints: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, fingerprint) of every window of `width` words inside a text."""
        n = len(fingerprints) - width + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        starts = np.flatnonzero(self.text[:n] == self.text[width - 1 :])
        joint = np.zeros(n, np.uint64)
        for k in range(width):
            joint = joint * np.uint64(_BASE) + fingerprints[k : k + n]
        return starts, mix(joint[starts])


def blocks(batch: pa.RecordBatch, column: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose texts have about `most` bytes together."""
    lengths = batch.column(column)
    data, offsets = flat(lengths)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def map_blocks(docs: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, column: str = "text") -> DataFrame:
    """Run `make` over the blocks of every task; no shuffle."""

    def run(batches):
        return make(block for batch in batches for block in blocks(batch, column))

    for setting, most in BATCH.items():
        docs.sparkSession.conf.set(setting, most)
    return docs.mapInArrow(run, schema)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All of starts[i], starts[i] + 1, ... (counts[i] of them), one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts - starts, counts)


_WIDE = [(0xC2, None, b"\x85\xa0"), (0xE1, 0x9A, b"\x80"), (0xE2, 0x80, b"\x80\x81\x82\x83\x84\x85\x86\x87\x88\x89\x8a\xa8\xa9\xaf"), (0xE2, 0x81, b"\x9f"), (0xE3, 0x80, b"\x80")]


def _wide_space(data: np.ndarray) -> np.ndarray:
    """Bytes that belong to white space outside ASCII."""
    out = np.zeros(len(data), bool)
    for lead, middle, last in _WIDE:
        at = np.flatnonzero(data == lead)
        width = 2 if middle is None else 3
        at = at[at + width <= len(data)]
        ok = np.isin(data[at + width - 1], np.frombuffer(last, np.uint8))
        if middle is not None:
            ok &= data[at + 1] == middle
        for k in range(width):
            out[at[ok] + k] = True
    return out


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts at single spaces between characters that aren't white space.

    Gives start, end and text of each chunk; a space begins the chunk that follows it. No
    pre-token of the public tokenizers spans such a cut, so chunks are tokenized on their own.
    """
    n = len(data)
    solid = ~((data <= 0x20) | (data == 0x7F) | _wide_space(data)) if n else np.zeros(0, bool)
    cut = np.zeros(n + 1, bool)
    if n > 2:
        cut[1 : n - 1] = (data[1:-1] == 0x20) & solid[:-2] & solid[2:]
    cut[offsets] = True  # the edges of texts
    bounds = np.flatnonzero(cut)
    start, end = bounds[:-1], bounds[1:]
    text = np.searchsorted(offsets, start, side="right") - 1
    return start, end, text


def fingerprints_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of any byte ranges."""
    holder = Words.__new__(Words)
    holder.data, holder.start, holder.end = data, start, end
    return holder.fingerprints()


def distinct(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first of each distinct value, which of them each value is)."""
    back, values = pd.factorize(prints)
    first = np.zeros(len(values), np.int64)
    first[back[::-1]] = np.arange(len(prints) - 1, -1, -1)
    return first, back
