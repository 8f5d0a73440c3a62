"""Repeated word windows across documents, found with one compressed FM-index per shard.

A word goes if a window of 20 words that covers it also starts earlier (in a smaller doc_id,
or further ahead in the same document). Shards are made by content: the windows of a document
are cut into segments of the same minimizer (the least k-word hash of a window), and equal
windows have equal minimizers, so they meet in one shard, whatever document they are in.

1. Every task emits the segments of its documents as narrow rows.
2. Dealt by minimizer and sorted, equal segments stand together: all but the first are repeats
   as a whole. Segments whose minimizer occurs once in one distinct segment are settled here.
3. What is left gets its words back. Every shard builds an FM-index of its segments in document
   order and streams them against it: backward search over the wavelet tree gives each
   window's matching statistics, and a window that occurs twice or more is located. Windows
   that are not the first of their interval of sorted suffixes are reported.
4. The reported windows of a document are united into removal spans.

Minimizers that very many segments share (of a common line, say) are ranked last, so that a
window uses them only if it has no other. They are looked for in a sample of documents; this
changes how work is dealt, never the result.

Null and empty texts have no words. Rows of one doc_id and text are one document and have the
same result; texts of one doc_id are ordered by a hash. A null doc_id comes before all others. Extra columns are ignored, or kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm.decontaminate import remove_spans
from argentum.llm.fm_index import FIRST, SEPARATOR, FMIndex
from argentum.llm.words import SPACED, Words, flat, map_blocks, mix, ranges
from argentum.session import stage

WINDOW = 20
#: Words of a minimizer.
K = 8
#: Symbols of one shard's index; a minimizer's segments stay together.
SHARD_SYMBOLS = 1_000_000
#: Documents looked at for common minimizers: one in so many, and how often in them a minimizer is common.
SAMPLE, COMMON = 16, 32
#: Common minimizers that are ranked last, at most (the most frequent ones).
MOST_COMMON = 50_000


def minimizers(words: Words, prints: np.ndarray, window: int = WINDOW, k: int = K, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, minimizer) of every window, and the hash of every k words; values in `last` (sorted) rank behind all others."""
    n = len(prints) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = np.zeros(len(prints) - k + 1, np.uint64)
    for i in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + prints[i : i + len(grams)]
    grams = mix(grams) >> np.uint64(1)
    if last is not None and len(last):
        at = np.minimum(np.searchsorted(last, grams), len(last) - 1)
        grams |= np.where(last[at] == grams, np.uint64(1) << np.uint64(63), np.uint64(0))
    # least of each run of window - k + 1 grams: by doubling
    wide, least = 1, grams
    runs = window - k + 1
    while wide * 2 <= runs:
        least = np.minimum(least[: len(least) - wide], least[wide:])
        wide *= 2
    if wide < runs:
        least = np.minimum(least[: len(least) - (runs - wide)], least[runs - wide :])
    starts = np.flatnonzero(words.text[:n] == words.text[window - 1 :])
    return starts, least[starts], grams


def _segments(words: Words, prints: np.ndarray, window: int, k: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first word, windows, fingerprint of all words, whether the minimizer recurs) of each segment."""
    starts, least, grams = minimizers(words, prints, window, k, last)
    if not len(starts):
        return (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool))
    fresh = np.append(True, (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1))
    at = np.flatnonzero(fresh)
    n = np.diff(np.append(at, len(starts)))
    first = starts[at]
    # a polynomial over the segment's words, by prefix sums
    base = np.uint64(0xD1342543DE82EF95)
    up = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(prints), base)))
    total = np.append(np.uint64(0), np.cumsum(prints * up[:-1]))
    down = np.multiply.accumulate(np.append(np.uint64(1), np.full(len(prints), np.uint64(pow(int(base), -1, 1 << 64)))))
    whole = mix((total[first + n + window - 1] - total[first]) * down[first] + n.astype(np.uint64))
    inside = n + window - k
    met = np.add.reduceat((grams[ranges(first, inside)] == np.repeat(least[at], inside)).astype(np.int64), np.cumsum(inside) - inside)
    return least[at], first, n, whole, met > 1


def common_minimizers(docs: DataFrame, text: str, window: int = WINDOW, k: int = K) -> np.ndarray:
    """Minimizers that occur often in a sample of the documents; at most MOST_COMMON."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in parts:
            words = Words(*flat(block.column(0)), SPACED)
            _, least, _ = minimizers(words, words.fingerprints(), window, k)
            values, n = np.unique(least[np.append(True, least[1:] != least[:-1])] if len(least) else least, return_counts=True)
            often = n > 1
            yield pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(n[often])], names=["value", "n"])

    sample = docs.select(text).where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0)
    found = map_blocks(sample, count, "value long, n long", text).groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    rows = found.orderBy(F.desc("n"), "value").limit(MOST_COMMON).collect()
    return np.sort(np.array([r["value"] for r in rows], np.int64).view(np.uint64))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimizer, segment, document and start: mark repeats (`again`), drop lone first segments in which no window can recur.

    What is carried from batch to batch is one row.
    """
    held, held_has_other, before = None, False, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, seg, th, start = (batch.column(k).to_numpy() for k in (0, 1, 3, 4))
        same_h = np.append(before is not None and h[0] == before[0], h[1:] == h[:-1])
        again = same_h & np.append(before is not None and seg[0] == before[1], seg[1:] == seg[:-1])
        copy = again & np.append(before is not None and (th[0], start[0]) == before[2:], (th[1:] == th[:-1]) & (start[1:] == start[:-1]))
        before = h[-1], seg[-1], th[-1], start[-1]
        first = np.flatnonzero(~again)
        rows = batch.take(pa.array(first))
        if held is not None:
            rows = pa.Table.from_batches([held, rows]).combine_chunks().to_batches()
            rows = rows[0]
        own = rows.column(0).to_numpy()
        left = np.append(held is not None and held_has_other, own[1:] == own[:-1])[: len(own)]
        right = np.append(own[1:] == own[:-1], False)[: len(own)]
        emit = left | right | rows.column(6).to_numpy(zero_copy_only=False)
        repeats = batch.take(pa.array(np.flatnonzero(again & ~copy)))
        if repeats.num_rows:
            yield pa.RecordBatch.from_arrays([*repeats.columns, pa.array(np.ones(repeats.num_rows, bool))], names=[*repeats.schema.names, "again"])
        if len(own):
            held, held_has_other = rows.slice(len(own) - 1, 1), bool(left[-1])
            done = rows.take(pa.array(np.flatnonzero(emit[:-1])))
            if done.num_rows:
                yield pa.RecordBatch.from_arrays([*done.columns, pa.array(np.zeros(done.num_rows, bool))], names=[*done.schema.names, "again"])
    if held is not None and (held_has_other or held.column(6)[0].as_py()):
        yield pa.RecordBatch.from_arrays([*held.columns, pa.array([False])], names=[*held.schema.names, "again"])


def _repeated(texts: list[np.ndarray], counts: list[int], window: int) -> list[np.ndarray]:
    """For segments in document order: which of their windows also start earlier in one of them."""
    prints = np.concatenate(texts)
    lengths = np.array([len(x) for x in texts])
    _, symbols = np.unique(prints, return_inverse=True)
    ahead = np.cumsum(lengths) - lengths
    text = np.insert(symbols + FIRST, ahead, SEPARATOR)
    start = ahead + np.arange(1, len(texts) + 1)
    n = np.array(counts)
    places = ranges(start, n)
    index = FMIndex(text)
    length, left, right = index.matching_statistics(text, places + window, window, wanted=2)
    twice = np.flatnonzero(length == window)
    out = np.zeros(len(places), bool)
    if len(twice):
        lefts, one, back = np.unique(left[twice], return_index=True, return_inverse=True)
        widths = (right[twice] - left[twice])[one]
        found = index.locate(ranges(lefts, widths))
        first = np.minimum.reduceat(found, np.cumsum(widths) - widths)
        out[twice] = places[twice] > first[back]
    return np.split(out, np.cumsum(n)[:-1])


def _search(window: int, most: int):
    """Task over rows (h, doc, th, start, n, words) sorted by h: one index per run of whole minimizer groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0

        def answer() -> pa.RecordBatch:
            # document order decides what is earlier
            place = {(x[2], x[3]): i for i, x in enumerate(rows)}  # rows of a repeated document are one
            order = sorted(place.values(), key=lambda i: (rows[i][1] is not None, *rows[i][1:4]))
            marks = _repeated([np.frombuffer(rows[i][5], np.uint64) for i in order], [rows[i][4] for i in order], window)
            docs, prints, starts, counts = [], [], [], []
            for i, mark in zip(order, marks, strict=True):
                edge = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    docs.append(rows[i][1])
                    prints.append(rows[i][2])
                    starts.append(rows[i][3] + a)
                    counts.append(b - a)
            return pa.RecordBatch.from_arrays([pa.array(docs, kinds[1]), pa.array(prints, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], names=["doc", "th", "start", "n"])

        kinds = None
        for batch in batches:
            kinds = batch.schema.types
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= most and row[0] != rows[-1][0]:
                    yield answer()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[5]) // 8
        if rows:
            yield answer()

    return run


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = K, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """Per document with repeats: doc, th (hash of doc_id and text) and `spans`, the word ranges (start, end) to remove."""
    kind = docs.schema[key].dataType.simpleString()
    last = docs.sparkSession.sparkContext.broadcast(common_minimizers(docs, text, window, k))
    own = docs.select(F.col(key).alias("doc"), F.xxhash64(key, text).alias("th"), F.col(text).alias("body"))

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in parts:
            words = Words(*flat(block.column(2)), SPACED)
            h, first, n, whole, recurs = _segments(words, words.fingerprints(), window, k, last.value)
            doc = words.text[first]
            columns = [pa.array(h.view(np.int64)), pa.array(whole.view(np.int64)), block.column(0).take(pa.array(doc)), block.column(1).take(pa.array(doc)), pa.array((first - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(recurs)]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "seg", "doc", "th", "start", "n", "recurs"])

    rows = f"h long, seg long, doc {kind}, th long, start int, n int, recurs boolean"
    segments = map_blocks(own, cut, rows, "body").repartition("h").sortWithinPartitions("h", "seg", "doc", "th", "start")
    settled = stage(segments.mapInArrow(_settle, f"{rows}, again boolean"), "segments")

    def with_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in parts:
            words = Words(*flat(block.column(2)), SPACED)
            prints = words.fingerprints()
            doc, h, start, n, raw = [], [], [], [], []
            for i, segs in enumerate(block.column(3).to_pylist()):
                for s in segs:
                    at = int(words.first[i]) + s["start"]
                    doc.append(i)
                    h.append(s["h"])
                    start.append(s["start"])
                    n.append(s["n"])
                    raw.append(prints[at : at + s["n"] + window - 1].tobytes())
            of = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), block.column(0).take(of), block.column(1).take(of), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(raw, pa.binary())], names=["h", "doc", "th", "start", "n", "words"])

    wanted = settled.where(~F.col("again")).groupBy("doc", "th").agg(F.collect_list(F.struct("h", "start", "n")).alias("segs"))
    same = F.col("o.doc").eqNullSafe(F.col("w.doc")) & (F.col("o.th") == F.col("w.th"))
    joined = own.alias("o").join(wanted.alias("w"), same).select("o.doc", "o.th", "o.body", "w.segs")
    shards = map_blocks(joined, with_words, f"h long, doc {kind}, th long, start long, n long, words binary", "body").repartition("h").sortWithinPartitions("h")
    found = shards.mapInArrow(_search(window, shard_symbols), f"doc {kind}, th long, start long, n long")
    repeats = settled.where("again").select("doc", "th", F.col("start").cast("long").alias("start"), F.col("n").cast("long").alias("n")).unionByName(found)
    return repeats.groupBy("doc", "th").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + (window - 1)).alias("end"))).alias("spans"))


def _with_spans(docs: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """`row` (struct of all columns), text as `body`, and `spans` (null without repeats)."""
    spans = repeated_spans(docs, key, text, window).alias("s")
    row = F.struct(*[docs[c] for c in docs.columns])
    own = docs.select(row.alias("row"), F.col(key).alias("doc"), F.xxhash64(key, text).alias("th"), F.col(text).alias("body")).alias("o")
    same = F.col("o.doc").eqNullSafe(F.col("s.doc")) & (F.col("o.th") == F.col("s.th"))
    return own.join(spans, same, "left").select("row", F.col("o.doc").alias("doc"), "body", "spans")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Documents without the repeated words; white space between the words that stay is kept."""
    cut = remove_spans(_with_spans(docs, key, text, window).drop("doc"), "body", "spans", SPACED)
    return cut.select(*[F.col("body").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Key, n_words, n_removed and the hash of the kept words joined by one space."""
    kind = docs.schema[key].dataType.simpleString()

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in parts:
            total, removed, digests = [], [], []
            for body, spans in zip(block.column(1).to_pylist(), block.column(2).to_pylist(), strict=True):
                words = (body or "").encode().split()  # bytes.split() separates at 0x20 and 0x09 to 0x0D
                total.append(len(words))
                if spans:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, [s["start"] for s in spans], 1)
                    np.add.at(gone, [s["end"] for s in spans], -1)
                    words = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
                removed.append(total[-1] - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=[key, "n_words", "n_removed", "kept_sha256"])

    found = _with_spans(docs.select(key, text), key, text, window).select("doc", "body", "spans")
    return map_blocks(found, make, f"`{key}` {kind}, n_words long, n_removed long, kept_sha256 string", "body")
