"""Words of a corpus grouped with their more frequent spellings, one edit apart.

Words are counted by occurrence. The vocabulary goes into Bloom filters of 64-bit blocks, one
per word length, which are broadcast; every word probes its shorter (one code point deleted) and
smaller (one code point replaced by a lesser one) neighbours. An inserted code point is a deleted
one seen from the other word, and a replaced one is lesser from one side, so each near pair is
probed once. Only positives are shuffled, to a join with the vocabulary itself, which is exact.

A word's form is its most frequent near word if that is `FACTOR` times as frequent; following
forms leads to the root. Counts rise by that factor along the way, so a few rounds of pointer
jumping end it.

Filters have a bounded size: of a larger vocabulary, each pass broadcasts the next `FILTER_BYTES`
of them, and words probe again. Null texts have no words, a null key counts as an empty one;
repeated rows count again; empty tables give no rows. Ties go to the first word in code-point
order. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argentum.llm.words import BATCH, LOWER, Words, distinct, fingerprints_of, flat, map_blocks, mix, ranges
from argentum.session import stage

LEAST_LENGTH, LEAST_COUNT, FACTOR, SLIP = 6, 5, 5, 199
#: Lengths from here on share one filter.
LONGEST = 64
#: Filter bits per word, and bits that a word sets in its block.
BITS, SET = 24, 4
#: Blocks of 8 bytes that are built together.
CHUNK = 1 << 15
#: Filter bytes that one pass broadcasts.
FILTER_BYTES = 32 << 20
#: Probes that a task makes together.
PROBES = 1 << 20
#: Runs up to this many bytes are hashed side by side.
SHORT = 48

#: Code points of words, which fit one byte: a-z and U+00C0 to U+00FF, in order.
ALPHABET = np.concatenate([np.arange(0x61, 0x7B), np.arange(0xC0, 0x100)]).astype(np.uint8)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, each carried on from the value in `begun`."""
    table, length = _crc_table(), end - start
    order = np.argsort(-length, kind="stable")
    value = begun[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    first, length = start[order], length[order]
    long = int(np.searchsorted(-length, -SHORT))
    for j in range(int(length[long]) if long < len(length) else 0):
        upto = int(np.searchsorted(-length, -j))  # those longer than j
        part = value[long:upto]
        value[long:upto] = table[(part ^ data[first[long:upto] + j]) & 255] ^ (part >> 8)
    value ^= np.uint32(0xFFFFFFFF)
    for k in range(long):
        value[k] = zlib.crc32(data[first[k] : first[k] + length[k]].tobytes(), int(begun[order[k]]))
    out = np.empty_like(value)
    out[order] = value
    return out


def _runs(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of letters a-z and U+00C0 to U+00FF (0xC3 and the byte behind it)."""
    lead = data == 0xC3
    inside = ((data >= 0x61) & (data <= 0x7A)) | lead
    inside[1:] |= lead[:-1]
    runs = Words(inside.view(np.uint8), offsets, np.arange(256) == 0)
    runs.data = data
    return runs


def _strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    length = end - start
    offsets = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length, out=offsets[1:])
    return pa.StringArray.from_buffers(len(length), pa.py_buffer(offsets), pa.py_buffer(data[ranges(start, length)]))


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int = SLIP) -> DataFrame:
    """Words (word, n) of the texts, with the slips of the corpus contract applied to every document's runs."""

    def count(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            data, offsets = flat(block.column(1))
            data = LOWER[data]
            runs = _runs(data, offsets)
            wide = np.concatenate([[0], np.cumsum(data == 0xC3)])
            points = runs.end - runs.start - (wide[runs.end] - wide[runs.start])
            keep = np.flatnonzero(points >= least_length)
            start, end, doc, points = runs.start[keep], runs.end[keep], runs.text[keep], points[keep]
            prints = fingerprints_of(data, start, end)
            # one hash per document and distinct run
            first, back = distinct(mix(prints + doc.astype(np.uint64) * _STEP))
            times = np.bincount(back, minlength=len(first))
            begun = np.array([zlib.crc32(f"{'' if k is None else k}:".encode()) for k in block.column(0).to_pylist()], np.uint32)
            value = crc32_of(data, start[first], end[first], begun[doc[first]])
            slipped = value % slip == 0
            same = first[~slipped]
            word, to = distinct(prints[same])
            at = same[word]
            n = np.bincount(to, weights=times[~slipped], minlength=len(word)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([_strings(data, start[at], end[at]), pa.array(n)], names=["word", "n"])
            hit = np.flatnonzero(slipped)
            hit = hit[points[first[hit]] > least_length]
            if len(hit):
                cut = []
                for i, v in zip(first[hit].tolist(), value[hit].tolist(), strict=True):
                    run = data[start[i] : end[i]].tobytes().decode()
                    gone = v % len(run)
                    cut.append(run[:gone] + run[gone + 1 :])
                yield pa.RecordBatch.from_arrays([pa.array(cut, pa.string()), pa.array(times[hit].astype(np.int64))], names=["word", "n"])

    own = docs.select(F.col(key).cast("string").alias("key"), F.col(text).alias("body"))
    return map_blocks(own, count, "word string, n long", "body").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix of code points) of the words of each length."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths).tolist():
        places = np.flatnonzero(lengths == length)
        step = max(1, PROBES // (length * 32))
        for k in range(0, len(places), step):
            part = places[k : k + step]
            letters = np.frombuffer("".join(words[i] for i in part.tolist()).encode("latin-1"), np.uint8)
            yield length, part, letters.reshape(len(part), length)


def _powers(length: int) -> np.ndarray:
    out = np.full(length, _STEP, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _places(sums: np.ndarray, length: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, bits) of words whose letters have these sums."""
    x = mix(sums + np.uint64(length * 0xA0761D6478BD642F % (1 << 64)))
    bits = np.zeros(x.shape, np.uint64)
    for k in range(SET):
        bits |= np.uint64(1) << ((x >> np.uint64(6 * k)) & np.uint64(63))
    return ((x >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32), bits


def _shard(length: int) -> int:
    return min(length, LONGEST)


def filter_sizes(words: DataFrame) -> dict[int, int]:
    """Blocks of each length's filter; lengths are few, as the longest share one."""
    counted = words.groupBy(F.least(F.length("word"), F.lit(LONGEST)).alias("shard")).count().collect()
    return {r["shard"]: max(1, -(-r["count"] * BITS // 64)) for r in counted}


def _passes(sizes: dict[int, int], most: int) -> list[set[tuple[int, int]]]:
    """(shard, chunk) of the filters, dealt into passes of bounded bytes."""
    parts = [(shard, chunk) for shard in sorted(sizes) for chunk in range(-(-sizes[shard] // CHUNK))]
    step = max(1, most // (8 * CHUNK))
    return [set(parts[k : k + step]) for k in range(0, len(parts), step)]


def build_filters(words: DataFrame, sizes: dict[int, int], wanted: set[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The wanted parts of the filters; each is made in one task from its own words, whose share a hash decides."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, letters in _by_length(batch.column(0).to_pylist()):
                block, bits = _places((_values()[letters] * _powers(length)).sum(axis=1, dtype=np.uint64), length, sizes[_shard(length)])
                chunk = block // np.uint64(CHUNK)
                mine = np.isin(chunk, [c for s, c in wanted if s == _shard(length)])
                columns = [np.full(int(mine.sum()), _shard(length), np.int32), chunk[mine].astype(np.int32), (block[mine] % np.uint64(CHUNK)).astype(np.int32), bits[mine].view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shard", "chunk", "block", "bits"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(CHUNK, np.int64)
        own[rows["block"]] = rows["bits"]
        return pd.DataFrame({"shard": rows["shard"].iloc[:1], "chunk": rows["chunk"].iloc[:1], "bits": [own.tobytes()]})

    placed = words.select("word").mapInArrow(place, "shard int, chunk int, block int, bits long")
    merged = placed.groupBy("shard", "chunk", "block").agg(F.bit_or("bits").alias("bits"))
    parts = merged.groupBy("shard", "chunk").applyInPandas(join, "shard int, chunk int, bits binary")
    return {(r["shard"], r["chunk"]): np.frombuffer(r["bits"], np.uint64) for r in parts.toLocalIterator()}


class Filters:
    def __init__(self, sizes: dict[int, int], parts: dict[tuple[int, int], np.ndarray]):
        self.sizes, self.parts, self.joined = sizes, parts, {}

    def have(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Whether words of this length may be in the parts at hand."""
        shard = _shard(length)
        if shard not in self.sizes:
            return np.zeros(sums.shape, bool)
        if shard not in self.joined:
            chunks = sorted(c for s, c in self.parts if s == shard)
            first = chunks[0] if chunks else 0
            whole = np.zeros((chunks[-1] - first + 1 if chunks else 0) * CHUNK, np.uint64)
            for c in chunks:
                whole[(c - first) * CHUNK : (c - first + 1) * CHUNK] = self.parts[shard, c]
            self.joined[shard] = first * CHUNK, whole
        base, whole = self.joined[shard]
        block, bits = _places(sums, length, self.sizes[shard])
        at = block.astype(np.int64) - base
        inside = (at >= 0) & (at < len(whole))
        out = np.zeros(sums.shape, bool)
        out[inside] = (whole[at[inside]] & bits[inside]) == bits[inside]
        return out

    def probe(self, letters: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows, positions, code point or -1) of the edits that may be words: a point replaced by a lesser one, or deleted."""
        n, length = letters.shape
        powers, values = _powers(length), _values()
        parts = values[letters] * powers
        ahead = np.zeros((n, length + 1), np.uint64)
        np.cumsum(parts, axis=1, out=ahead[:, 1:])
        whole = ahead[:, -1:]
        # of a stretch of one letter, only its last is deleted: the others give the same word
        last = np.ones(letters.shape, bool)
        last[:, :-1] = letters[:, :-1] != letters[:, 1:]
        shorter = ahead[:, :-1] + (whole - ahead[:, 1:]) * _BACK
        yield *np.nonzero(last & self.have(shorter, length - 1)), -1
        span = max(1, PROBES // max(1, n))
        for a in range(0, length, span):
            b = min(length, a + span)
            for c in ALPHABET.tolist():
                lesser = letters[:, a:b] > c
                row, at = np.nonzero(lesser)
                if not len(row):
                    continue
                at = at + a
                sums = whole[row, 0] - parts[row, at] + values[c] * powers[at]
                hit = self.have(sums, length)
                yield row[hit], at[hit], c


def near_pairs(words: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(word, n, near, near_n) of words one edit apart, each pair in one direction; `words` (word, n) should be staged."""
    spark = words.sparkSession
    sizes = filter_sizes(words)
    for setting, most in BATCH.items():
        spark.conf.set(setting, most)
    positives = []
    for wanted in _passes(sizes, filter_bytes):
        filters = spark.sparkContext.broadcast(Filters(sizes, build_filters(words, sizes, wanted)))

        def probe(batches: Iterator[pa.RecordBatch], filters=filters) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = batch.column(0).to_pylist()
                for _, places, letters in _by_length(own):
                    source, edit = [], []
                    for rows, positions, c in filters.value.probe(letters):
                        put = "" if c < 0 else chr(c)
                        for at, i in zip(places[rows].tolist(), positions.tolist(), strict=True):
                            source.append(at)
                            edit.append(own[at][:i] + put + own[at][i + 1 :])
                    if source:
                        taken = batch.take(pa.array(source))
                        yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(edit, pa.string())], names=["word", "n", "near"])

        positives.append(stage(words.select("word", "n").mapInArrow(probe, "word string, n long, near string"), "positives"))
        filters.destroy()
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    if not positives:
        return known.where("false").select(F.col("near").alias("word"), F.col("near_n").alias("n"), "near", "near_n")
    union = positives[0]
    for more in positives[1:]:
        union = union.unionByName(more)
    return union.join(known, "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the last word that forms lead to, by pointer jumping.

    A form is more frequent than its word by a factor, so the ways are short and have no rings.
    """
    jumps = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = stage(jumps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not jumped.where("moved").limit(1).count():
            return jumped.select("word", "root")
        jumps = jumped.select("word", "root")


def group_spellings(docs: DataFrame, key: str = "doc_id", text: str = "text", factor: int = FACTOR, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = stage(vocabulary(docs, key, text), "vocabulary")
    pairs = near_pairs(words, filter_bytes)
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    rows = pairs.select(both.alias("p")).select("p.*")
    best = rows.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("top"))
    found = words.join(best, "word", "left")
    is_form = -F.col("top.less") >= factor * F.col("n")
    named = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("top.near")).alias("form"), F.when(is_form, -F.col("top.less")).alias("form_n"))
    named = stage(named, "named")
    ends = roots(named.where(F.col("form").isNotNull()))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
