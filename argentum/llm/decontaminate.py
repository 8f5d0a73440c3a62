"""Benchmark passages in training documents, found with one FM-index per training shard.

A shard is a run of whole documents of a task, cut by size. Its index holds the words that
occur in test phrases; any other words between them become one separator, which no phrase
can cross. The test phrases (windows of consecutive item words) are searched backwards, all
at once, and their occurrences are located through sampled suffix positions and merged into
removal spans.

The benchmark is a stated query set and is taken in blocks of bounded size: each is broadcast,
and if there is more than one, their spans in the original texts are united per document row.

Null and empty texts have no words and no hit; items without words have no window. Rows of one
item_id are one item; a null item_id counts as an item named ''. Repeated documents are
answered one by one. Extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.llm.fm_index import FIRST, SEPARATOR, FMIndex
from argentum.llm.words import ALNUM, BLOCK_BYTES, LOWER, Words, flat, map_blocks, ranges
from argentum.session import broadcast_if_small, stage

WINDOW = 10
#: Symbols of one shard's index (a longer document has a shard of its own).
SHARD_WORDS, SHARD_BYTES = 4_000_000, 32 << 20
SHARD_SYMBOLS = 2_000_000
#: Bytes of benchmark texts in one block.
BLOCK = 32 << 20
#: Phrases searched at once.
SEARCHED = 200_000


def words_of(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Lower-cased words and their fingerprints."""
    data, offsets = flat(texts)
    words = Words(LOWER[data], offsets, ALNUM)
    return words, words.fingerprints()


@dataclass
class Phrases:
    """Distinct windows of the items of a block, as symbols of the block's own vocabulary.

    Plain arrays, made once ahead of the search and broadcast: about ten times 4 bytes a word of the block.
    """

    vocabulary: np.ndarray  # fingerprints of the words, sorted
    text: np.ndarray  # symbols of all items, one after the other
    starts: np.ndarray  # in `text`, of each phrase; phrases are ordered by length
    lengths: list[tuple[int, int]]  # (words, number of phrases)
    names: list[str]  # of the items
    items: np.ndarray  # numbers of the items of each phrase
    first: np.ndarray  # phrase p has items[first[p] : first[p + 1]]

    @classmethod
    def of(cls, rows: list[tuple[str, str | None]], window: int = WINDOW, block: int = BLOCK_BYTES) -> Phrases:
        """Windows of the texts of (item, text); they are looked at in blocks, and compared by fingerprint."""
        names = sorted({name for name, _ in rows})
        number = {name: k for k, name in enumerate(names)}
        owners = np.array([number[name] for name, _ in rows], np.int64)
        prints, found, total = [], defaultdict(list), 0
        sizes = np.cumsum([len(text or "") for _, text in rows])
        cuts = np.searchsorted(sizes, np.arange(0, sizes[-1] if len(sizes) else 0, block))
        for a, b in pairwise([*np.unique(cuts).tolist(), len(rows)]):
            words, own = words_of(pa.array([text for _, text in rows[a:b]], pa.string()))
            for n in range(1, window + 1):
                starts, values = words.windows(own, n)
                wanted = np.ones(len(starts), bool) if n == window else words.counts[words.text[starts]] == n
                found[n].append((starts[wanted] + total, values[wanted], owners[a:b][words.text[starts[wanted]]]))
            prints.append(own)
            total += len(own)
        prints = np.concatenate([np.zeros(0, np.uint64), *prints])
        vocabulary, text = np.unique(prints, return_inverse=True)
        starts, lengths, pairs, before = [], [], [np.zeros(0, np.int64)], 0
        for n, parts in sorted(found.items()):
            at, values, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(at):
                _, once, phrase = np.unique(values, return_index=True, return_inverse=True)
                starts.append(at[once].astype(np.int32))
                lengths.append((n, len(once)))
                pairs.append(np.unique((phrase + before) * len(names) + item))
                before += len(once)
        joint = np.concatenate(pairs)
        first = np.searchsorted(joint, np.arange(before + 1) * max(1, len(names)))
        every = np.concatenate([np.zeros(0, np.int32), *starts])
        return cls(vocabulary, (text + FIRST).astype(np.int32), every, lengths, names, (joint % max(1, len(names))).astype(np.int32), first.astype(np.int32))

    def __len__(self) -> int:
        return len(self.starts)

    def matrices(self) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first phrase, phrases of one length as a matrix), a bounded number at a time."""
        end = 0
        for n, count in self.lengths:
            begin, end = end, end + count
            for at in range(begin, end, SEARCHED):
                starts = self.starts[at : min(at + SEARCHED, end)]
                yield at, self.text[starts[:, None] + np.arange(n)].astype(np.int64)

    def symbols(self, prints: np.ndarray) -> np.ndarray:
        """Symbol of each word; SEPARATOR for words in no phrase."""
        if not len(self.vocabulary):
            return np.full(len(prints), SEPARATOR)
        at = np.minimum(np.searchsorted(self.vocabulary, prints), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == prints, at + FIRST, SEPARATOR)


class Shard:
    """Documents whose symbols are waiting for an index."""

    def __init__(self):
        self.rows: list[pa.Array] = []
        self.n_words: list[np.ndarray] = []
        self.text: list[np.ndarray] = []
        self.place: list[np.ndarray] = []  # document and word of each symbol, as one number over the shard's words
        self.words = self.symbols = 0

    def add(self, row: pa.Array, words: Words, prints: np.ndarray, phrases: Phrases) -> None:
        symbols = phrases.symbols(prints)
        # a document's first word begins a new run: put a separator ahead of it
        first = words.first[:-1][words.counts > 0]
        symbols = np.insert(symbols, first, SEPARATOR)
        place = np.insert(np.arange(len(prints)) + self.words, first, -1)
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != SEPARATOR) | (symbols[:-1] != SEPARATOR)
        self.text.append(symbols[keep])
        self.place.append(place[keep])
        self.rows.append(row)
        self.n_words.append(words.counts)
        self.words += len(prints)
        self.symbols += int(keep.sum())

    def full(self, most: int, held: int = 0) -> bool:
        """Clean text keeps few symbols, so its words, and the bytes of rows that wait for an answer, count as well."""
        return self.symbols >= most or self.words >= SHARD_WORDS or held >= SHARD_BYTES

    def occurrences(self, phrases: Phrases) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
        """(phrase of each occurrence, their length, first word of each), by length."""
        index, place = FMIndex(np.concatenate(self.text)), np.concatenate(self.place)
        for start, patterns in phrases.matrices():
            left, right = index.search(patterns)
            found = np.repeat(np.arange(len(patterns)), right - left)
            if len(found):
                yield start + found, patterns.shape[1], place[index.locate(ranges(left, right - left))]


def _spans(hit: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of hit words that no document's end cuts."""
    edge = np.zeros(len(hit) + 1, bool)
    edge[ends] = True
    begin, stop = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1] | edge[1:-1]
    stop[:-1] &= ~hit[1:] | edge[1:-1]
    return np.flatnonzero(begin), np.flatnonzero(stop) + 1


def _answers(shard: Shard, phrases: Phrases, key: str) -> pa.RecordBatch:
    n_words = np.concatenate(shard.n_words)
    ends = np.cumsum(n_words)
    change = np.zeros(shard.words + 1, np.int64)
    pairs = [np.zeros(0, np.int64)]
    for found, length, starts in shard.occurrences(phrases):
        np.add.at(change, starts, 1)
        np.add.at(change, starts + length, -1)
        joint = np.unique(np.searchsorted(ends, starts, side="right") * len(phrases) + found)
        doc, phrase = joint // len(phrases), joint % len(phrases)
        count = phrases.first[phrase + 1] - phrases.first[phrase]
        pairs.append(np.unique(np.repeat(doc, count) * len(phrases.names) + phrases.items[ranges(phrases.first[phrase], count)]))
    begin, stop = _spans(np.cumsum(change)[:-1] > 0, ends)
    doc = np.searchsorted(ends, begin, side="right")
    base = (ends - n_words)[doc]
    lists = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(doc, np.arange(len(n_words) + 1)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(begin - base), pa.array(stop - base)], names=["start", "end"]),
    )
    items: list[list[str]] = [[] for _ in n_words]
    for pair in np.unique(np.concatenate(pairs)).tolist():
        d, item = divmod(pair, len(phrases.names))
        items[d].append(phrases.names[item])
    return pa.RecordBatch.from_arrays([pa.concat_arrays(shard.rows), pa.array(n_words), lists, pa.array(items, pa.list_(pa.string()))], names=[key, "n_words", "spans", "items"])


def _search(docs: DataFrame, items, key: str, text: str, shard_symbols: int) -> DataFrame:
    kind = docs.schema[key].dataType.simpleString()

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases, shard = Phrases(**items.value), Shard()
        for block in parts:
            words, prints = words_of(block.column(1))
            shard.add(block.column(0), words, prints, phrases)
            if shard.full(shard_symbols):
                yield _answers(shard, phrases, key)
                shard = Shard()
        if shard.rows:
            yield _answers(shard, phrases, key)

    return map_blocks(docs.select(key, text), make, f"`{key}` {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>", text)


def merged(spans: list[dict] | None) -> list[dict]:
    """Word ranges as disjoint ranges in order."""
    out: list[dict] = []
    for s in sorted(() if spans is None else spans, key=lambda x: x["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append({"start": s["start"], "end": s["end"]})
    return out


def _united(spans: pd.Series) -> pd.Series:
    return pd.Series([merged(x) for x in spans])


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, shard_symbols: int = SHARD_SYMBOLS, block: int = BLOCK) -> DataFrame:
    """Key, n_words, spans (array of word ranges to remove) and items (sorted item_ids with an occurring window) per document row."""
    blocks, items = _items(docs.sparkSession, benchmark, block, window)
    if blocks == 1:
        return _search(docs, items(0), key, text, shard_symbols)
    rows = stage(docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("no"), F.col(text).alias("body")), "numbered")
    found = None
    for part in _parts(rows, blocks, items, shard_symbols):
        found = part if found is None else found.unionByName(part)
    joined = found.groupBy("no").agg(F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    unite = F.pandas_udf(_united, "array<struct<start:long,end:long>>")
    return rows.select("no", "key").join(joined.withColumn("spans", unite("spans")), "no").select(F.col("key").alias(key), "n_words", "spans", "items")


def _parts(rows: DataFrame, blocks: int, items, shard_symbols: int) -> Iterator[DataFrame]:
    """Answers by `no` about texts `body`, of one block of the benchmark after the other."""
    for n in range(blocks):
        yield stage(_search(rows.select("no", "body"), items(n), "no", "body", shard_symbols), "block")


def _items(spark, benchmark: DataFrame, block: int, window: int):
    """Number of blocks of the benchmark, and a function that broadcasts the phrases of one, as the arrays of `Phrases`."""
    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = named.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block))

    def items(n: int):
        rows = named if blocks == 1 else named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        told = Phrases.of([tuple(r) for r in rows.collect()], window)  # one block of the query set
        return spark.sparkContext.broadcast(vars(told))

    return blocks, items


def remove_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, shard_symbols: int = SHARD_SYMBOLS, block: int = BLOCK) -> DataFrame:
    """Documents without the words inside occurrences of benchmark windows.

    Every block of the benchmark is searched in the original texts; they are cut once, at the united spans.
    """
    blocks, items = _items(docs.sparkSession, benchmark, block, window)
    if blocks > 1:
        # the row's own columns stay inside a struct, whatever their names
        rows = stage(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("no"), docs[text].alias("body")), "numbered")
        found = None
        for part in _parts(rows, blocks, items, shard_symbols):
            hit = part.where(F.size("spans") > 0).select("no", "spans")
            found = hit if found is None else found.unionByName(hit)
        spans = broadcast_if_small(stage(found.groupBy("no").agg(F.flatten(F.collect_list("spans")).alias("cut")), "spans"))
        left = remove_spans(rows.join(spans, "no", "left").select("row", "body", "cut"), "body", "cut", ALNUM)
        return left.select(*[F.col("body").alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    place = docs.columns.index(text)

    def cutter(told):
        def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            phrases, shard, waiting = Phrases(**told.value), Shard(), []

            def answer() -> Iterator[pa.RecordBatch]:
                spans, at = _answers(shard, phrases, "row").column(2), 0
                for block in waiting:
                    left = cut_texts(block.column(place), spans.slice(at, block.num_rows).to_pylist(), ALNUM)
                    at += block.num_rows
                    yield pa.RecordBatch.from_arrays([left if k == place else c for k, c in enumerate(block.columns)], names=block.schema.names)

            for part in parts:
                words, prints = words_of(part.column(place))
                shard.add(part.column(place).is_null(), words, prints, phrases)
                waiting.append(part)
                if shard.full(shard_symbols, sum(x.nbytes for x in waiting)):
                    yield from answer()
                    shard, waiting = Shard(), []
            if waiting:
                yield from answer()

        return make

    return map_blocks(docs, cutter(items(0)), schema, text)


def cut_texts(texts: pa.Array, spans_of: list[list[dict] | None], separators: np.ndarray) -> pa.Array:
    """Texts without the given word ranges."""
    data, offsets = flat(texts)
    words = Words(data, offsets, separators)
    raw, out = data.tobytes(), texts.to_pylist()
    for k, spans in enumerate(map(merged, spans_of)):
        if spans:
            kept, at, first = [], int(offsets[k]), int(words.first[k])
            for s in spans:
                kept.append(raw[at : words.start[first + s["start"]]])
                at = int(words.end[first + s["end"] - 1])
            kept.append(raw[at : offsets[k + 1]])
            out[k] = b"".join(kept).decode("utf-8", "replace")
    return pa.array(out, pa.string())


def remove_spans(docs: DataFrame, text: str, cut: str, separators: np.ndarray) -> DataFrame:
    """Replace `text` by what is left without the word ranges in column `cut`, which may overlap; the column goes, white space stays.

    Texts without a range stay as they are, null included.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != cut)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in parts:
            left = cut_texts(block.column(block.schema.get_field_index(text)), block.column(block.schema.get_field_index(cut)).to_pylist(), separators)
            names = [x for x in block.schema.names if x != cut]
            yield pa.RecordBatch.from_arrays([left if x == text else block.column(block.schema.get_field_index(x)) for x in names], names=names)

    return map_blocks(docs, run, schema, text)


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and the hash of the items, from the spans."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
