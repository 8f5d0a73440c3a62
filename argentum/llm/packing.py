"""Packing of tokenized documents into fixed windows by non-negative least squares.

Documents longer than a window are cut into full windows and a rest. The histogram of the
rests goes to the driver (one count per length below the window, whatever the corpus size).
There, combinations of few lengths that fill a window are enumerated over rounded-up length
classes, their repeat counts are fitted to the histogram by non-negative least squares and
rounded down, and what is left is packed by best fit on counts per length, longest first.
Pieces find their place by their rank among the pieces of their length: no sequence is built
on the driver, and no task holds more than a partition.

Null and empty texts have the end id alone. Repeated rows are packed as often as they occur.
Extra columns are left out. An empty table gives no piece.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from argentum.llm.words import LOWER, chunks, distinct, fingerprints_of, flat, map_blocks, ranges
from argentum.session import stage

WINDOW = 2048
#: Length classes of a window that combinations are made of.
CLASSES = 256
#: Distinct chunks whose ids a task keeps from one block to the next.
KEEP_CHUNKS = 1_000_000
#: Strings joined for one call of the tokenizer.
JOINED = 1000

_LETTERS = np.zeros(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = True
_MARKS = np.zeros(256, bool)
_MARKS[np.frombuffer(b".,;:!?|*$%&#()\"", np.uint8)] = True


def _marks(vocabulary: str) -> tuple[np.ndarray, list[str]]:
    """Which ids end a word, and the added tokens."""
    told = json.loads(vocabulary)
    closing = np.zeros(max(told["model"]["vocab"].values()) + 2 + len(told["added_tokens"]), bool)
    suffix = told["model"]["end_of_word_suffix"]
    closing[[i for x, i in told["model"]["vocab"].items() if x.endswith(suffix)]] = True
    return closing, [x["content"] for x in told["added_tokens"]]


class Ids:
    """Token ids of blocks of texts; equal to the library's, which sees each distinct chunk once."""

    def __init__(self, vocabulary: str, closing: np.ndarray, added: list[str], end_id: int = 1, keep: int = KEEP_CHUNKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.end_id, self.keep = Tokenizer.from_str(vocabulary), end_id, keep
        self.closing = closing
        self.added = regex.compile(b"|".join(regex.escape(x).encode() for x in added))
        self.seen = np.zeros(0, np.uint64)
        self.ids, self.at, self.n = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Chunks, also cut between a letter and a punctuation mark, without their space in front."""
        start, _, _ = chunks(data, offsets)
        more = _LETTERS[data[:-1]] & _MARKS[data[1:]] | _MARKS[data[:-1]] & _LETTERS[data[1:]]
        bounds = np.zeros(len(data) + 1, bool)
        bounds[1:-1] = more
        for found in self.added.finditer(data.tobytes()):
            bounds[found.start() + 1 : found.end()] = False
        bounds[start] = bounds[offsets] = True
        bounds = np.flatnonzero(bounds)
        start, end = bounds[:-1], bounds[1:]
        text = np.searchsorted(offsets, start, side="right") - 1
        start = start + (data[start] == 0x20)
        full = end > start
        return start[full], end[full], text[full]

    def one_word(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Chunks of Latin letters only: one pre-token each."""
        accent = np.zeros(len(data), bool)
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        accent[lead] = accent[lead + 1] = True
        odd = np.append(0, np.cumsum(~(_LETTERS[data] | accent)))
        return odd[end] == odd[start]

    def encode(self, texts: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, and how many each has. `words` marks those of one pre-token."""
        lengths = np.zeros(len(texts), np.int64)
        plain = [texts[i] for i in np.flatnonzero(words)]
        joined = [" ".join(plain[k : k + JOINED]) for k in range(0, len(plain), JOINED)]
        ids = np.fromiter((i for x in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False) for i in x.ids), np.uint32)
        ends = np.flatnonzero(self.closing[ids]) + 1
        lengths[words] = np.diff(ends, prepend=0)
        odd = [x.ids for x in self.tokenizer.encode_batch_fast([texts[i] for i in np.flatnonzero(~words)], add_special_tokens=False)]
        lengths[~words] = [len(x) for x in odd]
        out = np.zeros(int(lengths.sum()), np.uint32)
        mine = np.repeat(words, lengths)
        out[mine] = ids
        out[~mine] = np.fromiter((i for x in odd for i in x), np.uint32)
        return out, lengths

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id behind it; ids per text)."""
        data, offsets = flat(texts)
        ids, counts = np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        if len(data):
            start, end, text = self.cut(data, offsets)
            words = self.one_word(data, start, end)
            lower = np.zeros(len(data), bool)
            lower[ranges(start[words], (end - start)[words])] = True
            folded = np.where(lower, LOWER[data], data)
            prints = fingerprints_of(folded, start, end)
            first, back = distinct(prints)
            prints = prints[first]
            at = np.minimum(np.searchsorted(self.seen, prints), max(len(self.seen) - 1, 0))
            new = self.seen[at] != prints if len(self.seen) else np.ones(len(prints), bool)
            if len(self.seen) + int(new.sum()) > self.keep:
                self.seen, self.ids, self.at, self.n, new = self.seen[:0], self.ids[:0], self.at[:0], self.n[:0], np.ones(len(prints), bool)
            raw = folded.tobytes()
            fresh = first[new]
            made, n = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(start[fresh].tolist(), end[fresh].tolist(), strict=True)], words[fresh])
            seen = np.concatenate([self.seen, prints[new]])
            order = np.argsort(seen)
            at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
            self.seen, self.at, self.n, self.ids = seen[order], at[order], np.concatenate([self.n, n])[order], np.concatenate([self.ids, made])
            place = np.searchsorted(self.seen, prints)[back]
            ids = self.ids[ranges(self.at[place], self.n[place])]
            counts = np.bincount(text, weights=self.n[place], minlength=len(counts)).astype(np.int64)
        out = np.full(len(ids) + len(counts), self.end_id, np.uint32)
        ends = np.cumsum(counts + 1) - 1
        body = np.ones(len(out), bool)
        body[ends] = False
        out[body] = ids
        return out, counts + 1


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: key, start, length, ids (uint32 as binary, on demand), ids_crc32, doc_tokens, and its rank `local` in (part, length)."""
    told = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    closing, added = _marks(told.value)
    kind = docs.schema[key].dataType.simpleString()

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part, met = Ids(told.value, closing, added, end_id), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        for block in parts:
            ids, counts = ids_of.of(block.column(1))
            n = -(-counts // window)
            doc = np.repeat(np.arange(len(counts)), n)
            k = ranges(np.zeros(len(n), np.int64), n)
            length = np.minimum(counts[doc] - k * window, window)
            begin = (np.cumsum(counts) - counts)[doc] + k * window
            raw = [ids[a : a + x].astype("<u4").tobytes() for a, x in zip(begin.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            runs = np.bincount(length, minlength=window + 1)
            local = np.zeros(len(length), np.int64)
            local[order] = np.arange(len(length)) - np.repeat(np.cumsum(runs) - runs, runs) + met[length[order]]
            met += runs
            columns = [block.column(0).take(pa.array(doc)), pa.array(k * window), pa.array(length), *([pa.array(raw, pa.binary())] if with_ids else []), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(counts[doc]), pa.array(np.full(len(doc), part)), pa.array(local)]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "start", "length", *(["ids"] if with_ids else []), "ids_crc32", "doc_tokens", "part", "local"])

    return map_blocks(docs.select(key, text), make, f"`{key}` {kind}, start long, length long, {'ids binary, ' if with_ids else ''}ids_crc32 long, doc_tokens long, part long, local long", text)


def combinations(classes: int = CLASSES, depth: int = 3) -> list[tuple[int, ...]]:
    """Class numbers that add up to `classes`: up to `depth` of them, and one repeated with a rest."""
    found = {(classes,)}
    if depth >= 2:
        found |= {(classes - a, a) for a in range(1, classes // 2 + 1)}
    if depth >= 3:
        found |= {tuple(sorted((a, b, classes - a - b), reverse=True)) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)}
    for a in range(1, classes // 4 + 1):
        many, rest = divmod(classes, a)
        found.add((a,) * many + ((rest,) if rest else ()))
    return sorted(found)


def non_negative_fit(combos: list[tuple[int, ...]], wanted: np.ndarray, steps: int = 1500) -> np.ndarray:
    """x >= 0 that brings sum of x times combination close to `wanted`, by accelerated projected gradient."""
    flat_classes = np.array([c for x in combos for c in x])
    sizes = np.array([len(x) for x in combos])
    at, owner = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(combos)), sizes)
    apply = lambda x: np.bincount(flat_classes, weights=x[owner], minlength=len(wanted))
    back = lambda r: np.add.reduceat(r[flat_classes], at)
    probe = np.ones(len(combos))
    for _ in range(20):  # power iteration for the largest curvature
        probe = back(apply(probe))
        size = np.linalg.norm(probe)
        probe /= size
    x = ahead = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, ahead + back(wanted - apply(ahead)) / (1.05 * size))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


@dataclass(frozen=True)
class Plan:
    """Where the pieces of a length go. Ranks below `fitted[length]` take class slots, the rest exact-length slots.

    A slot holds `copies` ranks from `rank` on, in sequences from `sequence` on.
    """

    fitted: np.ndarray
    longer: np.ndarray  # pieces of the class that are longer and so come first
    slots: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]  # group, rank, sequence, slot number
    n_sequences: int


def solve(histogram: np.ndarray, classes: int = CLASSES) -> Plan:
    """Plan the pieces; histogram[k] pieces have length k, up to the window's length."""
    window = len(histogram) - 1
    width = -(-window // classes)
    class_of = -(-np.arange(window + 1) // width)
    left = np.bincount(class_of, weights=histogram, minlength=classes + 1).astype(np.int64)
    fitted_classes = np.zeros(classes + 1, np.int64)
    group, rank, sequence, number = [], [], [], []
    n_sequences = 0
    combos = combinations(classes)
    counts = np.floor(non_negative_fit(combos, left.astype(float)) + 1e-6).astype(np.int64)
    for k in np.argsort(-counts, kind="stable"):
        kinds, times = np.unique(np.array(combos[k]), return_counts=True)
        n = min(int(counts[k]), int((left[kinds] // times).min()))
        if n <= 0:
            continue
        for slot, c in enumerate(sorted(combos[k], reverse=True)):
            group.append(c)
            rank.append(int(fitted_classes[c]))
            sequence.append(n_sequences)
            number.append(slot)
            fitted_classes[c] += n
            left[c] -= n
        n_sequences += n
    # within a class the longest pieces come first
    longer, fitted = np.zeros(window + 1, np.int64), np.zeros(window + 1, np.int64)
    total = np.zeros(classes + 1, np.int64)
    for length in range(window, 0, -1):
        c = class_of[length]
        longer[length] = total[c]
        fitted[length] = np.clip(fitted_classes[c] - total[c], 0, histogram[length])
        total[c] += histogram[length]
    for parts, n in best_fit(histogram - fitted, window):
        slot = 0
        for length, times in parts:
            for _ in range(times):
                group.append(classes + 1 + length)
                rank.append(None)
                sequence.append(n_sequences)
                number.append((slot, n))
                slot += 1
        n_sequences += n
    # ranks of the exact-length slots follow one another
    met = fitted.copy()
    for i, r in enumerate(rank):
        if r is None:
            length = group[i] - classes - 1
            rank[i] = int(met[length])
            slot, n = number[i]
            met[length] += n
            number[i] = slot
    order = np.lexsort((rank, group)) if group else np.zeros(0, int)
    table = tuple(np.array(x, np.int64)[order] for x in (group, rank, sequence, number))
    return Plan(fitted, longer, table, n_sequences)


def best_fit(counts: np.ndarray, window: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Pack counts of lengths, longest first, each into the fullest sequences that hold it.

    Sequences of equal content are kept together as (parts, how many), so that the work depends
    on the number of lengths and not on the number of pieces.
    """
    open_groups: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    for length in range(window, 0, -1):
        n = int(counts[length])
        for space in sorted(s for s in open_groups if s >= length):
            if not n:
                break
            kept = []
            for parts, many in open_groups.pop(space):
                fit = min(space // length, max(1, n // many)) if n else 0
                use = min(many, n // fit) if fit else 0
                if use:
                    open_groups.setdefault(space - fit * length, []).append(((*parts, (length, fit)), use))
                    n -= use * fit
                if many > use:
                    kept.append((parts, many - use))
            if kept:
                open_groups.setdefault(space, []).extend(kept)
        per = window // length
        if n >= per:
            open_groups.setdefault(window - per * length, []).append((((length, per),), n // per))
        if n % per:
            open_groups.setdefault(window - n % per * length, []).append((((length, n % per),), 1))
    return [x for space in sorted(open_groups) for x in open_groups[space]]


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """The pieces of all documents with sequence_id and offset; with `ids` (binary) on demand.

    Sequences are numbered from 0. A piece's rank in its length comes from counts per task,
    so that a length that a third of all pieces share is never gathered. Places are found
    without the ids, which then join them once.
    """
    made = stage(pieces(docs, vocabulary, window, end_id, key, text, with_ids), "pieces")
    per_part = made.groupBy("part", "length").count()
    histogram = np.zeros(window + 1, np.int64)
    for row in per_part.groupBy("length").agg(F.sum("count").alias("n")).collect():  # at most one row per length
        histogram[row["length"]] = row["n"]
    plan = solve(histogram)
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = made.drop("ids").join(offsets, ["part", "length"]).withColumn("rank", F.col("local") + F.col("before"))
    width, classes = -(-window // CLASSES), CLASSES
    group, rank, sequence, number = plan.slots

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint = group * (1 << 44) + rank
        for batch in batches:
            length, own = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            by_class = own < plan.fitted[length]
            kind = np.where(by_class, -(-length // width), classes + 1 + length)
            own = np.where(by_class, plan.longer[length] + own, own)
            at = np.searchsorted(joint, kind * (1 << 44) + own, side="right") - 1
            out = pa.Table.from_batches([batch]).append_column("sequence_id", pa.array(sequence[at] + own - rank[at])).append_column("slot", pa.array(number[at]))
            yield from out.to_batches()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields)
    placed = ranked.mapInArrow(place, f"{schema}, sequence_id long, slot long")
    earlier = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    placed = placed.withColumn("offset", F.coalesce(earlier, F.lit(0)))
    if with_ids:
        placed = placed.join(made.select("part", "length", "local", "ids"), ["part", "length", "local"])
    return placed.select(key, "start", "length", *(["ids"] if with_ids else []), "ids_crc32", "doc_tokens", "sequence_id", "offset")
