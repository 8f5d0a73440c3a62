"""Token counts of a byte-level BPE by rank-synchronous merging of ragged arrays.

A block of texts is cut into chunks at spaces where no pre-token can span; distinct chunks are
split into pre-tokens once, and distinct pre-tokens are held as one ragged array of symbols.
In every round each sequence applies its own lowest-rank pair, at all its places at once
(left to right where they overlap); sequences without a known pair leave. What is left of a
sequence are its tokens.

Strings of added tokens inside texts are one token each, as the library does by default. Null
and empty texts have no tokens. Rows are independent; repeated rows repeat.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from argentum.llm.words import chunks, distinct, fingerprints_of, flat, map_blocks, ranges

#: Counts of chunks that a task keeps from one block to the next.
KEEP_CHUNKS = 1_000_000
NONE = np.int64(1) << 40


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Pairs of symbols with their rank and the symbol that replaces them."""

    def __init__(self, vocabulary: str):
        told = json.loads(vocabulary)
        ids = told["model"]["vocab"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in told["model"]["merges"]]
        self.of_byte = np.zeros(256, np.int64)
        for char, byte in byte_symbols().items():
            self.of_byte[byte] = ids[char]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        made = np.array([ids[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], np.arange(len(pairs))[order], made[order]
        self.added = sorted((x["content"] for x in told["added_tokens"]), key=len, reverse=True)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if unknown) and new symbol of every pair."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), self.made[at]

    def count(self, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Symbols left of each sequence; `lengths` are at least 1."""
        out = lengths.astype(np.int64).copy()
        owner = np.flatnonzero(lengths > 1)
        symbols = symbols[np.repeat(lengths > 1, lengths)]
        lengths = lengths[owner]
        while len(owner):
            ends = np.cumsum(lengths)
            rank, made = np.full(len(symbols), NONE), np.zeros(len(symbols), np.int64)
            rank[:-1], made[:-1] = self.look_up(symbols[:-1], symbols[1:])
            rank[ends - 1] = NONE  # no pair across sequences
            lowest = np.minimum.reduceat(rank, ends - lengths)
            alive = lowest < NONE
            hit = (rank == np.repeat(lowest, lengths)) & (rank < NONE)
            # of places that touch, every second one counted from the first
            at = np.flatnonzero(hit)
            run = np.r_[True, np.diff(at) > 1] if len(at) else np.zeros(0, bool)
            first = at[run][np.cumsum(run) - 1] if len(at) else at
            at = at[(at - first) % 2 == 0]
            symbols[at] = made[at]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            gone = np.add.reduceat((~stay).astype(np.int64), ends - lengths)
            out[owner] -= gone
            keep = alive & (lengths - gone > 1)
            stay &= np.repeat(keep, lengths)
            symbols, owner, lengths = symbols[stay], owner[keep], (lengths - gone)[keep]
        return out


class Counter:
    """Counts tokens of blocks of texts; keeps the counts of chunks it has seen."""

    def __init__(self, vocabulary: str, pattern: str, keep: int = KEEP_CHUNKS):
        self.merges = Merges(vocabulary)
        self.pattern, self.keep = regex.compile(pattern), keep
        self.seen, self.seen_counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def pieces(self, parts: Sequence[str]) -> np.ndarray:
        """Tokens of strings that hold no added token."""
        found = [self.pattern.findall(x) for x in parts]
        per = np.array([len(x) for x in found], np.int64)
        return self.grouped([y for x in found for y in x], per)

    def grouped(self, tokens: list[str], per: np.ndarray) -> np.ndarray:
        data = np.frombuffer("".join(tokens).encode(), np.uint8)
        chars = np.fromiter(map(len, tokens), np.int64, len(tokens))
        begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        bounds = begins[np.append(0, np.cumsum(chars))]
        start, end = bounds[:-1], bounds[1:]
        first, back = distinct(fingerprints_of(data, start, end))
        lengths = (end - start)[first]
        counts = self.merges.count(self.merges.of_byte[data[ranges(start[first], lengths)]], lengths)
        sums = np.append(0, np.cumsum(counts[back]))
        ends = np.cumsum(per)
        return sums[ends] - sums[ends - per]

    def of_chunks(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of distinct chunks."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        plain: list[str] = []
        owner: list[int] = []
        added = np.zeros(len(texts), np.int64)
        special = regex.compile("|".join(map(regex.escape, self.merges.added))) if self.merges.added else None
        for k, text in enumerate(texts):
            if special is not None and special.search(text):
                added[k] = len(special.findall(text))
                cut = [x for x in special.split(text) if x]
                plain += cut
                owner += [k] * len(cut)
            else:
                plain.append(text)
                owner.append(k)
        if plain:
            np.add.at(added, np.array(owner), self.pieces(plain))
        return added

    def count(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, tokens) of each text."""
        data, offsets = flat(texts)
        totals = np.zeros(len(offsets) - 1, np.int64)
        if len(data):
            start, end, text = chunks(data, offsets)
            prints = fingerprints_of(data, start, end)
            first, back = distinct(prints)
            prints = prints[first]
            at = np.minimum(np.searchsorted(self.seen, prints), max(len(self.seen) - 1, 0))
            known = self.seen[at] == prints if len(self.seen) else np.zeros(len(prints), bool)
            counts = np.zeros(len(prints), np.int64)
            counts[known] = self.seen_counts[at[known]]
            new = ~known
            counts[new] = self.of_chunks(data, start[first[new]], end[first[new]])
            if len(self.seen) + int(new.sum()) > self.keep:
                self.seen, self.seen_counts, new = self.seen[:0], self.seen_counts[:0], np.ones(len(prints), bool)
            joined = np.concatenate([self.seen, prints[new]])
            order = np.argsort(joined)
            self.seen, self.seen_counts = joined[order], np.concatenate([self.seen_counts, counts[new]])[order]
            totals = np.bincount(text, weights=counts[back], minlength=len(totals)).astype(np.int64)
        return np.diff(offsets), totals


def count_tokens(docs: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """Key, n_bytes, n_tokens and over_limit (n_tokens > limit) per document.

    `vocabulary` is the path of a byte-level BPE in the JSON form of the tokenizers library,
    read once on the driver and broadcast: its size doesn't depend on the documents.
    """
    told = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    kind = docs.schema[key].dataType.simpleString()

    def make(parts):
        counter = Counter(told.value, pattern)
        for part in parts:
            n_bytes, n_tokens = counter.count(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_bytes), pa.array(n_tokens), pa.array(n_tokens > limit)], names=[key, "n_bytes", "n_tokens", "over_limit"])

    return map_blocks(docs.select(key, text), make, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean", text)
