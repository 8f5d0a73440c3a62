"""Licence texts in files, by matching statistics against a generalised suffix automaton.

The automaton holds the words of all templates. A file's words are streamed through it: the
state and length after each word tell, by way of suffix links for every template, the longest run of
words ending there that the template has. Runs that the next word doesn't extend are chained, per
template and in template order: of runs that overlap, the later one counts without the overlap, and
the chain that covers most of the template is found by dynamic programming. Chains are the spans;
the score of a file is the largest share of a template that one span covers. Phrases that are
templates of their own give the base labels.

A file's words that are in no template pair of neighbours never enter the automaton: a numpy
look-up of word pairs leaves only stretches that can match two words or more.

Phrases have two words or more. Null and empty texts have no words, no label and a score of 0. Rows are independent; repeated
rows repeat; extra columns are ignored.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from argentum.llm.words import ALNUM, LOWER, Words, flat, map_blocks

# Phrases and labels of the corpus contract.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Wording of public licence notices, as their publishers give it.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "Released under the MIT License"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc", "Licensed under CC BY 4.0"),
    ("cc", "Licensed under CC BY-SA 4.0"),
    ("cc-nc", "Licensed under CC BY-NC 4.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

# Whole texts of public licences, as their publishers give them.
TEXTS = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
        LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION
        OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
        INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER
        IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
        with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS
        OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,
        INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF
        SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN
        ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
        following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you
        wrote the original software. If you use this software in a product, an acknowledgment in the product documentation
        would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    ),
)
TEMPLATES = NOTICES + TEXTS

#: Words of a match that counts as long, or the whole template if that is shorter.
LONG = 5
#: Words between two matches of one span, in the file and in the template.
GAP = 8
#: Share of a template that a span covers for the template's label.
SHARE = 0.8


def word_fingerprints(texts: Sequence[str | None] | pa.Array) -> tuple[Words, np.ndarray]:
    data, offsets = flat(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    words = Words(LOWER[data], offsets, ALNUM)
    return words, words.fingerprints()


@dataclass
class State:
    length: int
    link: int
    next: dict[int, int] = field(default_factory=dict)


class Automaton:
    """Generalised suffix automaton of symbol sequences; of each state, where its text ends in each sequence."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.states = [State(0, -1)]
        for sequence in sequences:
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
        #: by sequence, the ends of all occurrences of the state's texts
        self.ends: list[dict[int, list[int]]] = [{} for _ in self.states]
        for n, sequence in enumerate(sequences):
            at = 0
            for i, symbol in enumerate(sequence):
                at = up = self.states[at].next[symbol]
                while up > 0:
                    self.ends[up].setdefault(n, []).append(i + 1)
                    up = self.states[up].link

    def longest(self, at: int) -> list[tuple[int, int, list[int]]]:
        """(sequence, most words, ends) of the longest suffix of the state's texts that each sequence has."""
        found, up = {}, at
        while up > 0:
            for n, ends in self.ends[up].items():
                found.setdefault(n, (self.states[up].length, ends))
            up = self.states[up].link
        return [(n, *x) for n, x in sorted(found.items())]

    def _extend(self, last: int, symbol: int) -> int:
        known = self.states[last].next.get(symbol)
        if known is not None:
            if self.states[known].length == self.states[last].length + 1:
                return known
            return self._split(last, symbol, known)
        new = len(self.states)
        self.states.append(State(self.states[last].length + 1, 0))
        at = last
        while at >= 0 and symbol not in self.states[at].next:
            self.states[at].next[symbol] = new
            at = self.states[at].link
        if at >= 0:
            known = self.states[at].next[symbol]
            fits = self.states[known].length == self.states[at].length + 1
            self.states[new].link = known if fits else self._split(at, symbol, known)
        return new

    def _split(self, at: int, symbol: int, known: int) -> int:
        copy = len(self.states)
        self.states.append(State(self.states[at].length + 1, self.states[known].link, dict(self.states[known].next)))
        self.states[known].link = copy
        while at >= 0 and self.states[at].next.get(symbol) == known:
            self.states[at].next[symbol] = copy
            at = self.states[at].link
        return copy

    def stream(self, symbols: Sequence[int]) -> Iterator[tuple[int, int]]:
        """Matching statistics: (state, length of the longest match ending here) after each symbol."""
        states, at, length = self.states, 0, 0
        for symbol in symbols:
            while at and symbol not in states[at].next:
                at = states[at].link
                length = states[at].length
            if symbol in states[at].next:
                at = states[at].next[symbol]
                length += 1
            yield at, length


class Scanner:
    """Finds labels in texts."""

    def __init__(self, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = TEMPLATES):
        self.labels = [label for _, label in phrases] + [label for label, _ in notices]
        self.n_phrases = len(phrases)
        if any(len(x.split()) < 2 for x, _ in phrases):
            raise ValueError("a phrase needs two words or more")
        words, prints = word_fingerprints([x for x, _ in phrases] + [x for _, x in notices])
        self.vocabulary = np.unique(prints)
        symbols = np.searchsorted(self.vocabulary, prints)
        self.templates = [symbols[a:b].tolist() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        self.pairs = np.unique([a * len(self.vocabulary) + b for t in self.templates for a, b in zip(t, t[1:], strict=False)])
        self.automaton = Automaton(self.templates)
        # phrases that a state's text ends with, by way of suffix links
        whole = {}
        for n, template in enumerate(self.templates[: self.n_phrases]):
            at = 0
            for symbol in template:
                at = self.automaton.states[at].next[symbol]
            whole.setdefault(at, []).append(n)
        self.phrases_at = []
        for at in range(len(self.automaton.states)):
            found, up = [], at
            while up > 0:
                found += whole.get(up, [])
                up = self.automaton.states[up].link
            self.phrases_at.append(found)
        self.long = [min(LONG, len(t)) for t in self.templates]
        self.matches_at = [[x for x in self.automaton.longest(at) if x[0] >= self.n_phrases and x[1] >= self.long[x[0]]] for at in range(len(self.automaton.states))]

    def symbols(self, prints: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.vocabulary, prints), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == prints, at, -1)

    def stretches(self, words: Words, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols, and the (start, end) of runs of words whose every two neighbours stand so in a template."""
        symbols = self.symbols(prints)
        joint = symbols[:-1] * len(self.vocabulary) + symbols[1:]
        same = words.text[:-1] == words.text[1:]
        pair = same & (symbols[:-1] >= 0) & (symbols[1:] >= 0) & np.isin(joint, self.pairs)
        edge = np.diff(np.concatenate([[0], pair.astype(np.int8), [0]]))
        return symbols, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1

    def scan(self, texts: pa.Array) -> list[dict]:
        """One dict per text: n_words, places (phrase, first word), spans (label, first and last word, template share)."""
        words, prints = word_fingerprints(texts)
        out = [{"n_words": int(n), "places": [], "spans": []} for n in words.counts]
        symbols, starts, ends = self.stretches(words, prints)
        matches: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # text: (template, end in template, end in file, length)
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            text = int(words.text[start])
            base = start - int(words.first[text])
            seen = list(self.automaton.stream(symbols[start:end].tolist()))
            for k, (at, length) in enumerate(seen):
                for n in self.phrases_at[at]:
                    if length >= len(self.templates[n]):
                        out[text]["places"].append((n, base + k + 1 - len(self.templates[n])))
                if not self.matches_at[at]:
                    continue
                # a match that the next word extends is part of a longer one
                after = {n: min(seen[k + 1][1], most) for n, most, _ in self.matches_at[seen[k + 1][0]]} if k + 1 < len(seen) else {}
                for n, most, stops in self.matches_at[at]:
                    own = min(length, most)
                    if own >= self.long[n] and after.get(n) != own + 1:
                        matches[text] += [(n, stop, base + k + 1, own) for stop in stops]
        for text, found in matches.items():
            out[text]["spans"] = self.chain(found)
        return out

    def chain(self, matches: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Spans of each template: chains of matches that follow one another in file and template.

        Spans of a template don't overlap in the file: the chain that covers most comes first, and
        others end where they would meet it.
        """
        by_template = defaultdict(list)
        for n, stop, end, length in matches:
            by_template[n].append((end, stop, length))
        spans = []
        for n, found in sorted(by_template.items()):
            found.sort()
            taken: list[tuple[int, int]] = []
            covered, before, order = best_chains(found)
            for i in order:
                end, first, at = found[i][0], i, before[i]
                if not _apart(taken, end - found[i][2], end):
                    continue
                while at >= 0 and _apart(taken, found[at][0] - found[at][2], end):
                    first, at = at, before[at]
                start = found[first][0] - found[first][2]
                bisect.insort(taken, (start, end))
                words = covered[i] - covered[first] + found[first][2]
                spans.append((self.labels[n], start, end, words / len(self.templates[n])))
        return sorted(spans, key=lambda s: (s[1], s[2], s[0], s[3]))


def best_chains(found: list[tuple[int, int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Of matches (end in file, end in template, words), sorted: words covered by the best chain up to each,
    its predecessor (or -1), and all matches, the one that ends the best chain first.

    A match follows another if, without the words that overlap in the file or in the template, some of it is left and
    at most GAP words lie between the two on either side.
    """
    covered, before = [x[2] for x in found], [-1] * len(found)
    for i, (end, stop, length) in enumerate(found):
        for j in range(i - 1, -1, -1):
            end_j, stop_j, _ = found[j]
            if end - length - end_j > GAP:
                break
            new = min(length, end - end_j, stop - stop_j)
            if new > 0 and end - new - end_j <= GAP and stop - new - stop_j <= GAP and covered[j] + new > covered[i]:
                covered[i], before[i] = covered[j] + new, j
    return covered, before, sorted(range(len(found)), key=lambda i: (-covered[i], i))


def _apart(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a range meets none of the disjoint ranges."""
    at = bisect.bisect_left(taken, (start, start))
    return (at == len(taken) or taken[at][0] >= end) and (at == 0 or taken[at - 1][1] <= start)


SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label:string,start:long,end:long,share:double>>"
)


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Key, the counts and labels of the contract, and the covered template spans (words from `start` up to `end`)."""
    kind = docs.schema[key].dataType.simpleString()

    def make(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        names = lambda labels: ",".join(sorted(set(labels)))
        for block in parts:
            rows = []
            for found in scanner.scan(block.column(1)):
                places = [at for _, at in found["places"]]
                base = [scanner.labels[n] for n, _ in found["places"]]
                covered = [label for label, _, _, share in found["spans"] if share >= SHARE]
                rows.append(
                    {
                        "n_words": found["n_words"],
                        "n_base": len(places),
                        "first_word": min(places, default=None),
                        "last_word": max(places, default=None),
                        "base_labels": names(base),
                        "labels": names(base + covered),
                        "score": 1.0 if base else max((s[3] for s in found["spans"]), default=0.0),
                        "spans": [dict(zip(("label", "start", "end", "share"), s, strict=True)) for s in found["spans"]],
                    }
                )
            made = pa.Table.from_pylist(rows, schema=pa.schema(_FIELDS))
            yield pa.RecordBatch.from_arrays([block.column(0), *[c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in made.columns]], names=[key, *made.column_names])

    return map_blocks(docs.select(key, text), make, f"`{key}` {kind}, {SCHEMA}", text)


_FIELDS = [
    ("n_words", pa.int64()),
    ("n_base", pa.int64()),
    ("first_word", pa.int64()),
    ("last_word", pa.int64()),
    ("base_labels", pa.string()),
    ("labels", pa.string()),
    ("score", pa.float64()),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
]
