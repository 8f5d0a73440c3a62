"""Normal form of a text, with the way back to its characters: the per-text helper of Arrow jobs.

Four switches: lower case, accents, quotes, pollution (separator lines and the like). Most characters
keep their place; `breaks` lists the places of the normal form where the way back
jumps: from `at` on, the source runs on from `source`, one character for one, to the next break.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: typographic quotes and their plain forms
QUOTES = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "`": "'", "´": "'", "“": '"', "”": '"', "„": '"', "«": '"', "»": '"', "″": '"'}
# fixed values: ligatures and their letters
LIGATURES = {"œ": "oe", "æ": "ae", "Œ": "OE", "Æ": "AE"}
_MARKS = r"̀-ͯ"
_RESIZED = re.compile(f"[{_MARKS}{''.join(LIGATURES)}]")
_MARK = re.compile(f"[{_MARKS}]")
_POLLUTION = re.compile(r"(?<!\S)[=_*#~\-]{4,}(?!\S)\s*")


class Normal(NamedTuple):
    """Which parts of the normal form apply."""

    lowercase: bool = False
    accents: bool = False
    quotes: bool = False
    pollution: bool = True


class _Table(dict):
    """What each code point becomes; filled as characters are met."""

    def __init__(self, normal: Normal):
        self.normal = normal

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if self.normal.quotes:
            c = QUOTES.get(c, c)
        if self.normal.accents:
            if c in LIGATURES:
                c = LIGATURES[c]
            elif _MARK.match(c):
                c = ""
            else:
                parts = unicodedata.normalize("NFD", c)
                c = parts[0] if len(parts) > 1 and all(_MARK.match(x) for x in parts[1:]) else c
        if self.normal.lowercase:
            c = "".join(x.lower() if len(x.lower()) == 1 else x for x in c)
        self[point] = c
        return c


_TABLES: dict[Normal, _Table] = {}


def _table(normal: Normal) -> _Table:
    if normal not in _TABLES:
        _TABLES[normal] = _Table(normal)
    return _TABLES[normal]


def normalise(text: str, normal: Normal) -> tuple[str, list[tuple[int, int]]]:
    """The normal form and its breaks (at, source); the first is (0, 0)."""
    table = _table(normal)
    jumps = [(m.start(), m.end()) for m in _POLLUTION.finditer(text)] if normal.pollution else []
    if normal.accents:
        jumps += [(m.start(), m.end()) for m in _RESIZED.finditer(text)]
    if not jumps:
        return text.translate(table), [(0, 0)]
    out, breaks, size, done = [], [(0, 0)], 0, 0
    for start, end in sorted(jumps):
        if start < done:  # a mark inside a separator
            continue
        kept = text[done:start].translate(table)
        put = text[start:end].translate(table) if end == start + 1 else ""
        out += [kept, put]
        size += len(kept)
        # the letters of a ligature all come from it; what follows comes from behind it
        breaks += [(size + k, start) for k in range(1, len(put))]
        size += len(put)
        breaks.append((size, end))
        done = end
    out.append(text[done:].translate(table))
    return "".join(out), breaks


def source_place(breaks: list[tuple[int, int]], at: int) -> int:
    """Place in the source of a place in the normal form."""
    from_, source = breaks[bisect_right(breaks, at, key=lambda b: b[0]) - 1]
    return source + at - from_


def source_offset(breaks: Column, at: Column) -> Column:
    """`source_place` as a column, null ahead of the text; `breaks` is an array of (at, source)."""
    last = F.try_element_at(F.filter(breaks, lambda b: b["at"] <= at), F.lit(-1))
    return last["source"] + at - last["at"]
