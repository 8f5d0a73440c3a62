"""Date mentions of one text with their context windows: the per-row helper of the Arrow job.

The same windows can be written as nested array expressions, but those run interpreted
in Spark and took about four times as long; see the README for the measurement.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Collection, Iterator, Set
from itertools import accumulate, repeat
from typing import NamedTuple

from argentum.functions.normal import Normal, normalise, source_place
from argentum.functions.text import (
    ABBREVIATIONS,
    AHEAD,
    AHEAD_PATTERN,
    BETWEEN_PATTERN,
    LIST_PATTERN,
    NUMBER_PATTERN,
    NUMBER_WORDS,
    OPENING,
    POLLUTION_PATTERN,
    STOP_PATTERN,
    TOKEN_PATTERN,
)

_TOKEN = re.compile(TOKEN_PATTERN)
_NUMBER = re.compile(NUMBER_PATTERN)
_POLLUTION = re.compile(POLLUTION_PATTERN)
_SIGNS = frozenset("=_*#~-")
#: What every pollution token begins with: most texts have none.
_POLLUTED = re.compile(r"[=_*#~\-]{4}")
_STOP = re.compile(STOP_PATTERN)
_LIST = re.compile(LIST_PATTERN)
_AHEAD = re.compile(AHEAD_PATTERN)
_BETWEEN = re.compile(BETWEEN_PATTERN)
_LEAD = re.compile(r"\s*")
_NUMBER_TOKENS = {w + s for w in (*NUMBER_WORDS, "zéro", "million", "milliard") for s in ("", "s")}


class Mention(NamedTuple):
    lexical_variant: str
    text_start_char: int
    text_end_char: int
    excluded: bool
    span: str | None
    span_start_char: int | None
    span_end_char: int | None
    date_text: str
    end_variant: str | None = None
    end_start_char: int | None = None
    end_end_char: int | None = None


class Options(NamedTuple):
    """How windows are cut."""

    n_before: int
    n_after: int
    ignore_excluded: bool
    attr: str
    mode: str
    abbreviations: Collection[str] = ABBREVIATIONS
    normal: Normal | None = None
    #: Without, no window is cut and the fields of the snippet are None.
    snippets: bool = True


def _is_number(token: str) -> bool:
    # most tokens begin with a letter and are no numeral
    if token[0].isalpha() and token.rstrip().lower() not in _NUMBER_TOKENS:
        return False
    return bool(_NUMBER.match(token))


def _outer_tokens(text: str, start: int, end: int) -> list[str]:
    """The first and the last token of a stretch of text; the same one if it has no other."""
    tokens = text[start:end].split(None, 1)
    return tokens if len(tokens) < 2 else [tokens[0], tokens[1].rsplit(None, 1)[-1]]


def ends_sentence(token: str, following: str | None, abbreviations: Collection[str]) -> bool:
    """Whether a sentence ends with a token (with its trailing white space), seen the token that follows.

    A blank line ends it, and so does a line break ahead of a capital, a sign or a line of a
    list; other line breaks are wrapped lines. Punctuation ends it if white space follows. A full stop
    doesn't after an abbreviation or a single letter, or ahead of a small letter.
    """
    if following is None:
        return False
    body = token.rstrip()
    space = token[len(body) :]
    lead = following[0]
    if "\n" in space and (space.count("\n") > 1 or lead.isupper() or not lead.isalnum() or _LIST.match(following)):
        return True
    stop = _STOP.search(body)
    if not stop or not space:
        return False
    if any(c in stop.group() for c in "!?…"):
        return True
    if lead.islower():
        return False
    word = body.lstrip(OPENING)
    return not (word.endswith(".") and ((len(word) == 2 and word[0].isalpha()) or word[:-1].lower() in abbreviations))


def find_mentions(text: str, pattern: re.Pattern, options: Options) -> Iterator[Mention]:
    """Mentions of `pattern`; windows count tokens or sentences, excluded dates left out on request.

    With a normal form the pattern is searched there and the snippets are cut from it, while
    the offsets of a mention and its lexical variant are those of the source.
    """
    return map(Mention._make, mention_rows(text, pattern, options))


def mention_rows(text: str, pattern: re.Pattern, options: Options, only: Set[tuple[int, int]] | None = None) -> Iterator[tuple]:
    """As `find_mentions`, each mention as a plain tuple of its fields, which costs the Arrow job less.

    With `only`, just the mentions with these offsets; the others still shape their windows.
    """
    if options.normal is None:
        yield from _find(text, pattern, options, only)
        return
    form, breaks = normalise(text, options.normal)
    for m in map(Mention._make, _find(form, pattern, options._replace(attr="TEXT"))):
        start, end = source_place(breaks, m.text_start_char), source_place(breaks, m.text_end_char - 1) + 1
        if only is not None and (start, end) not in only:
            continue
        found = m._replace(lexical_variant=text[start:end], text_start_char=start, text_end_char=end)
        if m.end_variant is not None:
            found = found._replace(end_start_char=source_place(breaks, m.end_start_char), end_end_char=source_place(breaks, m.end_end_char - 1) + 1)
        yield tuple(found)


def _find(text: str, pattern: re.Pattern, options: Options, only: Set[tuple[int, int]] | None = None) -> Iterator[tuple]:
    n_before, n_after, ignore_excluded, attr, mode, abbreviations, _, snippets = options
    # a hit is also a match at its own place, which is much cheaper to try than to search the text
    if only is not None and not any(0 <= start and (h := pattern.match(text, start)) and h.end() == end for start, end in only):
        return
    hits = [(*h.span(), h.group()) for h in pattern.finditer(text)]
    wanted = [only is None or (start, end) in only for start, end, _ in hits]
    if not any(wanted):
        return
    # gaps[k] lies before hits[k]; whitespace right after a hit belongs to the hit
    edges = [0] + [_LEAD.match(text, end).end() for _, end, _ in hits]
    starts = [start for start, _, _ in hits] + [len(text)]
    gaps = list(map(_TOKEN.findall if snippets else _outer_tokens, repeat(text), edges, starts))

    excluded = []
    for k, left in enumerate(gaps[:-1]):
        right = gaps[k + 1]
        from_left = _is_number(left[-1]) if left else k > 0 and hits[k - 1][2][-1].isdigit()
        from_right = _is_number(right[0]) if right else k + 1 < len(hits) and hits[k + 1][2][0].isdigit()
        excluded.append(from_left or from_right)

    def period(k: int) -> tuple:
        """The date that ends the period which hit `k` begins, with its offsets."""
        start, stop, _ = hits[k]
        # most dates don't begin one: the cheap tests come first, and one or two words stand between its dates
        if k + 1 < len(hits) and 0 < len(gaps[k + 1]) < 3 and starts[k + 1] - stop < 40 and _BETWEEN.match(text[stop : starts[k + 1]]) and _AHEAD.search(text[max(0, start - AHEAD) : start]):
            return hits[k + 1][2], *hits[k + 1][:2]
        return None, None, None

    if not snippets:
        for k, (start, stop, middle) in enumerate(hits):
            if wanted[k]:
                yield middle, start, stop, excluded[k], None, None, None, middle, *period(k)
        return

    # the token stream, and the place of every mention in it
    stream: list[str] = []
    places = []
    polluted = attr == "NORM" and _POLLUTED.search(text)
    for k, tokens in enumerate(gaps):
        stream += [t for t in tokens if t[0] not in _SIGNS or not _POLLUTION.match(t)] if polluted else tokens
        if k < len(hits):
            places.append(len(stream))
            if not (ignore_excluded and excluded[k]):
                stream.append(text[starts[k] : edges[k + 1]])
    # sentences[i]: number of sentence ends ahead of token i
    sentences = [0]
    if mode == "sentence":
        for token, following in zip(stream, [*stream[1:], None]):
            sentences.append(sentences[-1] + ends_sentence(token, following, abbreviations))
    # windows are cut from the joined stream: token i is kept[at[i] : at[i + 1]]
    kept, at = "".join(stream), list(accumulate(map(len, stream), initial=0))

    for k, (start, stop, middle) in enumerate(hits):
        if not wanted[k]:
            continue
        place, edge = places[k], edges[k + 1]
        behind = place + (not (ignore_excluded and excluded[k]))
        if mode == "token":
            first, last = max(place - n_before, 0), min(behind + n_after, len(stream))
        else:
            here = sentences[place]
            first = bisect_left(sentences, here - n_before, 0, place)
            last = max(bisect_right(sentences, here + n_after, 0, len(stream)), behind)
        before, after = kept[at[first] : at[place]], text[stop:edge] + kept[at[behind] : at[last]]
        if attr == "LOWER":
            before, after = before.lower(), after.lower()
        span = (before + (middle.lower() if attr == "LOWER" else middle) + after).rstrip()
        begins = len(before)
        ends = begins + (len(middle.lower()) if attr == "LOWER" else stop - start)
        yield middle, start, stop, excluded[k], span, begins, ends, middle, *period(k)
