"""Documents to rows: date mentions, periods and pathology codes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argentum.functions.columns import localise
from argentum.functions.normal import Normal, normalise
from argentum.functions.snippets import Options, mention_rows
from argentum.functions.text import ABBREVIATIONS, CODE_PARTS, CODE_PATTERN, DATE_HINT, DATE_PATTERN, find_codes, parse_common, parse_date
from argentum.session import is_small, let

MENTION_FIELDS = T.StructType(
    [
        T.StructField("lexical_variant", T.StringType()),
        T.StructField("text_start_char", T.IntegerType()),
        T.StructField("text_end_char", T.IntegerType()),
        T.StructField("excluded", T.BooleanType()),
        T.StructField("span", T.StringType()),
        T.StructField("span_start_char", T.IntegerType()),
        T.StructField("span_end_char", T.IntegerType()),
        T.StructField("date_text", T.StringType()),
        T.StructField("end_variant", T.StringType()),
        T.StructField("end_start_char", T.IntegerType()),
        T.StructField("end_end_char", T.IntegerType()),
    ]
)
_ARROW_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32()]
#: Fields that only a snippet has.
_SNIPPET = ("span", "span_start_char", "span_end_char")
#: What a date is parsed from.
_DATED = ("date_text", "end_variant", "excluded")
#: Snippet characters per output batch, so that dense texts do not build up in a worker.
BATCH_CHARS = 16_000_000


def _fields(options: Options) -> list[str]:
    """Fields that a mention has by its options."""
    return [c for c in MENTION_FIELDS.names if options.snippets or c not in _SNIPPET]


def _columns(found: list[tuple], names: Sequence[str]) -> list[pa.Array]:
    values = list(zip(*found)) if found else [()] * len(_ARROW_TYPES)
    return [pa.array(v, t) for v, t, c in zip(values, _ARROW_TYPES, MENTION_FIELDS.names) if c in names]


def _nested(found: list[tuple], sizes: list[int], names: Sequence[str]) -> pa.Array:
    """One list of structs per row."""
    kept = [c for c in MENTION_FIELDS.names if c in names]
    columns = dict(zip(kept, _columns(found, kept)))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([columns[n] for n in names], names=list(names)))


#: The numeric form of `text.parse_date` that needs neither the note's day nor another date.
_COMMON = re.compile(r"([0-9]{1,2})[/.\-]([0-9]{1,2})[/.\-]([0-9]{4})")


def _alone(found: list[tuple], ignore_excluded: bool) -> list[tuple] | None:
    """The mentions whose date occurs once, if every date of the note is of the common form; else None.

    Two common dates are the same day exactly if their numbers are. Mentions that get no date don't count.
    """
    at = MENTION_FIELDS.names.index("date_text")
    seen: dict[int, tuple | None] = {}
    for m in found:
        if ignore_excluded and m[3]:
            continue
        parts = _COMMON.fullmatch(m[at])
        if parts is None:
            return None
        day, month, year = parts.groups()
        key = (int(year) * 100 + int(month)) * 100 + int(day)
        seen[key] = None if key in seen else m
    return [m for m in seen.values() if m]


def _offsets(spans: pa.ListArray) -> Iterator[set[tuple[int, int]]]:
    """The pairs (start, end) of each row; pairs that lack one, and null rows, have no place."""
    fields = spans.flatten()
    pairs = list(zip(fields.field("start").to_pylist(), fields.field("end").to_pylist()))
    ends = np.cumsum([n or 0 for n in spans.value_lengths().to_pylist()], dtype=np.int64).tolist()
    return ({p for p in pairs[a:b] if None not in p} for a, b in zip([0, *ends], ends))


def _mention_batches(pattern: str, carried: list[str], options: Options, only: str | None = None):
    """The Arrow job: batches of notes in, batches of mentions out."""
    names = _fields(options)

    def flush(batch: pa.RecordBatch, rows: list[int], found: list[tuple]) -> pa.RecordBatch:
        columns = [batch.column(c).take(pa.array(rows, pa.int32())) for c in carried]
        return pa.RecordBatch.from_arrays([*columns, *_columns(found, names)], names=[*carried, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = re.compile(pattern)
        for batch in batches:
            rows, found, size = [], [], 0
            texts = batch.column("note_text").to_pylist()
            places = repeat(None) if only is None else _offsets(batch.column(only))
            for row, (text, at) in enumerate(zip(texts, places)):
                for mention in () if text is None else mention_rows(text, compiled, options, at):
                    rows.append(row)
                    found.append(mention)
                    size += len(mention[4] or mention[0])
                    if size > BATCH_CHARS:
                        yield flush(batch, rows, found)
                        rows, found, size = [], [], 0
            if found:
                yield flush(batch, rows, found)

    return run


def _note_batches(pattern: str, carried: list[str], options: Options, count: bool = True):
    """Batches of notes in, one row per note out: `dates`, all of its dates, and `mentions`.

    The mentions of a note with very long snippets come in several rows, from the position
    `first` on, each with all dates of the note, which are narrow.

    With `count`, notes that have dates of the common form only come without `dates`, and `mentions`
    are those whose date occurs once.
    """
    names = _fields(options)

    def flush(batch: pa.RecordBatch, rows: list[tuple[int, int, list, list]]) -> pa.RecordBatch:
        columns = [batch.column(c).take(pa.array([r[0] for r in rows], pa.int32())) for c in carried]
        dates = _nested([m for r in rows for m in r[2] or ()], [len(r[2] or ()) for r in rows], _DATED)
        mentions = _nested([m for r in rows for m in r[3]], [len(r[3]) for r in rows], names)
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[1] for r in rows], pa.int32()), dates, mentions], names=[*carried, "first", "dates", "mentions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, narrow = re.compile(pattern), options._replace(snippets=False)
        for batch in batches:
            rows, size = [], 0
            for row, text in enumerate(batch.column("note_text").to_pylist()):
                part, first, dates, k = [], 0, None, -1
                for k, mention in enumerate(() if text is None else mention_rows(text, compiled, options)):
                    part.append(mention)
                    size += len(mention[4] or mention[0])
                    if size > BATCH_CHARS:
                        dates = dates or list(mention_rows(text, compiled, narrow))
                        yield flush(batch, [*rows, (row, first, dates, part)])
                        rows, size, part, first = [], 0, [], k + 1
                alone = _alone(part, options.ignore_excluded) if part and count and dates is None else None
                if alone:
                    rows.append((row, first, None, alone))
                elif part and alone is None:
                    rows.append((row, first, dates or part, part))
            if rows:
                yield flush(batch, rows)

    return run


def _parsed(m: dict[str, Column] | Column, noted: Column | None, tz: str | None, ignore_excluded: bool) -> Column:
    """The day of a mention, or the first day of the period that it begins."""
    day = localise(parse_date(m["date_text"], noted, m["end_variant"]), tz)
    return F.when(~m["excluded"], day) if ignore_excluded else day


def _once(days: Column) -> Column:
    """For each element whether its value is there and occurs once."""
    sorted_days = F.array_sort(F.transform(days, lambda d, i: F.struct(d.alias("d"), i.alias("i"))))

    def alone(rows: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(rows, j)["d"] == x["d"], F.lit(False))
        return F.transform(rows, lambda x, j: F.struct(x["i"].alias("i"), (x["d"].isNotNull() & ~same(x, j - 1) & ~same(x, j + 1)).alias("once")))

    return F.transform(F.array_sort(let(sorted_days, alone)), lambda x: x["once"])


def _found(notes: DataFrame, keep: Sequence[str], options: Options, tz: str | None, pattern: str, once: bool, only: str | None = None) -> DataFrame:
    """Mentions with all fields and `date_dt`; columns `keep` and the note's time are carried along."""
    attr = options.attr.upper()
    if options.mode not in ("token", "sentence") or attr not in ("TEXT", "NORM", "LOWER"):
        raise ValueError(f"unknown mode or attribute: {options.mode}, {attr}")
    options = options._replace(attr=attr)
    dated = "note_datetime" in notes.columns
    carried = list(dict.fromkeys([*[c for c in keep if c in notes.columns], *(["note_datetime"] if dated else [])]))
    text = F.col("note_text")
    if pattern == DATE_PATTERN:
        # other texts needn't leave the JVM; a digit is found sooner than a word. Not a filter: that would
        # move below whatever makes the text, and make it again for each condition, ahead of its spreading
        text = F.when(text.rlike("[0-9]") | text.rlike(DATE_HINT), text)
    places = [only] if only and only not in carried else []
    narrow = notes.select(*carried, *places, text.alias("note_text"))
    noted = F.col("note_datetime") if dated else None
    own = [narrow.schema[c] for c in carried]
    fields = [MENTION_FIELDS[c] for c in _fields(options)]
    if not once:
        found = narrow.mapInArrow(_mention_batches(pattern, carried, options, only), T.StructType(own + fields))
        return found.withColumn("date_dt", _parsed({c: F.col(c) for c in _DATED}, noted, tz, options.ignore_excluded))
    dates = T.ArrayType(T.StructType([MENTION_FIELDS[c] for c in _DATED]))
    schema = T.StructType([*own, T.StructField("first", T.IntegerType()), T.StructField("dates", dates), T.StructField("mentions", T.ArrayType(T.StructType(fields)))])
    # a zone may give two days the same instant, so with one dates are counted after that
    found = narrow.mapInArrow(_note_batches(pattern, carried, options, tz is None), schema)
    days = F.transform("dates", lambda m: _parsed(m, noted, tz, options.ignore_excluded))

    def kept(days: Column) -> Column:
        rows = lambda alone: F.transform("mentions", lambda m, i: F.when(F.get(alone, F.col("first") + i), F.struct(m.alias("m"), F.get(days, F.col("first") + i).alias("date_dt"))))
        return F.filter(let(_once(days), rows), lambda x: x.isNotNull())

    counted = F.size("dates") == 0
    single = F.transform("mentions", lambda m: F.struct(m.alias("m"), F.lit(None).cast("timestamp").alias("date_dt")))
    rows = found.select(*carried, F.explode(F.when(counted, single).otherwise(let(days, kept))).alias("x"))
    common = F.when(F.col("x.date_dt").isNull(), parse_common(F.col("x.m.date_text"))).otherwise(F.col("x.date_dt"))
    return rows.select(*carried, "x.m.*", common.alias("date_dt")).filter(F.col("date_dt").isNotNull())


def extract_mentions(
    notes: DataFrame,
    n_before: int = 30,
    n_after: int = 45,
    ignore_excluded: bool = True,
    drop_na: bool = True,
    attr: str = "NORM",
    tz: str | None = None,
    pattern: str = DATE_PATTERN,
    mode: str = "token",
    keep: tuple[str, ...] = ("note_id", "person_id"),
    normal: Normal | None = None,
    abbreviations: tuple[str, ...] = ABBREVIATIONS,
    once: bool = False,
    snippets: bool = True,
    only: str | None = None,
) -> DataFrame:
    """One row per date mention of `note_text`, with its snippet; columns `keep` are carried along.

    `mode` counts the window in tokens or in sentences, which `abbreviations` don't end. With
    `ignore_excluded` a date beside a number gets no parsed value and leaves the snippets of other
    dates. `attr`: TEXT keeps the text, NORM drops pollution tokens, LOWER lower-cases the snippet.
    `normal` searches a normal form instead and cuts the snippets from it; offsets and lexical
    variants are those of the source.

    `once` keeps the mentions whose date occurs once in their note (a row of `notes`), and adds
    `count_date`: dates are counted inside the note's own row.

    Without `snippets` no window is cut, and the three columns of the snippet are left out: spans
    are many times as wide as a note, and jobs that count or match dates don't read them.

    `only` names a column of `notes`, an array of structs (start, end): just the mentions with these
    offsets are returned, as they would be among all. Snippets of the others are not cut.

    A narrow job without a shuffle: every note is read once, and only the carried columns
    and the text travel to the Arrow workers.
    """
    if once and only:
        raise ValueError("`only` does not go with `once`, which needs all dates of a note")
    options = Options(n_before, n_after, ignore_excluded, attr, mode, abbreviations, normal, snippets)
    found = _found(notes, keep, options, tz, pattern, once, only)
    out = found.select(
        *[c for c in keep if c in notes.columns],
        "lexical_variant",
        "date_dt",
        "text_start_char",
        "text_end_char",
        *(_SNIPPET if snippets else ()),
        *([F.lit(1).cast("long").alias("count_date")] if once else []),
    )
    return out.dropna(subset=["date_dt"]) if drop_na else out


def extract_periods(
    notes: DataFrame,
    tz: str | None = None,
    keep: tuple[str, ...] = ("note_id", "person_id"),
    normal: Normal | None = None,
    ignore_excluded: bool = True,
) -> DataFrame:
    """One row per period ("du 3 au 10 mars 2019"): both mentions with their offsets, both days.

    What the first mention lacks is taken from the last, and a period doesn't end before it begins.
    """
    found = _found(notes, keep, Options(0, 0, ignore_excluded, "TEXT", "token", normal=normal, snippets=False), tz, DATE_PATTERN, False)
    noted = F.col("note_datetime") if "note_datetime" in notes.columns else None
    return found.filter("end_variant is not null").select(
        *[c for c in keep if c in notes.columns],
        F.col("lexical_variant").alias("start_variant"),
        F.col("date_dt").alias("start_dt"),
        F.col("text_start_char").alias("start_char"),
        "end_variant",
        localise(parse_date(F.col("end_variant"), noted), tz).alias("end_dt"),
        F.col("end_end_char").alias("end_char"),
    )


def normalise_notes(notes: DataFrame, normal: Normal, text: str = "note_text", keep: tuple[str, ...] = ("note_id",)) -> DataFrame:
    """Columns `keep` with `normal_text` and `breaks`, by which `source_offset` finds the way back; nulls stay null."""
    schema = T.StructType([notes.schema[c] for c in keep] + [T.StructField("normal_text", T.StringType()), T.StructField("breaks", _BREAKS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [None if x is None else normalise(x, normal) for x in batch.column("_text").to_pylist()]
            texts = pa.array([f and f[0] for f in forms], pa.string())
            breaks = pa.array([f and [{"at": a, "source": b} for a, b in f[1]] for f in forms], _ARROW_BREAKS)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], texts, breaks], names=schema.names)

    return notes.select(*keep, F.col(text).alias("_text")).mapInArrow(run, schema)


_BREAKS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("source", T.IntegerType())]))
_ARROW_BREAKS = pa.list_(pa.struct([("at", pa.int32()), ("source", pa.int32())]))


def pathology_codes(
    notes: DataFrame,
    decode: DataFrame | None = None,
    pattern: str = CODE_PATTERN,
    parts: dict[str, tuple[int, int]] | None = None,
    keep: tuple[str, ...] = ("note_id",),
    prefix: str = "adicap_",
) -> DataFrame:
    """One row per pathology code of `note_text` with its decoded parts.

    `decode` has columns (axis, code, label); parts it does not list are null, and without
    it the parts stay raw codes. Of rows that repeat a code of an axis the lowest label counts.
    Every part takes one join, with a broadcast where the table's size allows.
    """
    parts = CODE_PARTS if parts is None else parts
    code = F.col(f"{prefix}code")
    rows = notes.select(
        *keep, F.explode_outer(find_codes(F.col("note_text"), pattern)).alias(f"{prefix}code")
    ).filter(code.isNotNull())
    rows = rows.withColumns({prefix + name: F.substring(code, *span) for name, span in parts.items()})
    if decode is None:
        return rows
    small = is_small(decode)
    for name in parts:
        axis = decode.filter(F.col("axis") == name).groupBy(F.col("code").alias(prefix + name)).agg(F.min("label").alias("_label"))
        rows = (
            rows.join(F.broadcast(axis) if small else axis, prefix + name, "left")
            .withColumn(prefix + name, F.col("_label"))
            .drop("_label")
        )
    return rows.select(*keep, f"{prefix}code", *[prefix + name for name in parts])
