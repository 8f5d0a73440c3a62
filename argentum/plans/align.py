"""Alignment of date mentions with known dates: labels, negatives, masks."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from argentum.functions.columns import localise, mask_span, midpoint, parse_or_drop
from argentum.operators.joins import asof
from argentum.operators.ranking import dense_id
from argentum.operators.sampling import uniform_sample, weighted_sample
from argentum.operators.windows import keep_first_by
from argentum.plans.mentions import extract_mentions
from argentum.session import stage

MENTION_KEYS = ["note_id", "text_start_char", "text_end_char"]
SNIPPET = ["lexical_variant", "span", "span_start_char", "span_end_char"]
#: In units of the scale: beyond this distance a normal density is exactly 0 as a double.
ZERO_DENSITY = 39


def count_mentions(mentions: DataFrame) -> DataFrame:
    """Add `count_date`, the number of mentions of the same date in the note (null for null dates)."""
    counts = mentions.groupBy("note_id", "date_dt").agg(F.count("*").alias("count_date"))
    return mentions.join(counts, ["note_id", "date_dt"], "left")


def mentioned_once(mentions: DataFrame) -> DataFrame:
    """Mentions whose date occurs once in their note.

    Counting runs on numbers alone, in a hash aggregate that combines ahead of the shuffle.
    Only a group of one survives, so its least offset names the row, and the other columns,
    wide with snippets, join the survivors. `mentions` is read twice.
    """
    once = (
        mentions.filter(F.col("date_dt").isNotNull())
        .groupBy("note_id", "date_dt")
        .agg(F.count("*").alias("count_date"), F.min("text_start_char").alias("text_start_char"))
        .filter("count_date = 1")
    )
    joined = mentions.join(once, ["note_id", "date_dt", "text_start_char"])
    return joined.select("note_id", "date_dt", "count_date", *[c for c in mentions.columns if c not in ("note_id", "date_dt")])


def match_dates(
    mentions: DataFrame,
    known: DataFrame,
    date: str = "known_date",
    direction: str = "backward",
    tolerance_seconds: float | None = 0,
    threshold: str = "1930-01-01",
    tz: str | None = None,
) -> DataFrame:
    """Label every mention by the known date of its person, in notes that have a match.

    `label` is 0 without a match; without a label column in `known` it is a boolean.
    `matched_date_in_doc` sums the labels of a note before the date floor applies.
    Dates of `mentions` must be unique per note (`mentioned_once`), which bounds the
    window of a note by the calendar dates in it.
    """
    labelled = "label" in known.columns
    known = parse_or_drop(known, date).withColumn(date, localise(date, tz))
    mentions = mentions.withColumn("date_dt", localise(F.col("date_dt").cast("timestamp"), tz))
    if tolerance_seconds != 0:
        # the general as-of join reads the mentions twice
        mentions = stage(mentions, "probes")
    aligned = asof(
        mentions, known, "person_id", "date_dt", date, "label" if labelled else None, direction, tolerance_seconds
    )
    if labelled:
        aligned = aligned.withColumn("label", F.coalesce("label", F.lit(0)))
    else:
        aligned = aligned.withColumn("label", F.col("_value").isNotNull()).drop("_value")
    per_note = F.sum(F.col("label").cast("int")).over(Window.partitionBy("note_id"))
    return aligned.withColumn("matched_date_in_doc", per_note).filter(
        (F.col("date_dt") > F.lit(threshold).cast("timestamp")) & (F.col("matched_date_in_doc") > 0)
    )


def texts_of(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Texts of the notes in `found`; a null id is an id like any other."""
    notes = found.select(F.col("note_id").alias("_found")).distinct()
    return texts.join(notes, F.col("note_id").eqNullSafe(F.col("_found")), "left_semi")


def drop_repeated_spans(df: DataFrame) -> DataFrame:
    """One row per (span, person, label), the earliest mention."""
    return keep_first_by(
        df, ["span", "person_id", "label"], [F.col(c) for c in ["date_dt", *MENTION_KEYS]]
    )


def place(mentions: DataFrame) -> DataFrame:
    """Add `position`, the middle of the mention in its text."""
    return mentions.withColumn("position", midpoint("text_start_char", "text_end_char"))


def proximity_weight(mentions: DataFrame, matches: DataFrame | None = None, scale: float = 1500.0) -> DataFrame:
    """Add `p` to the unmatched mentions: the sum of normal densities around the note's matches.

    `matches` are the placed mentions with a label other than 0, by default those of
    `mentions`. They collapse to (position, count) within stretches so long that a match two
    stretches away has density 0 exactly. A mention then meets the positions of its own
    and the two adjacent stretches only, a number bounded by `scale` however long the
    note is and however many matches it has.
    """
    width = float(ZERO_DENSITY * scale)
    stretch = F.floor(F.col("position") / width)
    near = (
        (mentions if matches is None else matches)
        .filter("label <> 0")
        .groupBy("note_id", "position")
        .agg(F.count("*").alias("n"))
        .select(
            "note_id",
            F.explode(F.array(stretch - 1, stretch, stretch + 1)).alias("_stretch"),
            F.struct("position", "n").alias("_point"),
        )
        .groupBy("note_id", "_stretch")
        .agg(F.sort_array(F.collect_list("_point")).alias("_near"))
    )
    norm = 1.0 / (scale * math.sqrt(2 * math.pi))

    def add(acc, point):
        z = (F.col("position") - point["position"]) / F.lit(float(scale))
        return acc + point["n"] * F.exp(z * z * F.lit(-0.5)) * F.lit(norm)

    weight = F.coalesce(F.aggregate("_near", F.lit(0.0), add), F.lit(0.0))
    return (
        mentions.filter("label = 0")
        .withColumn("_stretch", stretch)
        .join(near, ["note_id", "_stretch"], "left")
        .withColumn("p", weight)
        .drop("_near", "_stretch")
    )


def proximity_negatives(
    distinct: DataFrame, aligned: DataFrame, n: int, seed: int = 0, scale: float = 1500.0
) -> DataFrame:
    """`n` unmatched mentions, likelier near a match of the same note (repeated spans included)."""
    weighted = proximity_weight(place(distinct), place(aligned), scale)
    return weighted_sample(weighted, MENTION_KEYS, "p", n, seed)


def uniform_negatives(distinct: DataFrame, aligned: DataFrame, n: int, seed: int = 0, **_: object) -> DataFrame:
    """`n` unmatched mentions, all equally likely."""
    return uniform_sample(distinct.filter("label = 0"), MENTION_KEYS, n, seed)


NEGATIVES: dict[str, Callable[..., DataFrame]] = {
    "proximity": proximity_negatives,
    "uniform": uniform_negatives,
}


def align(
    known: DataFrame,
    texts: DataFrame | None = None,
    mentions: DataFrame | None = None,
    date: str = "known_date",
    negatives: str | Callable[..., DataFrame] = "proximity",
    false_examples_multiplier: int = 1,
    seed: int = 0,
    scale: float = 1500.0,
    mask_dates: bool = True,
    tz: str | None = None,
    direction: str = "backward",
    tolerance_seconds: float | None = 0,
    threshold: str = "1930-01-01",
    strict: bool = False,
    **mention_options: object,
) -> DataFrame:
    """Silver examples: matched mentions plus sampled unmatched ones of the same notes.

    Mentions come from `mentions`, or are extracted from `texts` (options as in
    `extract_mentions`). The number of negatives is the multiplier times the matches with
    label 1; fewer when fewer exist, unless `strict`. A `set` column of `texts` comes first.

    `negatives` names a rule or is a callable (distinct, aligned, n, seed, scale) -> rows.

    Snippets are wide and most mentions lie in notes without a match, so counting and
    matching run on keys and dates only; snippets are cut from the notes that survive (`texts` are
    read twice) and join their rows. What several passes read is staged: the labelled mentions
    without and with snippets, and those with distinct spans.
    """
    keys = [*MENTION_KEYS, "date_dt"]
    if mentions is None:
        if texts is None:
            raise ValueError("either texts or mentions are needed")
        # every note is one row here, in which its dates are counted
        narrow = extract_mentions(texts, once=True, snippets=False, **mention_options).select(*keys, "person_id", "count_date")
    else:
        narrow = mentioned_once(mentions.select(*keys, "person_id"))
    # the raw date identifies the row again after localisation
    matched = match_dates(narrow.withColumn("_raw", F.col("date_dt")), known, date, direction, tolerance_seconds, threshold, tz)
    matched = matched.withColumn("label", F.col("label").cast("int"))
    if mentions is None:
        matched = stage(matched, "matched")
        mentions = extract_mentions(texts_of(texts, matched), once=True, **mention_options)
    wide = mentions.select(*MENTION_KEYS, F.col("date_dt").alias("_raw"), *SNIPPET)
    aligned = stage(matched.join(wide, [*MENTION_KEYS, "_raw"]).drop("_raw"), "aligned")

    distinct = stage(drop_repeated_spans(aligned), "distinct")
    n = distinct.filter("label = 1").count() * false_examples_multiplier
    draw = NEGATIVES[negatives] if isinstance(negatives, str) else negatives
    sampled = draw(distinct, aligned=aligned, n=n, seed=seed, scale=scale)
    if strict and sampled.count() < n:
        raise ValueError(f"fewer than {n} unmatched mentions to draw from")

    matches = distinct.filter("label <> 0")
    examples = matches.unionByName(sampled, allowMissingColumns=True).drop("date_dt", "count_date", date)
    examples = dense_id(examples, [F.col("label").desc(), *[F.col(c) for c in MENTION_KEYS]], "text_id")
    if mask_dates:
        examples = mask_span(examples)
    if texts is not None and "set" in texts.columns:
        sets = texts.select("note_id", "set").distinct()
        examples = examples.join(sets, "note_id", "left")
        examples = examples.select("set", *[c for c in examples.columns if c != "set"])
    return examples
