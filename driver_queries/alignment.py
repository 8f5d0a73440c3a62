"""Alignment of mentions with known dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.functions.columns import mask_span
from argentum.plans.align import align, drop_repeated_spans, match_dates, place, proximity_weight, texts_of
from argentum.plans.mentions import extract_mentions
from argentum.session import stage
from driver_queries.inputs import KNOWN, MENTIONS, NOTES
from driver_queries.registry import query, with_

ALIGNED = """once AS (SELECT * FROM mentions WHERE date_dt IS NOT NULL QUALIFY count(*) OVER (PARTITION BY note_id, date_dt) = 1),
matched AS (SELECT once.*, coalesce(label, 0) AS label FROM once LEFT JOIN known ON once.person_id = known.person_id AND date_dt = known_date),
aligned AS (SELECT * FROM (SELECT *, CAST(sum(label) OVER (PARTITION BY note_id) AS BIGINT) AS matched_date_in_doc FROM matched)
  WHERE date_dt > TIMESTAMP '1930-01-01' AND matched_date_in_doc > 0)"""

#: Every pair of an unmatched and a matched mention of a note, written out.
WEIGHTS = """placed AS (SELECT *, (text_start_char + text_end_char) / 2.0 AS position FROM aligned),
weights AS (
  SELECT n.note_id, n.text_start_char, coalesce(sum(exp(-0.5 * pow((n.position - m.position) / 1500.0, 2)) / (1500.0 * sqrt(2 * pi()))), 0) AS p
  FROM placed n LEFT JOIN placed m ON n.note_id = m.note_id AND m.label <> 0 WHERE n.label = 0 GROUP BY ALL)"""

_DEDUPED = """QUALIFY row_number() OVER (PARTITION BY span, person_id, label ORDER BY date_dt, note_id, text_start_char, text_end_char) = 1"""
MATCHES = f"matches AS (SELECT * FROM aligned WHERE label <> 0 {_DEDUPED})"
CANDIDATES = f"candidates AS (SELECT * FROM aligned WHERE label = 0 {_DEDUPED})"
_HASH = "md5(concat_ws(':', note_id, CAST(text_start_char AS VARCHAR), CAST(text_end_char AS VARCHAR), '{seed}'))"
UNIFORM = f"""negatives AS (SELECT * FROM candidates ORDER BY {_HASH.format(seed=0)}, note_id, text_start_char
  LIMIT (SELECT {{k}} * count(*) FROM matches WHERE label = 1))"""
PROXIMITY = f"""negatives AS (SELECT candidates.* FROM candidates JOIN weights USING (note_id, text_start_char) WHERE p > 0
  ORDER BY ln(-ln((('0x' || substr({_HASH.format(seed=0)}, 1, 13))::BIGINT + 0.5) / 4503599627370496.0)) - ln(p), note_id, text_start_char
  LIMIT (SELECT count(*) FROM matches WHERE label = 1))"""
EXAMPLES = """examples AS (SELECT * FROM matches UNION ALL SELECT * FROM negatives),
numbered AS (SELECT *, row_number() OVER (ORDER BY label DESC, note_id, text_start_char, text_end_char) - 1 AS text_id FROM examples)"""
FINAL = """SELECT text_id, note_id, person_id, lexical_variant, text_start_char, text_end_char, span, span_start_char, span_end_char, label,
  matched_date_in_doc, substr(span, 1, span_start_char) || '<mask>' || substr(span, span_end_char + 1) AS masked_span,
  span_start_char AS masked_span_start_char, CAST(span_start_char + 6 AS INTEGER) AS masked_span_end_char FROM numbered"""
COLUMNS = """text_id note_id person_id lexical_variant text_start_char text_end_char span span_start_char span_end_char label
matched_date_in_doc masked_span masked_span_start_char masked_span_end_char""".split()


@query(
    "align_labels",
    with_(NOTES, MENTIONS, KNOWN, ALIGNED, "SELECT note_id, text_start_char, label, matched_date_in_doc FROM aligned"),
)
def align_labels(t):
    aligned = match_dates(t.dates_once, t.known)
    return aligned.select("note_id", "text_start_char", "label", "matched_date_in_doc")


@query(
    "align_positives",
    with_(NOTES, MENTIONS, KNOWN, ALIGNED, MATCHES, "SELECT note_id, text_start_char, label, span FROM matches"),
)
def align_positives(t):
    # snippets are cut from the notes that survive the matching of their dates
    found = stage(match_dates(t.dates_once, t.known).select("note_id").distinct(), "notes")
    aligned = match_dates(extract_mentions(texts_of(t.notes, found), once=True), t.known)
    return drop_repeated_spans(aligned.filter("label <> 0")).select("note_id", "text_start_char", "label", "span")


@query(
    "proximity_weights",
    with_(NOTES, MENTIONS, KNOWN, ALIGNED, WEIGHTS, "SELECT note_id, text_start_char, round(p * 1000, 9) AS p FROM weights"),
)
def proximity_weights(t):
    aligned = stage(match_dates(t.dates_once, t.known), "aligned")
    return proximity_weight(place(aligned)).select("note_id", "text_start_char", F.round(F.col("p") * 1000, 9).alias("p"))


@query(
    "align_proximity",
    with_(NOTES, MENTIONS, KNOWN, ALIGNED, WEIGHTS, MATCHES, CANDIDATES, PROXIMITY, EXAMPLES, FINAL),
)
def align_proximity(t):
    return align(t.known, t.notes).select(*COLUMNS)


@query(
    "align_uniform",
    with_(NOTES, MENTIONS, KNOWN, ALIGNED, MATCHES, CANDIDATES, UNIFORM.format(k=2), EXAMPLES, FINAL),
)
def align_uniform(t):
    return align(t.known, texts=t.notes, negatives="uniform", false_examples_multiplier=2).select(*COLUMNS)


@query(
    "align_with_set",
    with_(
        NOTES,
        MENTIONS,
        KNOWN,
        ALIGNED,
        MATCHES,
        CANDIDATES,
        UNIFORM.format(k=1),
        EXAMPLES,
        """SELECT CASE priority WHEN '1-URGENT' THEN 'dev' ELSE 'train' END AS set, text_id, note_id, label
FROM numbered JOIN notes USING (note_id)""",
    ),
)
def align_with_set(t):
    name = F.when(F.col("priority") == "1-URGENT", "dev").otherwise("train")
    return align(t.known, t.notes.withColumn("set", name), negatives="uniform", mask_dates=False).select(
        "set", "text_id", "note_id", "label"
    )


@query(
    "masked_span",
    with_(
        NOTES,
        MENTIONS,
        """SELECT note_id, text_start_char, substr(span, 1, span_start_char) || '<mask>' || substr(span, span_end_char + 1) AS masked_span,
  span_start_char AS masked_span_start_char, CAST(span_start_char + 6 AS INTEGER) AS masked_span_end_char
FROM mentions WHERE date_dt IS NOT NULL""",
    ),
)
def masked_span(t):
    return mask_span(t.mentions).select(
        "note_id", "text_start_char", "masked_span", "masked_span_start_char", "masked_span_end_char"
    )
