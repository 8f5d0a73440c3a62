"""Date mentions in free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.functions.text import find_spans
from argentum.plans.align import count_mentions
from argentum.plans.mentions import extract_mentions
from driver_queries.inputs import MENTIONS, NOTES, mention_cte
from driver_queries.registry import query, with_

OFFSETS = "note_id, person_id, lexical_variant, date_dt, text_start_char, text_end_char"


@query("mentions_offsets", with_(NOTES, MENTIONS, f"SELECT {OFFSETS} FROM mentions WHERE date_dt IS NOT NULL"))
def mentions_offsets(t):
    return t.dates.select(*OFFSETS.split(", "))


@query(
    "mentions_excluded",
    with_(NOTES, MENTIONS, "SELECT note_id, lexical_variant, text_start_char, text_end_char FROM mentions WHERE excluded"),
)
def mentions_excluded(t):
    found = extract_mentions(t.notes, drop_na=False, snippets=False)
    return found.filter("date_dt is null").select("note_id", "lexical_variant", "text_start_char", "text_end_char")


#: The pattern of tokens that only the normalised attribute drops.
POLLUTED = "'^[=_*#~\\-]{4,}\\s*$'"
CONTEXT = "note_id, text_start_char, span, span_start_char, span_end_char"


@query(
    "mentions_context",
    with_(NOTES, MENTIONS, f"SELECT {CONTEXT}, substr(span, span_start_char + 1, 10) AS inside FROM mentions WHERE NOT excluded"),
)
def mentions_context(t):
    inside = F.substring(F.col("span"), F.col("span_start_char") + 1, F.lit(10)).alias("inside")
    return t.mentions.select(*CONTEXT.split(", "), inside)


@query(
    "mentions_short_context",
    with_(NOTES, mention_cte(4, 6), f"SELECT {CONTEXT} FROM mentions WHERE NOT excluded"),
)
def mentions_short_context(t):
    return extract_mentions(t.notes, 4, 6).select(*CONTEXT.split(", "))


#: A sentence ends after punctuation and whitespace, or at a line break.
_SENTENCES = r"regexp_extract_all({}, '(?s)[.!?]+\s+|[ \t]*\n\s*|.+?(?:[.!?]+\s+|[ \t]*\n\s*|$)')"
_STRIPPED = r"regexp_replace({}, '(Score 3 )\d{{2}}/\d{{2}}/\d{{4}}\s*', '\1', 'g')"
SENTENCES = rf"""sentences AS (
  SELECT note_id, text_start_char, lexical_variant, {_STRIPPED.format('l')} AS cl,
    {_SENTENCES.format(_STRIPPED.format('l'))} AS lp, {_SENTENCES.format(_STRIPPED.format('r'))} AS rp FROM windows WHERE NOT excluded),
bounded AS (
  SELECT *, array_to_string(lp[greatest(len(lp) - CASE WHEN regexp_matches(cl, '([.!?]+\s+|\n\s*)$') THEN 0 ELSE 1 END, 1):], '') AS before,
    array_to_string(rp[1:2], '') AS after FROM sentences)"""


@query(
    "mentions_sentence",
    with_(
        NOTES,
        MENTIONS,
        SENTENCES,
        r"""SELECT note_id, CAST(text_start_char AS INTEGER) AS text_start_char, regexp_replace(before || lexical_variant || after, '\s+$', '') AS span,
  CAST(length(before) AS INTEGER) AS span_start_char, CAST(length(before) + 10 AS INTEGER) AS span_end_char FROM bounded""",
    ),
)
def mentions_sentence(t):
    return extract_mentions(t.notes, 1, 1, mode="sentence", attr="TEXT").select(*CONTEXT.split(", "))


@query(
    "mentions_lower_case",
    with_(
        NOTES,
        mention_cte(10, 10).replace(POLLUTED, "'^$'"),
        """SELECT note_id, text_start_char, lower(span) AS span, span_start_char, span_end_char FROM mentions WHERE NOT excluded""",
    ),
)
def mentions_lower_case(t):
    return extract_mentions(t.notes, 10, 10, attr="LOWER").select(*CONTEXT.split(", "))


#: How the note of an order says when something was, by its priority.
SAYINGS = {
    "1-URGENT": "hier",
    "2-HIGH": "il y a trois jours",
    "3-MEDIUM": "il y a 2 mois",
    "4-NOT SPECIFIED": "en 2019",
    "5-LOW": "aujourd'hui",
}


def _by_priority(values: dict) -> str:
    return "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"


@query(
    "mentions_relative",
    f"""WITH said AS (SELECT CAST(o_orderkey AS VARCHAR) AS note_id, CAST(o_custkey AS VARCHAR) AS head, o_orderdate AS d,
  {_by_priority({k: "'" + v.replace("'", "''") + "'" for k, v in SAYINGS.items()})} AS lexical_variant,
  {_by_priority({
      "1-URGENT": "CAST(o_orderdate AS DATE) - 1",
      "2-HIGH": "CAST(o_orderdate AS DATE) - 3",
      "3-MEDIUM": "CAST(CAST(o_orderdate AS DATE) - INTERVAL 2 MONTH AS DATE)",
      "4-NOT SPECIFIED": "DATE '2019-01-01'",
      "5-LOW": "CAST(o_orderdate AS DATE)",
  })} AS day FROM orders)
SELECT note_id, lexical_variant, CAST(day AS TIMESTAMP) AS date_dt, CAST(length('Patient ' || head || ' vu ') AS INTEGER) AS text_start_char FROM said""",
)
def mentions_relative(t):
    saying = F.create_map(*[F.lit(x) for pair in SAYINGS.items() for x in pair])[F.col("o_orderpriority")]
    text = F.concat(F.lit("Patient "), F.col("o_custkey").cast("string"), F.lit(" vu "), saying, F.lit(" en consultation."))
    notes = t["orders"].select(F.col("o_orderkey").cast("string").alias("note_id"), F.col("o_orderdate").cast("timestamp").alias("note_datetime"), text.alias("note_text"))
    return extract_mentions(notes, 2, 2).select("note_id", "lexical_variant", "date_dt", "text_start_char")


@query(
    "mentions_number_words",
    """SELECT CAST(o_orderkey AS VARCHAR) AS note_id, o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AS excluded,
  CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) END AS date_dt FROM orders""",
)
def mentions_number_words(t):
    before = {"1-URGENT": "Score trois ", "2-HIGH": "Score -3 ", "3-MEDIUM": "Score 1/2 ", "4-NOT SPECIFIED": "Score bas ", "5-LOW": "Score troisième "}
    said = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("o_orderpriority")]
    text = F.concat(said, F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" contrôle"))
    notes = t["orders"].select(F.col("o_orderkey").cast("string").alias("note_id"), text.alias("note_text"))
    found = extract_mentions(notes, 2, 2, drop_na=False)
    return found.select("note_id", F.col("date_dt").isNull().alias("excluded"), "date_dt")


DOCUMENT_PATTERN = r"\b\d{1,2}[/.\-]\d{1,2}[/.\-](?:\d{4}|\d{2})\b"


@query(
    "mentions_in_documents",
    rf"""WITH parts AS (
  SELECT doc_id, text, regexp_extract_all(text, '{DOCUMENT_PATTERN}') AS hits,
         string_split_regex(text, '{DOCUMENT_PATTERN}') AS gaps FROM documents),
spots AS (SELECT doc_id, text, hits, gaps, k FROM parts, unnest(range(1, len(hits) + 1)) AS u(k))
SELECT doc_id, hits[k] AS lexical_variant,
  CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0)
    AS INTEGER) AS text_start_char FROM spots""",
)
def mentions_in_documents(t):
    spans = find_spans(F.col("text"), DOCUMENT_PATTERN)
    found = t["documents"].select("doc_id", F.explode_outer(spans).alias("m")).filter("m is not null")
    return found.select("doc_id", "m.lexical_variant", "m.text_start_char")


@query(
    "number_spans_in_documents",
    r"""WITH parts AS (
  SELECT doc_id, regexp_extract_all(text, '\d+') AS hits, string_split_regex(text, '\d+') AS gaps FROM documents),
spots AS (SELECT doc_id, hits, gaps, k FROM parts, unnest(range(1, len(hits) + 1)) AS u(k))
SELECT doc_id, hits[k] AS lexical_variant,
  CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda h: length(h))), 0)
    AS INTEGER) AS text_start_char FROM spots""",
)
def number_spans_in_documents(t):
    spans = find_spans(F.col("text"), r"\d+")
    found = t["documents"].select("doc_id", F.explode_outer(spans).alias("m")).filter("m is not null")
    return found.select("doc_id", "m.lexical_variant", "m.text_start_char")


@query(
    "mention_counts",
    with_(
        NOTES,
        MENTIONS,
        """SELECT note_id, text_start_char, date_dt, count(*) OVER (PARTITION BY note_id, date_dt) AS count_date
FROM mentions WHERE date_dt IS NOT NULL""",
    ),
)
def mention_counts(t):
    return count_mentions(t.staged_dates).select("note_id", "text_start_char", "date_dt", "count_date")


@query(
    "mentions_once_per_note",
    with_(
        NOTES,
        MENTIONS,
        """SELECT note_id, text_start_char, date_dt, span FROM mentions WHERE date_dt IS NOT NULL
QUALIFY count(*) OVER (PARTITION BY note_id, date_dt) = 1""",
    ),
)
def mentions_once_per_note(t):
    return extract_mentions(t.notes, once=True).select("note_id", "text_start_char", "date_dt", "span")
