"""Gold labels, quality reports, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.functions.probability import binarise
from argentum.operators.metrics import value_counts
from argentum.plans.quality import (
    contradictions,
    flag_reports,
    gold_examples,
    gold_labels,
    remarked,
    report_strata,
    score,
    silver_quality,
)
from argentum.session import stage
from driver_queries.inputs import LOGITS, MENTIONS, NOTES
from driver_queries.registry import query, with_

GOLD = """annotations AS (
  SELECT note_id, substr(note_text, s, 10) AS lexical_variant, CAST(s - 1 + shift AS INTEGER) AS offset_begin, CAST(s + 9 + shift AS INTEGER) AS offset_end,
    priority IN ('3-MEDIUM', '4-NOT SPECIFIED') AS gold_label_value,
    CASE priority WHEN '1-URGENT' THEN TRUE WHEN '5-LOW' THEN NULL ELSE FALSE END AS added_by_user,
    CASE priority WHEN '2-HIGH' THEN 'to check' ELSE '' END AS remark
  FROM (SELECT *, instr(note_text, 'Prélevé le : ') + 13 AS s, CASE priority WHEN '2-HIGH' THEN 1 ELSE 0 END AS shift FROM notes)
  WHERE note_text IS NOT NULL AND instr(note_text, 'Prélevé le : ') > 0),
gold AS (SELECT note_id, lexical_variant, offset_begin AS text_start_char, offset_end AS text_end_char, gold_label_value AS label
  FROM annotations WHERE NOT coalesce(added_by_user, FALSE))"""


def annotations(t):
    begin = F.instr("note_text", "Prélevé le : ") + 13
    priority = F.col("priority")
    shift = F.when(priority == "2-HIGH", 1).otherwise(0)
    # as a filter on the view the search would make the texts, ahead of their spreading and once per use
    notes = t.notes.select("note_id", "priority", F.explode(F.array("note_text")).alias("note_text"))
    return notes.filter(F.instr("note_text", "Prélevé le : ") > 0).select(
        "note_id",
        F.substring(F.col("note_text"), begin, F.lit(10)).alias("lexical_variant"),
        (begin - 1 + shift).alias("offset_begin"),
        (begin + 9 + shift).alias("offset_end"),
        priority.isin("3-MEDIUM", "4-NOT SPECIFIED").alias("gold_label_value"),
        F.when(priority == "1-URGENT", True).when(priority != "5-LOW", False).alias("added_by_user"),
        F.when(priority == "2-HIGH", "to check").otherwise("").alias("remark"),
    )


@query("gold_labels", with_(NOTES, GOLD, "SELECT * FROM gold"))
def gold_labels_query(t):
    return gold_labels(annotations(t))


@query("annotations_with_remark", with_(NOTES, GOLD, "SELECT note_id, lexical_variant, remark FROM annotations WHERE remark <> ''"))
def annotations_with_remark(t):
    return remarked(annotations(t)).select("note_id", "lexical_variant", "remark")


@query(
    "gold_merge",
    with_(
        NOTES,
        MENTIONS,
        GOLD,
        """SELECT 'test' AS set, row_number() OVER (ORDER BY m.note_id, m.text_start_char, m.text_end_char) - 1 AS text_id, m.note_id, m.person_id,
  m.text_start_char, g.label, m.date_dt, substr(span, 1, span_start_char) || '<mask>' || substr(span, span_end_char + 1) AS masked_span
FROM mentions m JOIN gold g ON m.note_id = g.note_id AND m.text_start_char = g.text_start_char AND m.text_end_char = g.text_end_char
WHERE m.date_dt IS NOT NULL""",
    ),
)
def gold_merge(t):
    texts = t.notes.drop("person_id", "note_datetime")
    note_dates = t.notes.select("note_id", "person_id", "note_datetime")
    # annotations are a table of their own: several passes check and join them
    examples = gold_examples(stage(annotations(t), "annotations"), texts, note_dates)
    return examples.select("set", "text_id", "note_id", "person_id", "text_start_char", "label", "date_dt", "masked_span")


SILVER = """g AS (SELECT doc_id, quality = 1 AS gold FROM labels),
s AS (SELECT doc_id, n_chars > 1000 AS silver, text FROM documents)"""


def silver_and_gold(t):
    span = [F.lit(0).alias("text_start_char"), F.lit(1).alias("text_end_char")]
    gold = t["labels"].select(F.col("doc_id").alias("note_id"), *span, (F.col("quality") == 1).alias("label"))
    silver = t["documents"].select(F.col("doc_id").alias("note_id"), *span, (F.col("n_chars") > 1000).alias("label"))
    return gold, silver


@query(
    "silver_quality",
    with_(
        SILVER,
        """SELECT count(*) FILTER (silver AND NOT gold) AS n_false_positive, count(*) FILTER (NOT silver AND gold) AS n_false_negative,
  count(*) FILTER (silver) AS n_positive, count(*) FILTER (NOT silver) AS n_negative,
  round(count(*) FILTER (silver AND NOT gold) / count(*) FILTER (silver), 9) AS false_positive_rate,
  round(count(*) FILTER (NOT silver AND gold) / count(*) FILTER (NOT silver), 9) AS false_negative_rate FROM g JOIN s USING (doc_id)""",
    ),
)
def silver_quality_query(t):
    rates = ("false_positive_rate", "false_negative_rate")
    return silver_quality(*silver_and_gold(t)).withColumns({c: F.round(c, 9) for c in rates})


@query(
    "contradicted_texts",
    with_(
        SILVER,
        """SELECT doc_id AS note_id, CASE WHEN silver THEN 'false positive' ELSE 'false negative' END AS kind, text AS note_text
FROM g JOIN s USING (doc_id) WHERE silver <> gold""",
    ),
)
def contradicted_texts(t):
    texts = t["documents"].select(F.col("doc_id").alias("note_id"), F.col("text").alias("note_text"))
    return contradictions(*silver_and_gold(t), texts).select("note_id", "kind", "note_text")


REPORTS = "reports AS (SELECT DISTINCT person_id FROM notes WHERE note_class_source_value = 'CR-ANAPATH' AND priority = '2-HIGH')"


def reports(t):
    return t.notes.filter("note_class_source_value = 'CR-ANAPATH' AND priority = '2-HIGH'")


@query(
    "persons_with_report",
    with_(
        NOTES,
        REPORTS,
        """SELECT person_id IN (SELECT person_id FROM reports) AS has_bp_report, count(DISTINCT person_id) AS n FROM notes GROUP BY 1""",
    ),
)
def persons_with_report(t):
    flagged = flag_reports(t.notes.select("person_id").distinct(), reports(t))
    return value_counts(flagged, ["has_bp_report"])


@query(
    "report_strata",
    with_(
        NOTES,
        REPORTS,
        """SELECT note_id, person_id, person_id IN (SELECT person_id FROM reports) AS has_bp_report,
  CASE WHEN person_id IN (SELECT person_id FROM reports) THEN 'test_with_bp' ELSE 'test_without_bp' END AS set FROM notes""",
    ),
)
def report_strata_query(t):
    return report_strata(t.notes.select("note_id", "person_id"), reports(t))


SCORES = """scored AS (SELECT {by}, count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y <> 1) AS fp,
    count(*) FILTER (pred <> 1 AND y = 1) AS fn FROM predicted GROUP BY ALL)"""
PREDICTED = LOGITS + """,
predicted AS (SELECT vec_id, vec_id % 4 AS status, y, CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 0 END AS pred FROM logits)"""
RATIOS = """tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM scored"""


def rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("binary_metrics", with_(PREDICTED, SCORES.format(by="0 AS k"), "SELECT " + RATIOS))
def binary_metrics(t):
    return rounded(score(t.logits, 3))


@query("metrics_by_status", with_(PREDICTED, SCORES.format(by="status"), "SELECT status, " + RATIOS))
def metrics_by_status(t):
    return rounded(score(t.logits.withColumn("status", F.col("vec_id") % 4), 3, by=["status"]))


@query(
    "validation_score_with_loss",
    with_(
        PREDICTED,
        SCORES.format(by="0 AS k"),
        """SELECT tp, fp, fn, (SELECT round(sum(ln(exp(z0) + exp(z1) + exp(z2)) - CASE y WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END), 6) FROM logits)
  AS loss FROM scored""",
    ),
)
def validation_score_with_loss(t):
    return score(t.logits, 3, loss_name="CE").select("tp", "fp", "fn", F.round("loss", 6).alias("loss"))


@query("binarised_labels", "SELECT vec_id, CASE WHEN label > 1 THEN 0 ELSE label END AS label FROM embeddings")
def binarised_labels(t):
    return t["embeddings"].select("vec_id", binarise(F.col("label"), 10).alias("label"))
