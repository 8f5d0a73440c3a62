"""Export tables and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.functions.columns import mask_span
from argentum.operators.metrics import binary_scores, value_counts
from argentum.plans.export import annotation_tables, csv_to_splits, export_splits, to_model_schema
from argentum.plans.noise import moving_loss
from argentum.session import staging_dir
from argentum.sources.readers import read_any
from argentum.sources.sinks import write_loss_trace, write_metrics, write_splits, write_stage
from driver_queries.inputs import LOSSES, MENTIONS, NOTES
from driver_queries.noise import MOVING
from driver_queries.registry import query, with_


def scratch(t, name: str) -> str:
    import uuid

    return f"{staging_dir(t.spark)}/argentum-{name}-{uuid.uuid4().hex}"


MODEL = """model AS (
  SELECT note_id || '-' || CAST(text_start_char AS VARCHAR) AS id, substr(span, 1, span_start_char) || '<mask>' || substr(span, span_end_char + 1) AS text,
    span_start_char AS span_start, CAST(span_start_char + 6 AS INTEGER) AS span_end FROM mentions WHERE date_dt IS NOT NULL)"""


@query("model_schema", with_(NOTES, MENTIONS, MODEL, "SELECT * FROM model"))
def model_schema(t):
    examples = mask_span(t.mentions).withColumn("text_id", F.concat_ws("-", "note_id", "text_start_char"))
    return to_model_schema(examples, label_col=None)


BALANCED = """rows AS (SELECT doc_id, text, CAST(n_chars AS INTEGER) AS n, CASE WHEN n_chars > 6000 THEN 2 WHEN n_chars > 2500 THEN 1 ELSE 0 END AS label FROM documents),
kept AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', CAST(doc_id AS VARCHAR), '0')), doc_id) AS r FROM rows)"""


@query(
    "export_balanced",
    with_(
        BALANCED,
        """SELECT 'train' AS set, doc_id AS id, text, 0 AS span_start, n AS span_end, label FROM kept
WHERE r <= (SELECT count(*) FROM rows WHERE label = 1)
UNION ALL SELECT 'val', doc_id, text, 0, CAST(quality AS INTEGER), toxic FROM labels JOIN documents USING (doc_id)""",
    ),
)
def export_balanced(t):
    n = F.col("n_chars")
    train = t["documents"].select(
        "doc_id", "text", F.lit(0).alias("begin"), n.cast("int").alias("end"),
        F.when(n > 6000, 2).when(n > 2500, 1).otherwise(0).alias("label"),
    )
    val = t["labels"].join(t["documents"].select("doc_id", "text"), "doc_id").select(
        "doc_id", "text", F.lit(0).alias("begin"), F.col("quality").cast("int").alias("end"), F.col("toxic").cast("int").alias("label")
    )
    columns = {"text_col": "text", "id_col": "doc_id", "span_cols": ("begin", "end")}
    return export_splits({"train": train, "val": val}, balance=1, **columns)


@query(
    "csv_train_val",
    """SELECT doc_id AS id, translate(text, 'üö', 'uo') AS text, 0 AS span_start, CAST(n_chars AS INTEGER) AS span_end, toxic AS label,
  CASE WHEN (('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), '42')), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 < 0.1
    THEN 'val' ELSE 'train' END AS set FROM labels JOIN documents USING (doc_id)""",
)
def csv_train_val(t):
    rows = t["labels"].join(t["documents"], "doc_id").select(
        "doc_id", "text", F.lit(0).alias("begin"), F.col("n_chars").cast("int").alias("end"), "toxic"
    )
    return csv_to_splits(rows, label_col="toxic", text_col="text", id_col="doc_id", span_cols=("begin", "end"))


ENTITIES = """SELECT note_id, text_start_char AS offset_begin, text_end_char AS offset_end, 'Biopsie/Cytoponction' AS label_name,
  FALSE AS label_value, 'pas de diagnostic' AS diagnostic, 'biopsie' AS type FROM mentions WHERE date_dt IS NOT NULL"""


@query("annotation_entities", with_(NOTES, MENTIONS, ENTITIES))
def annotation_entities(t):
    entities, _ = annotation_tables(t.dates.select("note_id", "text_start_char", "text_end_char"), t.notes)
    return entities


@query(
    "annotation_texts",
    with_(
        NOTES,
        MENTIONS,
        "SELECT note_id, note_text, note_id AS title FROM notes WHERE note_id IN (SELECT note_id FROM mentions WHERE date_dt IS NOT NULL)",
    ),
)
def annotation_texts(t):
    return annotation_tables(t.dates, t.notes)[1]


@query("stage_round_trip", with_(NOTES, "SELECT note_id, person_id, note_text FROM notes WHERE note_class_source_value = 'RCP'"))
def stage_round_trip(t):
    rcp = t.notes.filter("note_class_source_value = 'RCP'").select("note_id", "person_id", "note_text")
    path = write_stage(rcp, scratch(t, "{name}"), name="stage")
    return read_any(t.spark, path)


@query(
    "split_files_pruned",
    with_(NOTES, "SELECT note_id, priority FROM notes WHERE note_class_source_value = 'CR-ANAPATH'"),
)
def split_files_pruned(t):
    rows = t.notes.select("note_id", "priority", F.col("note_class_source_value").alias("set"))
    path = write_splits(rows, scratch(t, "splits"))
    return read_any(t.spark, path).filter("set = 'CR-ANAPATH'").select("note_id", "priority")


@query(
    "metrics_file",
    """SELECT quality AS label, CAST(n AS VARCHAR) AS n, 'trial' AS run, CAST(3 AS VARCHAR) AS epoch FROM (
  SELECT CAST(quality AS VARCHAR) AS quality, count(*) AS n FROM labels GROUP BY ALL)""",
)
def metrics_file(t):
    counts = value_counts(t["labels"].select(F.col("quality").alias("label")), ["label"])
    path = write_metrics(counts, scratch(t, "metrics") + "-csv", run="trial", epoch=3)
    return read_any(t.spark, path)


@query(
    "scores_of_labels",
    """SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic = 1 AND quality <> 1) AS fp,
  count(*) FILTER (toxic <> 1 AND quality = 1) AS fn FROM labels""",
)
def scores_of_labels(t):
    return binary_scores(t["labels"], "toxic", "quality").select("tp", "fp", "fn")


@query(
    "loss_trace_files",
    with_(LOSSES, MOVING, "SELECT sample_id, epoch, round(loss, 6) AS loss, round(moving_loss, 6) AS moving_loss FROM losses JOIN moving USING (sample_id)"),
)
def loss_trace_files(t):
    path = write_loss_trace(t.losses, moving_loss(t.losses), scratch(t, "loss"))
    joined = read_any(t.spark, f"{path}/loss_values").join(read_any(t.spark, f"{path}/moving_loss"), "sample_id")
    return joined.withColumns({c: F.round(c, 6) for c in ("loss", "moving_loss")})
