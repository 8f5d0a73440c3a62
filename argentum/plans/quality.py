"""Gold labels, silver-versus-gold reports, scores by stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions.columns import mask_span
from argentum.functions.losses import loss
from argentum.functions.probability import binarise, to_prediction
from argentum.operators.joins import assert_unique, attach, join_spans, keep_keys, value_errors
from argentum.operators.metrics import binary_scores, error_counts
from argentum.operators.ranking import dense_id
from argentum.plans.mentions import extract_mentions
from argentum.session import stage


def gold_labels(annotations: DataFrame) -> DataFrame:
    """Annotations without those a human added, under the column names of mentions."""
    return annotations.filter(~F.coalesce("added_by_user", F.lit(False))).select(
        "note_id",
        "lexical_variant",
        F.col("offset_begin").alias("text_start_char"),
        F.col("offset_end").alias("text_end_char"),
        F.col("gold_label_value").alias("label"),
    )


def remarked(annotations: DataFrame) -> DataFrame:
    """Annotations with a remark, for review."""
    return annotations.filter(F.col("remark") != "")


def gold_examples(
    annotations: DataFrame,
    texts: DataFrame,
    note_dates: DataFrame | None = None,
    name: str = "test",
    validate: bool = True,
    **mention_options: object,
) -> DataFrame:
    """Gold test examples: annotated mentions found again in the texts, numbered and masked.

    Its own jobs find repeated keys, which raise ValueError.
    """
    with value_errors():
        return _gold_examples(annotations, texts, note_dates, name, validate, mention_options)


def _gold_examples(annotations: DataFrame, texts: DataFrame, note_dates: DataFrame | None, name: str, validate: bool, mention_options: dict) -> DataFrame:
    gold = gold_labels(annotations)
    texts = keep_keys(texts, gold, ["note_id"])
    if note_dates is not None:
        check = "one_to_one" if validate else None
        texts = attach(texts, note_dates, ["note_id"], validate=check)
    # without other mentions nothing changes: spans of checked texts are unique, and only `once` counts per note
    if (note_dates is not None or not validate) and not {"once", "only"} & mention_options.keys():
        texts, mention_options = texts.join(_places(gold), "note_id"), {**mention_options, "only": _PLACES}
    # the order of the examples is sampled ahead of its sort: two passes over the mentions
    found = stage(extract_mentions(texts, **mention_options), "found")
    labelled = join_spans(
        found, gold.drop("lexical_variant"), validate="one_to_one" if validate else None
    )
    numbered = dense_id(labelled, [F.col(c) for c in ("note_id", "text_start_char", "text_end_char")])
    return mask_span(numbered.select(F.lit(name).alias("set"), *numbered.columns))


_PLACES = "_places"


def _places(gold: DataFrame) -> DataFrame:
    """One row per annotated note with the offsets of its annotations, as `extract_mentions` takes them."""
    offset = lambda c: F.col(c).try_cast("int")
    spans = gold.select("note_id", offset("text_start_char").alias("start"), offset("text_end_char").alias("end"))
    return spans.filter("note_id is not null").groupBy("note_id").agg(F.collect_set(F.struct("start", "end")).alias(_PLACES))


def flag_reports(examples: DataFrame, reports: DataFrame) -> DataFrame:
    """Add `has_bp_report`: the person has a pathology report."""
    persons = reports.select("person_id").distinct().withColumn("has_bp_report", F.lit(True))
    return examples.join(persons, "person_id", "left").na.fill({"has_bp_report": False})


def report_strata(examples: DataFrame, reports: DataFrame) -> DataFrame:
    """Test examples as two named sets, by report availability."""
    flagged = flag_reports(examples, reports)
    name = F.when(F.col("has_bp_report"), "test_with_bp").otherwise("test_without_bp")
    return flagged.withColumn("set", name)


def compare_spans(gold: DataFrame, silver: DataFrame, label: str = "label", validate: bool = False) -> DataFrame:
    """Gold and silver labels of the same spans, as booleans `gold` and `silver`."""
    keys = ["note_id", "text_start_char", "text_end_char"]
    g = gold.select(*keys, F.col(label).cast("boolean").alias("gold"))
    s = silver.select(*keys, F.col(label).cast("boolean").alias("silver"))
    if validate:
        g, s = assert_unique(g, keys), assert_unique(s, keys)
    return g.join(s, keys)


def silver_quality(gold: DataFrame, silver: DataFrame, label: str = "label") -> DataFrame:
    """Counts and rates of silver labels that gold contradicts."""
    return error_counts(compare_spans(gold, silver, label), F.col("silver"), F.col("gold"))


def contradictions(gold: DataFrame, silver: DataFrame, texts: DataFrame, label: str = "label") -> DataFrame:
    """Contradicted spans with their kind and text."""
    wrong = compare_spans(gold, silver, label).filter(F.col("silver") != F.col("gold"))
    kind = F.when(F.col("silver"), "false positive").otherwise("false negative")
    return wrong.withColumn("kind", kind).join(texts.select("note_id", "note_text"), "note_id")


def predict(df: DataFrame, num_classes: int, binary: bool = True, logits: str = "logits") -> DataFrame:
    """Add `prediction` from the logits; with `binary`, classes above 1 count as 0."""
    prediction = to_prediction(F.col(logits), num_classes)
    if num_classes == 1:
        prediction = F.element_at(prediction, 1)
    return df.withColumn("prediction", binarise(prediction, num_classes) if binary else prediction)


def score(
    df: DataFrame,
    num_classes: int,
    by: list[str] | None = None,
    binary: bool = True,
    loss_name: str | None = None,
    **loss_options: object,
) -> DataFrame:
    """Precision, recall and F1 of a prediction table, per stratum, with the summed loss when named."""
    predicted = predict(df, num_classes, binary)
    scores = binary_scores(predicted, by=by)
    if loss_name is None:
        return scores
    value = loss(loss_name, F.col("logits"), F.col("label"), num_classes, **loss_options)
    summed = predicted.groupBy(*(by or [])).agg(F.sum(value).alias("loss"))
    if by:
        return scores.join(summed, by)
    return scores.withColumn("loss", summed.select("loss").scalar())
