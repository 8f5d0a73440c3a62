"""Document selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.operators.joins import keep_keys
from argentum.operators.windows import keep_one, last_non_null
from argentum.sources.fixed_values import (
    PATHOLOGY_CLASS,
    RCP_CLASS,
    RCP_TITLE_PATTERN,
    SCANNED_MARKER,
    TITLE_PATTERN,
    UNKNOWN,
)

NOTE_CLASS = "note_class_source_value"


def rcp_like_title(text) -> F.Column:
    """The title line of a text names a multidisciplinary meeting."""
    return F.lower(F.regexp_extract(text, TITLE_PATTERN, 0)).rlike(RCP_TITLE_PATTERN)


def documents_of_persons(
    documents: DataFrame,
    persons: DataFrame | list,
    doc_types: tuple[str, ...] = (RCP_CLASS, PATHOLOGY_CLASS),
    columns: list[str] | None = None,
    drop_scanned: bool = False,
) -> DataFrame:
    """Meeting and pathology reports of a person set.

    Documents of unknown class with a meeting-like title count as meeting reports. The
    classes exclude each other, so one filtered scan replaces a union of scans.
    `drop_scanned` leaves out pathology reports that are only a scanned file.
    """
    if isinstance(persons, list):
        persons = documents.sparkSession.createDataFrame(
            [(p,) for p in persons], documents.select("person_id").schema
        )
    note_class, text = F.col(NOTE_CLASS), F.col("note_text")
    wanted = F.lit(False)
    if RCP_CLASS in doc_types:
        wanted = wanted | (note_class == RCP_CLASS) | ((note_class == UNKNOWN) & rcp_like_title(text))
    if PATHOLOGY_CLASS in doc_types:
        report = note_class == PATHOLOGY_CLASS
        wanted = wanted | (report & ~text.contains(SCANNED_MARKER) if drop_scanned else report)
    selected = keep_keys(documents.filter(text.isNotNull() & wanted), persons, ["person_id"])
    selected = selected.withColumn(NOTE_CLASS, F.when(note_class == UNKNOWN, RCP_CLASS).otherwise(note_class))
    return selected.select(*columns) if columns else selected


def last_documents(documents: DataFrame, strict: bool = False) -> DataFrame:
    """Last document of every person: per column the last non-null value, or one whole row (`strict`)."""
    if strict:
        return keep_one(documents, how="last", tie_break=["note_id"])
    return last_non_null(documents)


def mentions_of_documents(mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """Mentions restricted to the given documents."""
    return keep_keys(mentions, documents, ["note_id"])
