"""Known event dates from reports and coded procedures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions.columns import to_zone
from argentum.operators.joins import keep_keys
from argentum.operators.metrics import all_allowed
from argentum.plans.mentions import pathology_codes
from argentum.session import broadcast_if_small
from argentum.sources.fixed_values import (
    PATHOLOGY_CLASS,
    RCP_CLASS,
    RECEPTION_PATTERN,
    SAMPLING_PATTERN,
)

REPORT_COLUMNS = [
    "note_id",
    "note_text",
    "note_datetime",
    "sampling_date",
    "reception_date",
    "note_class_source_value",
    "person_id",
    "visit_occurrence_id",
]


def report_dates(
    reports: DataFrame,
    sampling_pattern: str = SAMPLING_PATTERN,
    reception_pattern: str = RECEPTION_PATTERN,
    group: int = 4,
) -> DataFrame:
    """Sampling and reception date of a report; null when absent or not dd/MM/yyyy."""
    text = F.lower("note_text")
    date = lambda pattern: F.try_to_timestamp(F.regexp_extract(text, pattern, group), F.lit("dd/MM/yyyy"))
    return reports.withColumns(
        {"reception_date": date(reception_pattern), "sampling_date": date(sampling_pattern)}
    )


def reports_of_stays(reports: DataFrame, stays: DataFrame, letters: list[str]) -> DataFrame:
    """Reports of stays whose group has one of the letters."""
    return keep_keys(reports, stays.filter(F.col("letter_ghm").isin(list(letters))), ["visit_occurrence_id"])


def biopsy_reports(
    documents: DataFrame,
    stays: DataFrame | None = None,
    stay_letters: list[str] | None = None,
    sampling_modes: list[str] | None = None,
    codes: DataFrame | None = None,
    decode: DataFrame | None = None,
    columns: list[str] | None = None,
) -> DataFrame:
    """Pathology reports with their dates.

    Optional filters: stay-group letters, and reports whose every code has an allowed
    sampling mode. `codes` are extracted from the reports when not given.
    """
    reports = documents.filter(F.col("note_class_source_value") == PATHOLOGY_CLASS)
    if stay_letters is not None:
        reports = reports_of_stays(reports, stays, stay_letters)
    if sampling_modes is not None:
        found = pathology_codes(reports, decode) if codes is None else codes
        allowed = all_allowed(found, "note_id", "adicap_sampling_mode", list(sampling_modes))
        reports = keep_keys(reports, allowed, ["note_id"])
    return report_dates(reports).select(*(columns or REPORT_COLUMNS))


def visits_with_rcp(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("note_class_source_value") == RCP_CLASS).select("visit_occurrence_id")


def earliest_procedures(
    procedures: DataFrame,
    codes: DataFrame,
    documents: DataFrame | None = None,
    zone: str = "Europe/Paris",
) -> DataFrame:
    """Earliest listed procedure per (visit, person), in local time.

    With `documents`, only visits that have a meeting report. The code list is a
    membership test on a side that is hinted only after its size is known.
    """
    listed = broadcast_if_small(codes.select(F.col("Code").alias("procedure_source_value")))
    chosen = procedures.join(listed, "procedure_source_value", "left_semi")
    if documents is not None:
        chosen = keep_keys(chosen, visits_with_rcp(documents), ["visit_occurrence_id"])
    first = chosen.groupBy("visit_occurrence_id", "person_id").agg(
        F.min("procedure_start_datetime").alias("procedure_date")
    )
    return to_zone(first, zone, ["procedure_date"])


def known_dates(
    sources: list[tuple[DataFrame, str]],
    name: str = "known_date",
    drop_duplicates: bool = True,
) -> DataFrame:
    """Union of date sources; the label is the position of the source, from 1.

    With `drop_duplicates`, a date known from several sources keeps the highest label.
    """
    parts = [
        df.select("person_id", F.col(column).alias(name), F.lit(i).alias("label"))
        for i, (df, column) in enumerate(sources, start=1)
    ]
    union = reduce(DataFrame.unionByName, parts)
    if not drop_duplicates:
        return union
    return union.groupBy("person_id", name).agg(F.max("label").alias("label"))
