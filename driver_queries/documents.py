"""Document selection, reports, event dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.operators.metrics import all_allowed
from argentum.plans.documents import documents_of_persons, last_documents, mentions_of_documents
from argentum.plans.events import biopsy_reports, earliest_procedures, known_dates, report_dates, reports_of_stays
from argentum.plans.mentions import pathology_codes
from argentum.session import literal_table
from argentum.sources.readers import read_codes
from driver_queries.inputs import CODE_LIST, KNOWN, KNOWN_SOURCES, MENTIONS, NOTES, PROCEDURES, STAYS, SURGERIES
from driver_queries.registry import query, with_

PERSONS = "persons AS (SELECT CAST(c_custkey AS VARCHAR) AS person_id FROM customer WHERE c_mktsegment = 'BUILDING')"

SELECTED = r"""selected AS (
  SELECT note_id, person_id, CASE WHEN note_class_source_value = 'INCONNU' THEN 'RCP' ELSE note_class_source_value END
    AS note_class_source_value, note_datetime, note_text FROM notes
  WHERE person_id IN (SELECT person_id FROM persons) AND note_text IS NOT NULL
    AND (note_class_source_value IN ('RCP', 'CR-ANAPATH') OR (note_class_source_value = 'INCONNU'
      AND regexp_matches(lower(regexp_extract(note_text, '(?i)intitul[ée].*')), 'rcp?'))))"""

COLUMNS = ["note_id", "person_id", "note_class_source_value", "note_datetime", "note_text"]


def persons(t):
    return t["customer"].filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("person_id"))


@query("documents_of_persons", with_(NOTES, PERSONS, SELECTED, "SELECT * FROM selected"))
def documents_of_persons_query(t):
    return documents_of_persons(t.notes, persons(t), columns=COLUMNS)


@query(
    "documents_without_scans",
    with_(
        NOTES,
        PERSONS,
        SELECTED,
        """SELECT * FROM selected WHERE note_class_source_value = 'CR-ANAPATH' AND NOT contains(note_text, 'FICHIER PDF SCAN')""",
    ),
)
def documents_without_scans(t):
    return documents_of_persons(t.notes, persons(t), ("CR-ANAPATH",), COLUMNS, drop_scanned=True)


@query(
    "reports_of_stays",
    with_(
        NOTES,
        STAYS,
        """SELECT note_id, person_id FROM notes WHERE note_class_source_value = 'CR-ANAPATH'
  AND visit_occurrence_id IN (SELECT visit_occurrence_id FROM stays WHERE letter_ghm IN ('M', 'L', 'K'))""",
    ),
)
def reports_of_stays_query(t):
    reports = t.notes.filter("note_class_source_value = 'CR-ANAPATH'")
    return reports_of_stays(reports, t.stays, ["M", "L", "K"]).select("note_id", "person_id")


CODES = r"""found AS (
  SELECT note_id, replace(unnest(regexp_extract_all(note_text, '\b[A-Z]\.?[A-Z]\.?[A-Z]{2}\.?[A-Z0-9][0-9][A-Z0-9]{2}\b')), '.', '')
    AS adicap_code FROM notes),
modes(k, v) AS (VALUES ('B', 'BIOPSIE CHIRURGICALE'), ('H', 'HISTOPONCTION GUIDEE PAR IMAGERIE'), ('X', 'PIECE')),
organs(k, v) AS (VALUES ('SE', 'SEIN')),
codes AS (
  SELECT note_id, adicap_code, modes.v AS adicap_sampling_mode, organs.v AS adicap_organ FROM found
  LEFT JOIN modes ON substr(adicap_code, 1, 1) = modes.k LEFT JOIN organs ON substr(adicap_code, 3, 2) = organs.k)"""

ALLOWED = ["BIOPSIE CHIRURGICALE", "HISTOPONCTION GUIDEE PAR IMAGERIE"]


def decode_table(t):
    rows = [
        ("sampling_mode", "B", "BIOPSIE CHIRURGICALE"),
        ("sampling_mode", "H", "HISTOPONCTION GUIDEE PAR IMAGERIE"),
        ("sampling_mode", "X", "PIECE"),
        ("organ", "SE", "SEIN"),
    ]
    return literal_table(t.spark, rows, "axis string, code string, label string")


def codes_of(t):
    parts = {"sampling_mode": (1, 1), "organ": (3, 2)}
    return pathology_codes(t.notes, decode_table(t), parts=parts)


@query("pathology_codes", with_(NOTES, CODES, "SELECT * FROM codes"))
def pathology_codes_query(t):
    return codes_of(t)


@query(
    "pathology_code_parts",
    with_(
        NOTES,
        CODES,
        """SELECT note_id, adicap_code, substr(adicap_code, 1, 1) AS adicap_sampling_mode, substr(adicap_code, 2, 1) AS adicap_technic,
  substr(adicap_code, 3, 2) AS adicap_organ, substr(adicap_code, 5, 4) AS adicap_pathology,
  substr(adicap_code, 5, 2) AS adicap_pathology_type, substr(adicap_code, 6, 1) AS adicap_behaviour_type FROM found""",
    ),
)
def pathology_code_parts(t):
    return pathology_codes(t.notes)


ALL_ALLOWED = """allowed AS (SELECT note_id FROM codes GROUP BY note_id
  HAVING bool_and(adicap_sampling_mode IN ('BIOPSIE CHIRURGICALE', 'HISTOPONCTION GUIDEE PAR IMAGERIE')))"""


@query("all_codes_allowed", with_(NOTES, CODES, ALL_ALLOWED, "SELECT note_id FROM allowed"))
def all_codes_allowed(t):
    return all_allowed(codes_of(t), "note_id", "adicap_sampling_mode", ALLOWED)


REPORT_DATES = r"""dated AS (
  SELECT note_id, person_id, visit_occurrence_id, note_class_source_value,
    CAST(try_strptime(regexp_extract(lower(note_text),
      '((pr[ée]lev[ée]\sle)|(date\sd.\spr[ée]l[èe]vement))\s?:?\s{1,3}(\d{2}\/\d{2}\/\d{2,4})', 4), '%d/%m/%Y') AS TIMESTAMP) AS sampling_date,
    CAST(try_strptime(regexp_extract(lower(note_text),
      '((r?e[cç]u\sle)|(date\sde\sr.ception))\s?:?\s{1,3}(\d{2}\/\d{2}\/\d{2,4})', 4), '%d/%m/%Y') AS TIMESTAMP) AS reception_date
  FROM notes)"""


@query("report_dates", with_(NOTES, REPORT_DATES, "SELECT note_id, sampling_date, reception_date FROM dated"))
def report_dates_query(t):
    return report_dates(t.notes).select("note_id", "sampling_date", "reception_date")


@query(
    "biopsy_reports",
    with_(
        NOTES,
        STAYS,
        CODES,
        ALL_ALLOWED,
        REPORT_DATES,
        """SELECT note_id, person_id, visit_occurrence_id, sampling_date, reception_date FROM dated
WHERE note_class_source_value = 'CR-ANAPATH' AND note_id IN (SELECT note_id FROM allowed)
  AND visit_occurrence_id IN (SELECT visit_occurrence_id FROM stays WHERE letter_ghm IN ('U', 'H', 'L'))""",
    ),
)
def biopsy_reports_query(t):
    return biopsy_reports(
        t.notes,
        t.stays,
        ["U", "H", "L"],
        ALLOWED,
        decode=decode_table(t),
        columns=["note_id", "person_id", "visit_occurrence_id", "sampling_date", "reception_date"],
    )


@query(
    "earliest_procedure_per_visit",
    with_(
        PROCEDURES,
        CODE_LIST,
        SURGERIES,
        """SELECT visit_occurrence_id, person_id, timezone('Europe/Paris', timezone('UTC', procedure_date)) AS procedure_date
FROM surgeries""",
    ),
)
def earliest_procedure_per_visit(t):
    return earliest_procedures(t.procedures, read_codes(t.code_list))


@query(
    "earliest_procedure_of_rcp_visits",
    with_(
        PROCEDURES,
        CODE_LIST,
        SURGERIES,
        NOTES,
        """SELECT visit_occurrence_id, person_id, timezone('Europe/Paris', timezone('UTC', procedure_date)) AS procedure_date
FROM surgeries WHERE visit_occurrence_id IN (SELECT visit_occurrence_id FROM notes WHERE note_class_source_value = 'RCP')""",
    ),
)
def earliest_procedure_of_rcp_visits(t):
    return earliest_procedures(t.procedures, read_codes(t.code_list), t.notes)


@query("known_dates", with_(KNOWN, "SELECT person_id, known_date, label FROM known"))
def known_dates_query(t):
    return t.known


@query(
    "known_dates_with_repeats",
    with_(
        KNOWN_SOURCES,
        """SELECT person_id, known_date, label, count(*) AS n FROM (SELECT person_id, d AS known_date, 1 AS label FROM report_days
UNION ALL SELECT person_id, d, 2 FROM return_days) GROUP BY ALL""",
    ),
)
def known_dates_with_repeats(t):
    union = known_dates([(t.report_days, "d"), (t.return_days, "d")], drop_duplicates=False)
    return union.groupBy("person_id", "known_date", "label").agg(F.count("*").alias("n"))


LAST_VALUES = """lasts AS (
  SELECT person_id, {columns} FROM notes GROUP BY person_id)"""
_LAST = "arg_max({c}, (note_datetime, note_id)) FILTER ({c} IS NOT NULL) AS {c}"
NOTE_COLUMNS = ["note_id", "visit_occurrence_id", "note_datetime", "note_class_source_value", "priority", "note_text"]
LASTS = LAST_VALUES.format(columns=", ".join(_LAST.format(c=c) for c in NOTE_COLUMNS))


@query("last_document_per_person", with_(NOTES, LASTS, "SELECT * FROM lasts"))
def last_document_per_person(t):
    return last_documents(t.notes)


@query(
    "mentions_of_last_documents",
    with_(
        NOTES,
        MENTIONS,
        """SELECT note_id, text_start_char, date_dt FROM mentions WHERE date_dt IS NOT NULL AND note_id IN (
  SELECT arg_max(note_id, (note_datetime, note_id)) FROM notes GROUP BY person_id)""",
    ),
)
def mentions_of_last_documents(t):
    last = last_documents(t.notes, strict=True)
    return mentions_of_documents(t.mentions, last).select("note_id", "text_start_char", "date_dt")
