from datetime import datetime

from argentum.operators.windows import keep_one, last_non_null
from argentum.plans.documents import documents_of_persons, last_documents, mentions_of_documents
from argentum.plans.events import biopsy_reports, earliest_procedures, known_dates, report_dates
from argentum.plans.mentions import pathology_codes
from argentum.session import literal_table

NOTE = "note_id string, person_id string, visit_occurrence_id string, note_datetime timestamp, note_class_source_value string, note_text string"
T0 = datetime(2020, 1, 1)


def notes(spark, *items):
    return spark.createDataFrame([(n, p, "v" + n, T0, c, text) for n, p, c, text in items], NOTE)


def test_document_classes(spark, rows):
    docs = notes(
        spark,
        ("1", "a", "RCP", "x"),
        ("2", "a", "INCONNU", "ligne\nIntitulé : RCP sein\nsuite"),
        ("3", "a", "INCONNU", "Intitulé : bilan\nRCP ailleurs"),
        ("4", "a", "CR-ANAPATH", "FICHIER PDF SCAN"),
        ("5", "a", "RCP", None),
        ("6", "b", "RCP", "x"),
        ("7", "a", "AUTRE", "x"),
    )
    found = documents_of_persons(docs, ["a"])
    assert rows(found, "note_id", "note_class_source_value") == [("1", "RCP"), ("2", "RCP"), ("4", "CR-ANAPATH")]
    assert rows(documents_of_persons(docs, ["a"], drop_scanned=True), "note_id") == [("1",), ("2",)]
    assert rows(documents_of_persons(docs, ["a", "b"], ("CR-ANAPATH",)), "note_id") == [("4",)]
    assert documents_of_persons(docs, ["a"], ()).count() == 0


def test_duplicate_persons_add_no_rows(spark):
    docs = notes(spark, ("1", "a", "RCP", "x"))
    persons = spark.createDataFrame([("a",), ("a",)], "person_id string")
    assert documents_of_persons(docs, persons).count() == 1


def test_report_dates(spark, rows):
    docs = notes(
        spark,
        ("1", "a", "CR-ANAPATH", "Prélevé le : 03/02/2020 et reçu le 04/02/2020"),
        ("2", "a", "CR-ANAPATH", "Date de prélèvement  31/02/2020"),
        ("3", "a", "CR-ANAPATH", "prélevé le 03/02/20"),
        ("4", "a", "CR-ANAPATH", "rien"),
    )
    out = rows(report_dates(docs), "note_id", "sampling_date", "reception_date")
    assert out == [
        ("1", datetime(2020, 2, 3), datetime(2020, 2, 4)),
        ("2", None, None),
        ("3", None, None),
        ("4", None, None),
    ]


DECODE = [("sampling_mode", "B", "biopsy"), ("sampling_mode", "H", "needle"), ("organ", "SE", "breast")]


def test_biopsy_reports(spark, rows):
    docs = notes(
        spark,
        ("1", "a", "CR-ANAPATH", "code BHSEA7A0"),
        ("2", "a", "CR-ANAPATH", "codes B.H.SE.A7A0 et HHSEB2N3"),
        ("3", "a", "CR-ANAPATH", "code ZHSEA7A0"),
        ("4", "a", "CR-ANAPATH", "sans code"),
        ("5", "a", "RCP", "code BHSEA7A0"),
    )
    decode = literal_table(spark, DECODE, "axis string, code string, label string")
    codes = pathology_codes(docs, decode)
    assert ("2", "BHSEA7A0", "biopsy", "breast") in rows(codes, "note_id", "adicap_code", "adicap_sampling_mode", "adicap_organ")
    stays = spark.createDataFrame([("v1", "M"), ("v1", "K"), ("v2", "C")], "visit_occurrence_id string, letter_ghm string")
    # note 3 has only an unknown mode: a group of nulls does not pass
    allowed = biopsy_reports(docs, sampling_modes=["biopsy", "needle"], decode=decode, columns=["note_id"])
    assert rows(allowed) == [("1",), ("2",)]
    assert rows(biopsy_reports(docs, sampling_modes=["biopsy"], decode=decode, columns=["note_id"])) == [("1",)]
    both = biopsy_reports(docs, stays, ["M", "K"], ["biopsy"], decode=decode, columns=["note_id"])
    assert rows(both) == [("1",)]
    assert biopsy_reports(docs).count() == 4


def test_earliest_procedures(spark, rows):
    schema = "person_id string, visit_occurrence_id string, procedure_start_datetime timestamp, procedure_source_value string"
    procedures = spark.createDataFrame(
        [
            ("p", "v1", datetime(2020, 7, 1, 23, 30), "A"),
            ("p", "v1", datetime(2020, 7, 2), "A"),
            ("p", "v1", datetime(2019, 1, 1), "Z"),
            ("q", "v2", datetime(2020, 1, 1), "A"),
        ],
        schema,
    )
    codes = spark.createDataFrame([("A", "a"), ("A", "a")], "Code string, Libelle string")
    # evening in UTC is the next day in Paris
    assert rows(earliest_procedures(procedures, codes)) == [
        ("v1", "p", datetime(2020, 7, 2, 1, 30)),
        ("v2", "q", datetime(2020, 1, 1, 1)),
    ]
    docs = notes(spark, ("1", "p", "RCP", "x"))
    assert rows(earliest_procedures(procedures, codes, docs), "visit_occurrence_id") == [("v1",)]


def test_known_dates(spark, rows):
    one = spark.createDataFrame([("p", T0), ("p", T0), ("q", None)], "person_id string, a timestamp")
    two = spark.createDataFrame([("p", T0)], "person_id string, b timestamp")
    assert rows(known_dates([(one, "a"), (two, "b")])) == [("p", T0, 2), ("q", None, 1)]
    assert known_dates([(one, "a"), (two, "b")], drop_duplicates=False).count() == 4


def test_last_rows(spark, rows):
    schema = "person_id string, note_id string, note_datetime timestamp, x string"
    df = spark.createDataFrame(
        [("p", "1", T0, "old"), ("p", "2", datetime(2021, 1, 1), None), ("p", "3", datetime(2021, 1, 1), None)], schema
    )
    # the last non-null value may come from an older row
    assert rows(last_non_null(df)) == [("p", "3", datetime(2021, 1, 1), "old")]
    assert rows(keep_one(df, how="last", tie_break=["note_id"]), "note_id", "x") == [("3", None)]
    assert rows(keep_one(df, tie_break=["note_id"]), "note_id") == [("1",)]
    assert rows(last_documents(df, strict=True), "note_id") == [("3",)]
    mentions = spark.createDataFrame([("1", 5), ("3", 6)], "note_id string, text_start_char int")
    assert rows(mentions_of_documents(mentions, last_documents(df))) == [("3", 6)]
