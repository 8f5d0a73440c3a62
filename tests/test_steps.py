import pytest
from pyspark.sql import functions as F

from argentum.plans.align import align
from argentum.plans.steps import ContractError, Step, code_reader, negative_rule, procedure_dates, split_by, splitter, visit_filter, visits_of


@pytest.fixture
def procedures(spark):
    rows = [("v1", "p1", "2020-01-02", "A"), ("v1", "p1", "2020-01-01", "A"), ("v2", "p2", "2020-03-01", "B"), ("v3", "p3", "2020-04-01", "A"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "visit_occurrence_id string, person_id string, day string, procedure_source_value string")
    return df.withColumn("procedure_start_datetime", F.to_timestamp("day"))


def listed(codes):
    return codes.where("flag = 'x'").withColumnRenamed("c", "Code")


def test_procedures_around_steps(spark, procedures, rows):
    codes = spark.createDataFrame([("A", "x"), ("A", "x"), ("B", None)], "c string, flag string")
    found = procedure_dates(procedures, codes, code_reader(listed), zone="UTC")
    assert rows(found.withColumn("procedure_date", F.col("procedure_date").cast("date").cast("string"))) == [("v1", "p1", "2020-01-01"), ("v3", "p3", "2020-04-01")]
    visits = spark.createDataFrame([("v3",), ("v2",)], "visit_occurrence_id string")
    found = procedure_dates(procedures, codes, code_reader(listed), visit_filter(visits_of), visits=visits)
    assert rows(found, "visit_occurrence_id") == [("v3",)]


def test_seams_are_checked(spark, procedures):
    codes = spark.createDataFrame([("A", "x")], "c string, flag string")
    with pytest.raises(ContractError, match="read_codes gives Code string"):
        procedure_dates(procedures, codes, code_reader(lambda df: df))
    with pytest.raises(ContractError, match="filter_by_visit keeps day string"):
        procedure_dates(procedures, codes, code_reader(listed), visit_filter(lambda df: df.drop("day")))
    with pytest.raises(ContractError, match="needs procedure_start_datetime timestamp"):
        procedure_dates(procedures.drop("procedure_start_datetime"), codes, code_reader(listed), visit_filter(lambda df: df))
    with pytest.raises(ContractError, match="gives list"):
        Step("s", lambda df: [])(codes)
    with pytest.raises(ContractError, match="gives flag int"):
        Step("s", lambda df: df, gives="flag int")(codes)


def texts(spark):
    rows = [("p1", "n1", "RCP", "old"), ("p1", "n2", "RCP", "old"), ("p2", "n3", "RCP", "old"), ("p3", "n4", "OTHER", "old"), ("p4", "n5", "RCP", "old"), (None, "n6", "RCP", "old")]
    return spark.createDataFrame(rows, "person_id string, note_id string, note_class_source_value string, `set` string")


def test_split_by_a_users_rule(spark, rows):
    known = spark.createDataFrame([("p4",)], "person_id string")
    seen = []

    def assign(df, name):
        seen.append(df)
        return df.where("person_id = 'p1'").select("person_id", F.lit(name).alias("set")).distinct()

    found = split_by(texts(spark), splitter(assign), note_classes=["RCP"], existing=[known], name="test")
    assert rows(found, "set", "note_id") == [("test", "n1"), ("test", "n2"), ("train", "n3"), ("train", "n6")]
    assert found.columns == ["set", "person_id", "note_id", "note_class_source_value"]
    assert rows(seen[0].where("person_id IS NOT NULL"), "note_id") == [("n1",), ("n2",), ("n3",)]


def test_a_person_in_two_sets_raises_at_the_action(spark):
    twice = splitter(lambda df: df.select("person_id", F.col("note_id").alias("set")))
    found = split_by(texts(spark), twice)
    with pytest.raises(Exception, match="keys are not unique"):
        found.collect()


def test_split_of_an_empty_table(spark):
    none = texts(spark).limit(0)
    assert split_by(none, splitter(lambda df: df.select("person_id", F.lit("test").alias("set")))).count() == 0


def test_negative_rule_of_a_user(spark):
    notes = spark.createDataFrame(
        [("n1", "p1", "vu le 03/02/2019 puis le 05/06/2018 et le 07/08/2017"), ("n2", "p1", "vu le 09/10/2016")], "note_id string, person_id string, note_text string"
    ).withColumn("note_datetime", F.lit("2020-01-01").cast("timestamp"))
    known = spark.sql("SELECT 'p1' AS person_id, timestamp'2019-02-03' AS known_date, 1 AS label")
    earliest = negative_rule(lambda distinct, aligned, n, seed, scale: distinct.where("label = 0").orderBy("date_dt").limit(n))
    found = align(known, notes, negatives=earliest, mask_dates=False).collect()
    assert sorted((r["label"], r["lexical_variant"]) for r in found) == [(0, "07/08/2017"), (1, "03/02/2019")]
    with pytest.raises(ContractError, match="negatives keeps"):
        align(known, notes, negatives=negative_rule(lambda distinct, **_: distinct.drop("person_id")))
