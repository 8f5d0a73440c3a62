import pytest
from pyspark.sql import functions as F

from argentum.session import literal_table
from argentum.sources.readers import filtered_read, first_file, read_any, read_codes, rows_per_file
from argentum.sources.sinks import write_metrics, write_splits, write_stage
from argentum.sources.tables import enrich_care_sites, get_table, one_row_per_note, scan


def raw_documents(spark):
    rows = [
        ("n1", "2020-01-01", "CR:RCP", "v1", "p1", "text", "t", "s"),
        ("n1", "2020-01-02", "CR:RCP", "v1", "p1", "again", "t", "s"),
        ("n2", "2020-01-01", "CR:CR-ANAPATH", "v2", "p2", None, "t", "s"),
    ]
    return spark.createDataFrame(
        rows,
        "instance_num string, start_date string, concept_cd string, encounter_num string, patient_num string,"
        "observation_blob string, provider_id string, sourcesystem_cd string",
    )


def test_scan_documents(spark, rows):
    out = scan(raw_documents(spark), "documents", select_cols=["note_id", "note_class_source_value"])
    assert rows(out) == [("n1", "RCP"), ("n2", "CR-ANAPATH")]
    renamed = scan(raw_documents(spark), "documents", rename_cols={"note_id": "id"}, select_cols=["id"])
    assert rows(renamed) == [("n1",), ("n2",)]


def test_deterministic_survivor(spark, rows):
    docs = scan(raw_documents(spark), "documents")
    assert docs.count() == 2
    raw = spark.createDataFrame([("n", 2, "b"), ("n", 1, "a")], "note_id string, k int, v string")
    assert rows(one_row_per_note(raw, ["k"]), "v") == [("a",)]


def test_bad_layout_and_missing_columns(spark):
    with pytest.raises(ValueError):
        get_table(spark, "documents", "db", db_type="csv")
    with pytest.raises(ValueError):
        scan(raw_documents(spark), "documents", db_type="csv")
    with pytest.raises(ValueError, match="missing columns"):
        scan(raw_documents(spark), "visit")


def test_get_table_from_catalog(spark, rows):
    spark.sql("CREATE DATABASE IF NOT EXISTS lake")
    for name in ("i2b2_observation_doc", "i2b2_observation_fact_document"):
        raw_documents(spark).write.mode("overwrite").saveAsTable(f"lake.{name}")
    assert get_table(spark, "documents", "lake").count() == 2
    assert get_table(spark, "documents", "lake", production=True).count() == 2
    canonical = get_table(spark, "documents", "lake").withColumn("note_id", F.col("note_id"))
    canonical.write.mode("overwrite").saveAsTable("lake.note")
    assert get_table(spark, "documents", "lake", db_type="omop").count() == 2


def test_stay_groups(spark, rows):
    raw = spark.createDataFrame(
        [("p", "v", "i", "2020-01-01", "GHM:06M091", "s")],
        "patient_num string, encounter_num string, instance_num string, start_date string, concept_cd string, sourcesystem_cd string",
    )
    out = scan(raw, "cost")
    assert rows(out, "drg_source_value", "letter_ghm") == [("06M091", "M")]
    assert "concept_cd" not in out.columns


def test_care_sites(spark, rows):
    names = literal_table(spark, [("095", "long", "A")], "care_site_source_value string, care_site_name string, cd_long_gh string")
    sites = spark.createDataFrame([("095",), ("095",), ("xyz",)], "care_site_source_value string")
    assert rows(enrich_care_sites(sites, names)) == [("095", "long", "A"), ("xyz", "INCONNU", "INCONNU")]


def test_filtered_read(spark, rows):
    df = spark.createDataFrame([(i, i * i) for i in range(2000)], "person_id int, v int")
    assert rows(filtered_read(df, keep=[1, 2, 3], avoid=[2], columns=["v"])) == [(1,), (9,)]
    assert filtered_read(df, keep=list(range(1500))).count() == 1500
    assert filtered_read(df, avoid=df.filter("person_id < 1990")).count() == 10
    assert filtered_read(df, keep=[], avoid=None).count() == 2000


@pytest.mark.parametrize("padding", [0, 2000])
def test_filtered_read_has_one_rule_for_nulls(spark, padding):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "person_id string")
    more = [f"other {i}" for i in range(padding)]
    kept = lambda **options: {r.person_id for r in filtered_read(df, **options).collect()}
    assert kept(avoid=["a", *more]) == {"b", None}
    assert kept(avoid=["a", None, *more]) == {"b"}
    assert kept(keep=["a", *more]) == {"a"}
    assert kept(keep=["a", None, *more]) == {"a", None}


def test_files(spark, tmp_path, rows):
    path = str(tmp_path / "ds")
    spark.range(10).repartition(3).write.parquet(path)
    spark.range(0).coalesce(1).write.mode("append").parquet(path)
    counts = rows_per_file(spark, path).collect()
    assert len(counts) == 4 and sum(r.n_rows for r in counts) == 10 and min(r.n_rows for r in counts) == 0
    assert first_file(spark, path).count() == first_file(spark, path, at_once=1).count() == [r.n_rows for r in sorted(counts, key=lambda r: r.file_path) if r.n_rows][0]


def test_read_any(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", "1")], "x string, y string")
    path = write_stage(df, str(tmp_path / "{name}"), name="stage")
    assert rows(read_any(spark, str(tmp_path / "{name}"), name="stage")) == [("a", "1")]
    csv = write_metrics(df, str(tmp_path / "m.csv"), run=3)
    assert rows(read_any(spark, csv)) == [("a", "1", "3")]
    assert read_any(spark, None) is None
    splits = write_splits(df.withColumn("set", F.lit("train")), str(tmp_path / "splits"))
    pruned = read_any(spark, splits).filter("set = 'dev'")
    assert pruned.count() == 0
    assert path.endswith("stage")


def test_code_list(spark, rows):
    codes = spark.createDataFrame(
        [("a", "x", None, "1"), ("a", "y", "1", None), ("b", "z", None, None)], "Code string, Libelle string, f1 string, f2 string"
    )
    assert rows(read_codes(codes, ["f1", "f2"])) == [("a", "x")]
