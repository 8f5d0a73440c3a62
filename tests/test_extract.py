from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argentum.plans import extract as job
from argentum.plans.extract import extract, record_schema
from argentum.sources.readers import files_of, first_file, read_splits, rows_per_file, table_location
from argentum.sources.sinks import write_splits


def words(text, lang=None):
    for i, w in enumerate(text.split()):
        yield {"i": i, "word": w, "lang": lang}


def failing(text):
    yield {"n": 1}
    if "bad" in text:
        raise RuntimeError("no")
    if "type" in text:
        yield {"n": "x"}
    if "more" in text:
        yield {"n": 2, "m": 3}


def notes(spark):
    rows = [(1, "fr", "a b"), (2, "en", ""), (3, None, None), (4, None, "c"), (None, "de", "d d"), (1, "fr", "a b")]
    return spark.createDataFrame(rows, "note_id long, lang string, note_text string")


@pytest.mark.parametrize("limits", [(10_000, 4_000_000), (1, 10), (2, 1)])
def test_records_and_context(spark, rows, monkeypatch, limits):
    monkeypatch.setattr(job, "BATCH_RECORDS", limits[0])
    monkeypatch.setattr(job, "BATCH_CHARS", limits[1])
    out = extract(notes(spark), words, {"i": int, "word": "", "lang": T.StringType()}, context=("lang",))
    assert out.dtypes == [("note_id", "bigint"), ("i", "bigint"), ("word", "string"), ("lang", "string")]
    assert rows(out) == sorted([(1, 0, "a", "fr"), (1, 1, "b", "fr")] * 2 + [(4, 0, "c", None), (None, 0, "d", "de"), (None, 1, "d", "de")], key=repr)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_typed_schemas(spark, rows):
    assert record_schema("a int, b array<string>") == T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.ArrayType(T.StringType()))])
    assert record_schema({"a": 1.5, "b": bytes, "c": True}).simpleString() == "struct<a:double,b:binary,c:boolean>"
    with pytest.raises(TypeError):
        record_schema({"a": object()})
    day = datetime(2020, 1, 2, 3)
    nested = lambda text: [{"at": day, "parts": [{"x": 1}], "missing": None}, {}]
    out = extract(notes(spark).filter("note_id = 4"), nested, "at timestamp, parts array<struct<x: int>>, missing string")
    assert [(r.at, r.parts and r.parts[0].x, r.missing) for r in out.collect()] == [(day, 1, None), (None, None, None)]
    assert extract(notes(spark).limit(0), words, "i int").collect() == []
    assert extract(notes(spark), lambda text: None, "i int").collect() == []


def test_a_failing_document_is_named(spark, rows):
    df = spark.createDataFrame([(7, "good"), (8, "bad"), (9, "type"), (10, "more")], "note_id long, note_text string")
    for note, said in ((8, "RuntimeError: no"), (9, "Arrow"), (10, "the schema lacks")):
        with pytest.raises(Exception, match=f"note_id {note}") as error:
            extract(df.filter(F.col("note_id") == note), failing, "n long").collect()
        assert said in str(error.value)
    out = extract(df, failing, "n long", errors="report")
    got = {r.note_id: (r.n, r.error and r.error.split(":")[0]) for r in out.collect()}
    assert got == {7: (1, None), 8: (None, "RuntimeError"), 9: (None, got[9][1]), 10: (None, "KeyError")} and "Arrow" in got[9][1]
    for wrong in ({"errors": "skip"}, {"schema": "note_id long"}, {"schema": "error string", "errors": "report"}):
        with pytest.raises(ValueError):
            extract(df, failing, **{"schema": "n long", **wrong})


def test_table_locations(spark, rows, tmp_path):
    spark.range(5).repartition(2).write.parquet(f"{tmp_path}/five")
    for name in ("five_rows", "five_lines"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE five_rows USING parquet LOCATION '{tmp_path}/five'")
    spark.sql(f"CREATE TABLE five_lines (id bigint) USING json LOCATION '{tmp_path}/json'")
    spark.range(5).createOrReplaceTempView("five_view")
    folder, kind = table_location(spark, "five_rows")
    assert folder.endswith("/five") and kind == "parquet"
    assert rows(rows_per_file(spark, "five_rows")) == rows(rows_per_file(spark, f"{tmp_path}/five"))
    assert files_of(spark, "five_rows").count() == 2 and first_file(spark, "five_rows").count() > 0
    assert table_location(spark, "five_lines")[1] == "json"
    for name in ("five_view", "no_such_table"):
        with pytest.raises(ValueError):
            table_location(spark, name)
    with pytest.raises(ValueError):
        rows_per_file(spark, "five_lines")
    for name in ("five_rows", "five_lines"):
        spark.sql(f"DROP TABLE {name}")


def test_a_dataset_is_whole_or_refused(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, "a", "01"), (2, None, "01"), (3, "c", "dev"), (4, "d", None)], "id long, v string, set string")
    path = write_splits(df, f"{tmp_path}/data")
    assert rows(read_splits(spark, path, verify=True), "id", "v", "set") == rows(df)
    assert rows(spark.read.parquet(path).select("id")) == [(1,), (2,), (3,), (4,)]
    # a write that stopped ahead of the manifest
    df.write.partitionBy("set").parquet(f"{tmp_path}/half")
    with pytest.raises(ValueError, match="no manifest"):
        read_splits(spark, f"{tmp_path}/half")
    # one that went on after it
    df.limit(1).write.mode("append").partitionBy("set").parquet(path)
    with pytest.raises(ValueError, match="other rows"):
        read_splits(spark, path)
    # as many rows, other values
    path = write_splits(df, f"{tmp_path}/data")
    spark.createDataFrame([(9, "x", "dev")], df.schema).write.mode("overwrite").parquet(f"{tmp_path}/other")
    spark.read.parquet(f"{tmp_path}/other").drop("set").write.mode("overwrite").parquet(f"{path}/set=dev")
    assert read_splits(spark, path).count() == 4
    with pytest.raises(ValueError, match="other rows"):
        read_splits(spark, path, verify=True)
    empty = write_splits(df.limit(0), f"{tmp_path}/none")
    assert read_splits(spark, empty, verify=True).dtypes == df.dtypes
