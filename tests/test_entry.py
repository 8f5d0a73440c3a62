import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from tools.check_oracle import TABLES, frame

#: May be registered without SQL.
WITHOUT_SQL = {name for name in entry.queries() if name == "pipeline" or name.startswith("op")}
SMOKE = [
    "cohort_new_cases",
    "documents_of_persons",
    "biopsy_reports",
    "earliest_procedure_per_visit",
    "known_dates",
    "mentions_context",
    "asof_nearest",
    "align_proximity",
    "split_three_way",
    "loss_profile_curves",
    "lrt_flip",
    "gold_merge",
    "export_balanced",
    "percentile_bounds",
]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def test_every_query_has_sql():
    assert set(entry.queries()) - set(entry.oracle_sql()) <= WITHOUT_SQL


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SMOKE)
def test_query_equals_sql(spark, con, name):
    got = frame(entry.queries()[name](spark, SMALL).toPandas())
    want = frame(con.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


@pytest.mark.parametrize("name", ["cohort_new_cases", "documents_of_persons", "asof_exact", "asof_nearest", "moving_loss", "code_family_join"])
def test_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["first_note", "last_note", "first_rows_per_class", "align_positives"])
def test_ranks_are_limited_ahead_of_the_shuffle(spark, name):
    plan = entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and plan.count("WindowGroupLimit") == 2


def test_extraction_does_not_shuffle(spark):
    from argentum.plans.mentions import extract_mentions

    notes = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id AS note_id", "source AS person_id", "text AS note_text")
    plan = extract_mentions(notes)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "lang" not in plan
