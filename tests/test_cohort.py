from datetime import datetime, timedelta

import pytest

from argentum.operators.joins import join_code_family
from argentum.plans.cohort import family_table, retrieve_codes, select_cohort

FAMILIES = {"lung": ["C34", "C341"], "colon": ["C18"], "skin": ["C449"]}
SCHEMA = """person_id string, visit_occurrence_id string, condition_start_datetime timestamp,
condition_source_value string, condition_status_source_value string, cdm_source string"""
DAY = datetime(2020, 3, 1, 10)


def events(spark, *items):
    full = [(p, f"v{i}", ts, code, "DP", "AREM", *rest)[:6] for i, (p, ts, code, *rest) in enumerate(items)]
    return spark.createDataFrame(full, SCHEMA)


def cohort(df, types=("lung", "colon"), **options):
    return {
        (r.person_id, r.cancer, r.n_distinct_cancer)
        for r in select_cohort(df, FAMILIES, list(types), 2, "2020-01-01", "2021-01-01", **options).collect()
    }


def test_washout_edge(spark):
    df = events(
        spark,
        ("inside", DAY - timedelta(days=730), "C34"),
        ("inside", DAY, "C34"),
        ("outside", DAY - timedelta(days=731), "C34"),
        ("outside", DAY, "C34"),
        ("first", DAY, "C349"),
    )
    assert cohort(df) == {("outside", "lung", 1), ("first", "lung", 1)}


def test_gap_is_to_the_previous_code_not_to_the_first(spark):
    first, recent = DAY - timedelta(days=3000), DAY - timedelta(days=100)
    df = events(spark, ("p", first, "C34"), ("p", recent, "C34"), ("p", DAY, "C34"))
    # the recent code reopens the case, before the study window; the last one is no new case
    assert cohort(df) == set()


def test_second_family_excludes_even_when_not_wanted(spark):
    df = events(spark, ("p", DAY, "C34"), ("p", DAY, "C449"), ("q", DAY, "C44"))
    assert cohort(df) == set()
    assert cohort(df, double_cancer_exclusion=False) == {("p", "lung", 2)}


def test_half_open_range_source_and_status(spark):
    df = events(
        spark,
        ("start", datetime(2020, 1, 1), "C18"),
        ("end", datetime(2021, 1, 1), "C18"),
        ("null", None, "C18"),
    )
    assert cohort(df, source="AREM", statuses=["DP", "DR"]) == {("start", "colon", 1)}
    assert cohort(df, source="OTHER") == set()
    assert cohort(df, statuses="DR") == set()


def test_events_of_one_day_combine(spark):
    df = events(spark, *[("p", DAY + timedelta(minutes=i), "C34") for i in range(50)])
    out = select_cohort(
        df, FAMILIES, ["lung"], 2, "2020-03-01 10:00:00", "2021-01-01", columns=["person_id", "condition_start_datetime", "visit_occurrence_id"]
    ).collect()
    assert [(r.condition_start_datetime, r.visit_occurrence_id) for r in out] == [(DAY, "v0")]
    # the first event of the day is before the window, and later ones of that day are no new cases
    late = select_cohort(df, FAMILIES, ["lung"], 2, "2020-03-01 10:10:00", "2021-01-01")
    assert late.count() == 0


def test_code_join_equals_disjunction(spark):
    df = events(spark, ("a", DAY, "C34"), ("b", DAY, "C3412"), ("c", DAY, "C3"), ("d", DAY, "C18"), ("e", DAY, None))
    families = family_table(spark, FAMILIES)
    joined = join_code_family(df, families)
    got = sorted((r.person_id, r.code) for r in joined.collect())
    assert got == [("a", "C34"), ("b", "C34"), ("b", "C341"), ("d", "C18")]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_code_filters(spark):
    df = events(spark, ("a", DAY, "C341"), ("b", DAY, "C18"))
    assert [r.person_id for r in retrieve_codes(df, "C34").collect()] == ["a"]
    assert retrieve_codes(df, ["C18", "C341"]).count() == 2
    with pytest.raises(TypeError):
        retrieve_codes(df, 34)
    with pytest.raises(TypeError):
        retrieve_codes(df, statuses=3)


def test_debug_sample_and_hot_person(spark):
    hot = [("hot", DAY + timedelta(seconds=i), "C34") for i in range(2000)]
    df = events(spark, *hot, *[(f"p{i}", DAY, "C18") for i in range(20)])
    assert len(cohort(df)) == 21
    assert len(cohort(df, debug_sample=5)) == 5
    with pytest.raises(ValueError):
        select_cohort(df, FAMILIES, ["lung"], -1, "2020-01-01", "2021-01-01")
