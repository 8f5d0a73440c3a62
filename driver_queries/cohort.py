"""Cohort and code queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.functions.columns import code_prefixes, flatten_nested
from argentum.operators.joins import join_code_family
from argentum.plans.cohort import family_table, retrieve_codes, select_cohort
from driver_queries.inputs import CONDITIONS, FAMILIES, FAMILY_TABLE
from driver_queries.registry import query, with_

COHORT = """coded AS (
  SELECT c.*, f.cancer FROM conditions c JOIN families f
    ON substr(condition_source_value, 1, 3) = f.code OR substr(condition_source_value, 1, 4) = f.code
  WHERE condition_status_source_value IN ('F', 'O') AND cdm_source {source}),
counted AS (
  SELECT *, (SELECT count(DISTINCT cancer) FROM coded d WHERE d.person_id = coded.person_id) AS n_distinct_cancer FROM coded),
gaps AS (
  SELECT *, date_diff('day', lag(condition_start_datetime) OVER (PARTITION BY person_id, cancer ORDER BY condition_start_datetime),
                      condition_start_datetime) AS gap
  FROM counted {exclusion})"""

NEW_CASES = """SELECT person_id, cancer, min(n_distinct_cancer) AS n_distinct_cancer FROM gaps
WHERE (gap IS NULL OR gap > {days}) AND cancer IN ({types})
  AND condition_start_datetime >= TIMESTAMP '{start}' AND condition_start_datetime < TIMESTAMP '{end}'
GROUP BY person_id, cancer"""


@query(
    "cohort_new_cases",
    with_(
        CONDITIONS,
        FAMILY_TABLE,
        COHORT.format(source="= 'R'", exclusion="WHERE n_distinct_cancer = 1"),
        NEW_CASES.format(days=730, types="'alpha', 'beta'", start="1996-01-01", end="2001-06-01"),
    ),
)
def cohort_new_cases(t):
    return select_cohort(
        t.conditions, FAMILIES, ["alpha", "beta"], 2, "1996-01-01", "2001-06-01", source="R", statuses=["F", "O"]
    ).withColumn("n_distinct_cancer", F.col("n_distinct_cancer").cast("long"))


@query(
    "cohort_with_multiple_families",
    with_(
        CONDITIONS,
        FAMILY_TABLE,
        COHORT.format(source="IS NOT NULL", exclusion=""),
        NEW_CASES.format(days=365, types="'alpha', 'gamma'", start="1998-01-01", end="2000-01-01"),
    ),
)
def cohort_with_multiple_families(t):
    return select_cohort(
        t.conditions,
        FAMILIES,
        ["alpha", "gamma"],
        1,
        "1998-01-01",
        "2000-01-01",
        double_cancer_exclusion=False,
        statuses=["F", "O"],
    ).withColumn("n_distinct_cancer", F.col("n_distinct_cancer").cast("long"))


@query(
    "code_prefix_filter",
    with_(
        CONDITIONS,
        """SELECT person_id, visit_occurrence_id, condition_start_datetime, condition_source_value, cdm_source,
  substr(condition_source_value, 1, 3) AS short_2, substr(condition_source_value, 1, 4) AS short_3
FROM conditions WHERE condition_status_source_value = 'O'
  AND (substr(condition_source_value, 1, 3) IN ('B12', 'B031') OR substr(condition_source_value, 1, 4) IN ('B12', 'B031'))""",
    ),
)
def code_prefix_filter(t):
    found = retrieve_codes(t.conditions, ["B12", "B031"], statuses="O")
    return found.withColumnsRenamed(
        {"condition_source_value_short_2": "short_2", "condition_source_value_short_3": "short_3"}
    ).drop("condition_status_source_value")


@query(
    "code_family_join",
    with_(
        CONDITIONS,
        FAMILY_TABLE,
        """SELECT f.cancer, f.code, count(*) AS n_events, count(DISTINCT person_id) AS n_persons
FROM conditions c JOIN families f
  ON substr(condition_source_value, 1, 3) = f.code OR substr(condition_source_value, 1, 4) = f.code
GROUP BY f.cancer, f.code""",
    ),
)
def code_family_join(t):
    joined = join_code_family(t.conditions, family_table(t.spark, FAMILIES))
    # two levels, so that a code with a third of all rows still combines ahead of the shuffle
    return (
        joined.groupBy("cancer", "code", "person_id")
        .agg(F.count("*").alias("n"))
        .groupBy("cancer", "code")
        .agg(F.sum("n").alias("n_events"), F.count("*").alias("n_persons"))
    )


@query(
    "flatten_codes",
    """SELECT o_orderkey, unnest([CAST(o_custkey AS VARCHAR), o_orderstatus, o_orderpriority, CAST(o_orderkey AS VARCHAR)]) AS code FROM orders""",
)
def flatten_codes(t):
    text = lambda c: F.col(c).cast("string")
    nested = F.array(F.array(F.array(text("o_custkey")), F.array("o_orderstatus", "o_orderpriority")), F.array(F.array(text("o_orderkey"))))
    rows = t["orders"].select("o_orderkey", nested.alias("nested"))
    return rows.select("o_orderkey", F.explode(flatten_nested(rows, "nested")).alias("code"))


@query(
    "code_truncation",
    "SELECT substr(p_name, 1, 3) AS three, substr(p_name, 1, 4) AS four, count(*) AS n FROM part GROUP BY ALL",
)
def code_truncation(t):
    three, four = code_prefixes("p_name")
    return t["part"].groupBy(three.alias("three"), four.alias("four")).agg(F.count("*").alias("n"))
