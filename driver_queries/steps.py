"""Jobs around a user's steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.plans.steps import code_reader, procedure_dates, split_by, splitter, visit_filter, visits_of
from driver_queries.inputs import CODE_LIST, NOTES, PROCEDURES, SURGERY_FLAGS
from driver_queries.registry import query, with_

EXISTING = "existing AS (SELECT CAST(c_custkey AS VARCHAR) AS person_id FROM customer WHERE c_acctbal < 0)"


FLAGGED = f"coalesce({', '.join(SURGERY_FLAGS[1::2])}) IS NOT NULL"


def flagged_codes(codes):
    return codes.filter(FLAGGED)


@query(
    "procedures_by_steps",
    with_(
        PROCEDURES,
        CODE_LIST,
        "urgent AS (SELECT CAST(o_orderkey AS VARCHAR) AS visit_occurrence_id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))",
        f"""SELECT visit_occurrence_id, person_id, timezone('Europe/Paris', timezone('UTC', min(procedure_start_datetime))) AS procedure_date
FROM procedures WHERE procedure_source_value IN (SELECT "Code" FROM code_list WHERE {FLAGGED})
AND visit_occurrence_id IN (SELECT visit_occurrence_id FROM urgent) GROUP BY visit_occurrence_id, person_id""",
    ),
)
def procedures_by_steps(t):
    urgent = t["orders"].filter("o_orderpriority IN ('1-URGENT', '2-HIGH')").select(F.col("o_orderkey").cast("string").alias("visit_occurrence_id"))
    return procedure_dates(t.procedures, t.code_list, code_reader(flagged_codes), visit_filter(visits_of), visits=urgent)


def by_busiest(texts, n: int):
    """Persons with `n` texts or more are the test set, those with half of it dev."""
    size = texts.groupBy("person_id").agg(F.count("*").alias("n")).where(F.col("n") >= n / 2)
    return size.select("person_id", F.when(F.col("n") >= n, "test").otherwise("dev").alias("set"))


@query(
    "split_by_steps",
    with_(
        NOTES,
        EXISTING,
        "pool AS (SELECT * FROM notes WHERE note_class_source_value IN ('RCP', 'CR-ANAPATH') AND person_id NOT IN (SELECT person_id FROM existing))",
        "sizes AS (SELECT person_id, count(*) AS n FROM pool GROUP BY person_id)",
        """SELECT CASE WHEN n >= 16 THEN 'test' WHEN n >= 8 THEN 'dev' ELSE 'train' END AS set, pool.person_id, note_id, note_class_source_value
FROM pool JOIN sizes ON pool.person_id = sizes.person_id""",
    ),
)
def split_by_steps(t):
    known = t["customer"].filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("person_id"))
    found = split_by(t.notes, splitter(by_busiest), note_classes=["RCP", "CR-ANAPATH"], existing=[known], n=16)
    return found.select("set", "person_id", "note_id", "note_class_source_value")
