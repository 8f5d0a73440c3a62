"""Person-disjoint splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.plans.align import align
from argentum.plans.splits import (
    split_dev_alignable,
    split_dev_prealigned,
    split_existing,
    split_n_persons,
    split_test,
    split_three_way,
)
from argentum.session import stage
from driver_queries.alignment import ALIGNED, CANDIDATES, EXAMPLES, MATCHES, UNIFORM
from driver_queries.inputs import KNOWN, MENTIONS, NOTES
from driver_queries.registry import query, with_

H = "md5(concat_ws(':', person_id, '{seed}'))"
EXISTING = "existing AS (SELECT CAST(c_custkey AS VARCHAR) AS person_id FROM customer WHERE c_acctbal < 0)"
SMALL = "note_id, person_id, note_datetime, note_class_source_value"
LAST_OF = """SELECT person_id, {cols} FROM ({source}) GROUP BY person_id"""
_LAST = "arg_max({c}, (note_datetime, note_id)) FILTER ({c} IS NOT NULL) AS {c}"
LAST_COLUMNS = ", ".join(_LAST.format(c=c) for c in ("note_id", "note_datetime", "note_class_source_value", "note_text"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def existing(t) -> DataFrame:
    return t["customer"].filter("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("person_id"))


def pick(source: str, n: int, seed: int) -> str:
    return f"SELECT person_id FROM (SELECT DISTINCT person_id FROM {source}) ORDER BY {H.format(seed=seed)}, person_id LIMIT {n}"


@query(
    "split_test",
    with_(
        NOTES,
        EXISTING,
        f"pool AS (SELECT {SMALL} FROM notes WHERE note_class_source_value = 'RCP' AND person_id NOT IN (SELECT person_id FROM existing))",
        f"chosen AS ({pick('pool', 200, 29)})",
        f"SELECT CASE WHEN person_id IN (SELECT person_id FROM chosen) THEN 'test' ELSE 'not test' END AS set, {SMALL} FROM pool",
    ),
)
def split_test_query(t):
    other, test = split_test(t.notes, 200, 29, ["RCP"], [existing(t)])
    return union(other, test).select("set", *SMALL.split(", "))


@query(
    "split_existing",
    with_(
        NOTES,
        EXISTING,
        f"SELECT {SMALL} FROM notes WHERE note_class_source_value = 'RCP' AND person_id NOT IN (SELECT person_id FROM existing)",
    ),
)
def split_existing_query(t):
    train, _ = split_existing(t.notes, [existing(t)], ["RCP"])
    return train.select(*SMALL.split(", "))


@query(
    "split_three_way",
    with_(
        NOTES,
        f"ranked AS (SELECT person_id, row_number() OVER (ORDER BY {H.format(seed=7)}, person_id) AS r FROM (SELECT DISTINCT person_id FROM notes))",
        "tagged AS (SELECT notes.*, CASE WHEN r <= 50 THEN 'dev' WHEN r <= 250 THEN 'test' ELSE 'train' END AS set FROM notes JOIN ranked USING (person_id))",
        f"lasts AS ({LAST_OF.format(cols=LAST_COLUMNS, source=chr(34) + 'tagged' + chr(34) + '')})".replace('("tagged")', "tagged").replace("FROM tagged GROUP", "FROM tagged WHERE set = 'dev' GROUP"),
        """SELECT set, person_id, note_id, note_datetime FROM tagged WHERE set <> 'dev'
UNION ALL SELECT 'dev', person_id, note_id, note_datetime FROM lasts""",
    ),
)
def split_three_way_query(t):
    return union(*split_three_way(t.notes, 200, 50, 7)).select("set", "person_id", "note_id", "note_datetime")


@query(
    "split_n_persons",
    with_(
        NOTES,
        f"chosen AS ({pick('notes', 60, 0)})",
        f"SELECT CASE WHEN person_id IN (SELECT person_id FROM chosen) THEN 'train' ELSE 'val' END AS set, {SMALL} FROM notes",
    ),
)
def split_n_persons_query(t):
    return union(*split_n_persons(t.notes, 60, 0)).select("set", *SMALL.split(", "))


#: Dates of pending orders: every one is known, and many persons have none.
PENDING_KNOWN = """known AS (SELECT CAST(o_custkey AS VARCHAR) AS person_id, o_orderdate AS known_date, 1 AS label
  FROM orders WHERE o_orderstatus = 'P' GROUP BY ALL)"""
ALIGNED_EXAMPLES = ",\n".join([ALIGNED, MATCHES, CANDIDATES, UNIFORM.format(k=1), EXAMPLES])


def known_reports(t) -> DataFrame:
    pending = t["orders"].filter("o_orderstatus = 'P'")
    return pending.select(
        F.col("o_custkey").cast("string").alias("person_id"), F.col("o_orderdate").cast("timestamp").alias("known_date"), F.lit(1).alias("label")
    ).distinct()

DEV = f"""dev_matched AS ({{matched_pick}}),
dev_without AS ({{without_pick}}),
dev_texts AS (
  SELECT notes.* FROM notes WHERE note_id IN (SELECT note_id FROM matched WHERE person_id IN (SELECT person_id FROM dev_matched))
  UNION ALL SELECT notes.* FROM notes WHERE person_id IN (SELECT person_id FROM dev_without)),
dev AS (SELECT person_id, {LAST_COLUMNS} FROM dev_texts GROUP BY person_id)"""
DEV_ROWS = """SELECT 'dev' AS set, CASE WHEN person_id IN (SELECT person_id FROM dev_matched) THEN 'dev matched' ELSE 'dev without cr' END
  AS alignment, person_id, note_id, note_datetime FROM dev"""


@query(
    "split_dev_alignable",
    with_(
        NOTES,
        MENTIONS.replace("FROM notes, unnest", "FROM notes, unnest"),
        PENDING_KNOWN,
        ALIGNED_EXAMPLES.replace(
            "once AS (SELECT * FROM mentions WHERE",
            f"test_persons AS ({pick('notes', 200, 29)}),\nonce AS (SELECT * FROM mentions WHERE person_id NOT IN (SELECT person_id FROM test_persons) AND",
        ),
        "matched_examples AS (SELECT DISTINCT person_id, note_id FROM examples WHERE label = 1)",
        "rest AS (SELECT * FROM notes WHERE person_id NOT IN (SELECT person_id FROM test_persons))",
        DEV.replace("FROM matched WHERE", "FROM matched_examples WHERE").format(
            matched_pick=pick("matched_examples", 20, 29),
            without_pick=pick("rest WHERE person_id NOT IN (SELECT person_id FROM known)", 20, 29),
        ),
        DEV_ROWS
        + """ UNION ALL
SELECT CASE WHEN person_id IN (SELECT person_id FROM test_persons) THEN 'test' ELSE 'train' END, NULL, person_id, note_id, note_datetime
FROM notes WHERE person_id NOT IN (SELECT person_id FROM dev_matched UNION SELECT person_id FROM dev_without)""",
    ),
)
def split_dev_alignable_query(t):
    known = known_reports(t)
    aligner = lambda texts: align(known, texts, negatives="uniform")
    parts = split_dev_alignable(t.notes, known, aligner, 200, 20, 20, 29)
    return union(*parts).select("set", "alignment", "person_id", "note_id", "note_datetime")


@query(
    "split_dev_prealigned",
    with_(
        NOTES,
        MENTIONS,
        PENDING_KNOWN,
        ALIGNED_EXAMPLES,
        "matched_examples AS (SELECT DISTINCT person_id, note_id FROM examples WHERE label = 1)",
        DEV.replace("FROM matched WHERE", "FROM matched_examples WHERE").format(
            matched_pick=pick("matched_examples", 15, 4),
            without_pick=pick("notes WHERE person_id NOT IN (SELECT person_id FROM known)", 10, 4),
        ),
        """SELECT 'train' AS set, NULL AS alignment, person_id, note_id, CAST(label AS VARCHAR) AS label,
  CAST(row_number() OVER (ORDER BY note_id, text_start_char, text_end_char, label) - 1 AS VARCHAR) AS text_id
FROM examples WHERE person_id NOT IN (SELECT person_id FROM dev_matched)
UNION ALL SELECT 'dev', CASE WHEN person_id IN (SELECT person_id FROM dev_matched) THEN 'dev matched' ELSE 'dev without cr' END,
  person_id, note_id, NULL, NULL FROM dev""",
    ),
)
def split_dev_prealigned_query(t):
    known = known_reports(t)
    aligned = stage(align(known, t.notes, negatives="uniform"), "examples")
    train, dev = split_dev_prealigned(t.notes, known, aligned, 15, 10, 4)
    numbers = [F.col(c).cast("string").alias(c) for c in ("label", "text_id")]
    return union(train, dev).select("set", "alignment", "person_id", "note_id", *numbers)
