"""Records by a user's function, tables of the catalog, whole datasets."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from argentum.plans.extract import extract
from argentum.session import staging_dir
from argentum.sources.readers import read_splits, rows_per_file, table_location
from argentum.sources.sinks import write_splits
from driver_queries.registry import query


def numbered_lines(text: str, lang: str):
    """A user's callback: lines with a digit, their first number and its length."""
    for i, line in enumerate(text.split("\n")):
        number = re.search("[0-9]+", line)
        if number:
            yield {"line": i, "number": number.group(), "n_digits": len(number.group()), "place": f"{lang}:{i}"}


@query(
    "extracted_records",
    """WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, CAST(i AS BIGINT) AS line, regexp_extract(s, '[0-9]+') AS number, CAST(length(regexp_extract(s, '[0-9]+')) AS BIGINT) AS n_digits,
  lang || ':' || i AS place FROM l WHERE regexp_matches(s, '[0-9]')""",
)
def extracted_records(t):
    schema = {"line": int, "number": str, "n_digits": 0, "place": ""}
    return extract(t["documents"], numbered_lines, schema, ("doc_id",), ("lang",), "text")


def strict_lengths(text: str):
    """A callback that fails at some documents."""
    if "1" in text[:200]:
        raise ValueError(f"digit at {text.index('1')}")
    yield {"n": len(text)}


@query(
    "extraction_errors",
    """SELECT doc_id, CASE WHEN contains(substr(text, 1, 200), '1') THEN NULL ELSE CAST(length(text) AS BIGINT) END AS n,
  CASE WHEN contains(substr(text, 1, 200), '1') THEN 'ValueError: digit at ' || (instr(text, '1') - 1) END AS error FROM documents""",
)
def extraction_errors(t):
    return extract(t["documents"], strict_lengths, "n long", ("doc_id",), (), "text", "report")


@query("rows_of_catalog_table", "SELECT 'parquet' AS format, CAST(count(*) AS BIGINT) AS n_rows FROM orders")
def rows_of_catalog_table(t):
    name = "argentum_orders_of_catalog"
    t.spark.sql(f"DROP TABLE IF EXISTS {name}")
    t.spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{t.folder}/orders.parquet'")
    folder, kind = table_location(t.spark, name)
    return rows_per_file(t.spark, folder).groupBy(F.lit(kind).alias("format")).agg(F.sum("n_rows").alias("n_rows"))


@query(
    "dataset_with_manifest",
    "SELECT CASE WHEN o_custkey % 5 = 0 THEN 'dev' ELSE 'train' END AS set, CAST(count(*) AS BIGINT) AS n_rows, sum(o_orderkey)::BIGINT AS total FROM orders GROUP BY ALL",
)
def dataset_with_manifest(t):
    rows = t["orders"].select("o_orderkey", "o_totalprice", F.when(F.col("o_custkey") % 5 == 0, "dev").otherwise("train").alias("set"))
    path = write_splits(rows, f"{staging_dir(t.spark)}/argentum-splits-{uuid.uuid4().hex}")
    return read_splits(t.spark, path, verify=True).groupBy("set").agg(F.count("*").alias("n_rows"), F.sum("o_orderkey").alias("total"))
