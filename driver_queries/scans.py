"""Scans, reads and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from argentum.functions.columns import decode, parse_or_drop, replace_missing_letters, to_zone
from argentum.operators.joins import lookup
from argentum.session import literal_table, staging_dir
from argentum.sources.fixed_values import CANONICAL_COLUMNS, CODE_SLICES, DIAGNOSIS_RANK, DISCHARGE_MODE, SEX, VISIT_TYPE
from argentum.sources.readers import filtered_read, first_file, read_codes, rows_per_file
from argentum.sources.tables import enrich_care_sites, one_row_per_note, scan
from driver_queries.inputs import CODE_LIST, CONDITIONS, NOTES
from driver_queries.registry import query, with_


@query(
    "scan_normalised_codes",
    with_(
        CONDITIONS,
        """SELECT person_id, visit_occurrence_id, 'L' || visit_occurrence_id AS condition_occurrence_id,
  condition_start_datetime, condition_source_value, condition_status_source_value, cdm_source FROM conditions""",
    ),
)
def scan_normalised_codes(t):
    raw = t.conditions.select(
        F.col("person_id").alias("patient_num"),
        F.col("visit_occurrence_id").alias("encounter_num"),
        F.concat(F.lit("L"), "visit_occurrence_id").alias("instance_num"),
        F.col("condition_start_datetime").alias("start_date"),
        F.concat(F.lit("CIM10:"), "condition_source_value").alias("concept_cd"),
        F.col("condition_status_source_value").alias("tval_char"),
        F.col("cdm_source").alias("sourcesystem_cd"),
    )
    return scan(raw, "icd10")


@query(
    "scan_stay_groups",
    """SELECT CAST(o_custkey AS VARCHAR) AS person_id, CAST(o_orderkey AS VARCHAR) AS visit,
  o_orderdate AS incurred_datetime, substr(o_orderpriority, 1, 20) AS drg_source_value,
  substr(o_orderpriority, 3, 1) AS letter_ghm FROM orders""",
)
def scan_stay_groups(t):
    raw = t["orders"].select(
        F.col("o_custkey").cast("string").alias("patient_num"),
        F.col("o_orderkey").cast("string").alias("encounter_num"),
        F.lit("-").alias("instance_num"),
        F.col("o_orderdate").alias("start_date"),
        F.concat(F.lit("GHM:"), "o_orderpriority").alias("concept_cd"),
        F.col("o_orderstatus").alias("sourcesystem_cd"),
    )
    return scan(
        raw,
        "cost",
        rename_cols={"visit_occurrence_id": "visit"},
        select_cols=["person_id", "visit", "incurred_datetime", "drg_source_value", "letter_ghm"],
    )


@query(
    "scan_documents_one_per_note",
    """SELECT note_id, arg_min(note_title, doc_id) AS note_title, min(doc_id) AS first_doc FROM (
  SELECT source || '-' || lang || '-' || CAST(n_chars AS VARCHAR) AS note_id, text AS note_title, doc_id FROM documents)
GROUP BY note_id""",
)
def scan_documents_one_per_note(t):
    key = F.concat_ws("-", "source", "lang", F.col("n_chars").cast("string"))
    docs = t["documents"].select(key.alias("note_id"), F.col("text").alias("note_title"), F.col("doc_id").alias("first_doc"))
    return one_row_per_note(docs, ["first_doc"])


@query(
    "care_site_enriched",
    """SELECT DISTINCT substr('UFR:' || lpad(CAST(s_nationkey AS VARCHAR), 3, '0'), 5, 3) AS care_site_source_value,
  coalesce(n_name, 'INCONNU') AS care_site_name, coalesce(r_name, 'INCONNU') AS cd_long_gh
FROM supplier LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 2)
  ON s_nationkey = n_nationkey""",
)
def care_site_enriched(t):
    names = (
        t["nation"]
        .join(t["region"].filter("r_regionkey <> 2"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("care_site_source_value"),
            F.col("n_name").alias("care_site_name"),
            F.col("r_name").alias("cd_long_gh"),
        )
    )
    raw = t["supplier"].select(
        F.concat(F.lit("UFR:"), F.lpad(F.col("s_nationkey").cast("string"), 3, "0")).alias("location_cd"),
        F.lit("visit").alias("encounter_num"),
    )
    return enrich_care_sites(scan(raw, "care_site").select("care_site_source_value"), names)


@query(
    "filtered_projected_read",
    """SELECT o_orderkey, o_custkey, o_orderdate + INTERVAL 0 HOUR AS o_orderdate FROM orders
WHERE o_orderpriority IN ('1-URGENT', '5-LOW') AND o_orderpriority NOT IN ('5-LOW', '2-HIGH')""",
)
def filtered_projected_read(t):
    return filtered_read(
        t["orders"],
        keep=["1-URGENT", "5-LOW"],
        avoid=["5-LOW", "2-HIGH"],
        key="o_orderpriority",
        columns=["o_orderkey", "o_custkey", "o_orderdate"],
    )


@query(
    "filtered_read_by_table",
    """SELECT o_custkey, count(*) AS n FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY'))
  AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY o_custkey""",
)
def filtered_read_by_table(t):
    persons = t["customer"].withColumnRenamed("c_custkey", "o_custkey")
    kept = filtered_read(
        t["orders"],
        keep=persons.filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")),
        avoid=persons.filter("c_acctbal < 0"),
        key="o_custkey",
        columns=["o_custkey"],
    )
    return kept.groupBy("o_custkey").agg(F.count("*").alias("n"))


@query(
    "filtered_read_null_keys",
    """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority FROM orders
WHERE o_orderstatus = 'P' OR o_orderpriority NOT IN ('5-LOW', '2-HIGH')""",
)
def filtered_read_null_keys(t):
    priority = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    rows = t["orders"].select("o_orderkey", priority.alias("priority"))
    short = filtered_read(rows, avoid=["5-LOW"], key="priority")
    # as a join, as for long lists
    return filtered_read(short, avoid=literal_table(t.spark, [("2-HIGH",)], "priority string"), key="priority")


def several_files(t) -> str:
    """Suppliers by key modulo 3 in a folder each, and an empty file ahead of them."""
    rows, path = t["supplier"].select("s_suppkey", "s_nationkey"), f"{staging_dir(t.spark)}/argentum-files-{uuid.uuid4().hex}"
    rows.limit(0).coalesce(1).write.parquet(f"{path}/part=0")
    for k in range(3):
        rows.filter(F.col("s_suppkey") % 3 == k).coalesce(1).write.parquet(f"{path}/part={k + 1}")
    return path


@query(
    "rows_per_file",
    """SELECT 'part=' || CAST(s_suppkey % 3 + 1 AS VARCHAR) AS folder, count(*) AS n_rows FROM supplier GROUP BY ALL UNION ALL SELECT 'part=0', 0""",
)
def rows_per_file_query(t):
    counts = rows_per_file(t.spark, several_files(t))
    return counts.select(F.element_at(F.split("file_path", "/"), -2).alias("folder"), "n_rows")


@query("peek_first_file", "SELECT s_suppkey, s_nationkey FROM supplier WHERE s_suppkey % 3 = 0")
def peek_first_file(t):
    return first_file(t.spark, several_files(t)).select("s_suppkey", "s_nationkey")


@query(
    "scan_documents",
    """SELECT note_id, min(note_text) AS note_text, CAST(min(n) AS BIGINT) AS n_rows FROM (
  SELECT source || '-' || lang || '-' || CAST(n_chars AS VARCHAR) AS note_id, text AS note_text,
    count(*) OVER (PARTITION BY source, lang, n_chars) AS n FROM documents) GROUP BY note_id""",
)
def scan_documents(t):
    key = F.concat_ws("-", "source", "lang", F.col("n_chars").cast("string"))
    raw = t["documents"].select(
        key.alias("instance_num"),
        F.lit("2020-01-01").cast("timestamp").alias("start_date"),
        F.lit("class").alias("concept_cd"),
        F.lit("v").alias("encounter_num"),
        F.lit("p").alias("patient_num"),
        F.col("text").alias("observation_blob"),
        F.lit("title").alias("provider_id"),
        F.lit("s").alias("sourcesystem_cd"),
    )
    counts = raw.groupBy(F.col("instance_num").alias("note_id")).agg(F.count("*").alias("n_rows"))
    return scan(raw, "documents").select("note_id", "note_text").join(counts, "note_id")


def _raw_lines(t, table: str, code: str):
    """Order lines in the physical columns of a logical table."""
    values = {
        "person_id": F.col("o_custkey").cast("string"),
        "visit_occurrence_id": F.col("l_orderkey").cast("string"),
        code: F.concat(F.lit("CODE:"), F.lpad(F.col("l_partkey").cast("string"), 6, "0"), F.lit(":tail")),
    }
    filler = lambda name: F.col("l_shipdate") if name.endswith("datetime") else F.concat(F.lit("x"), F.col("l_linenumber").cast("string"))
    columns = {old: values.get(new, filler(new)).alias(old) for old, new in CANONICAL_COLUMNS[table].items()}
    return t.lines_of_orders.select(*columns.values())


def _slice_sql(table: str) -> str:
    name, start, length = CODE_SLICES[table]
    return f"""SELECT CAST(l_orderkey AS VARCHAR) AS visit_occurrence_id,
  substr('CODE:' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') || ':tail', {start}, {length}) AS {name}
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""


def _scan_slice(table: str):
    name = CODE_SLICES[table][0]
    return lambda t: scan(_raw_lines(t, table, name), table, select_cols=["visit_occurrence_id", name])


for _table in ("procedure", "visit_detail", "biology"):
    query(f"scan_{_table}", _slice_sql(_table))(_scan_slice(_table))


@query(
    "diagnosis_rank",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS rank FROM orders",
)
def diagnosis_rank(t):
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "DP").when(F.col("o_orderpriority") == "2-HIGH", "DR").when(F.col("o_orderpriority") == "3-MEDIUM", "DAS")
    return t["orders"].select("o_orderkey", status.alias("status")).select("o_orderkey", decode("status", DIAGNOSIS_RANK).alias("rank"))


@query(
    "code_list_any_flag",
    with_(
        CODE_LIST,
        """SELECT "Code", min("Libelle") AS "Libelle" FROM code_list WHERE coalesce(Exerese_abdo_pelvien, Exerese_ORL,
  Exerese_thoracique, Exerese_sein, Exerese_estomac, Exerese_foie, Exerese_oesophage, Exerese_pancreas, Exerese_rectum,
  Omentectomie_laparo, Omentectomie_coelio, Autres_resections_coelio) IS NOT NULL GROUP BY "Code" """,
    ),
)
def code_list_any_flag(t):
    return read_codes(t.code_list)


@query(
    "code_value_decode",
    """SELECT o_orderkey,
  CASE o_orderstatus WHEN 'O' THEN 'Ext' END AS visit_type,
  CASE substr(o_orderpriority, 3, 1) WHEN 'M' THEN 'm' ELSE '?' END AS sex,
  CASE CASE o_orderpriority WHEN '1-URGENT' THEN '6-DC' WHEN '2-HIGH' THEN 'M' ELSE o_orderpriority END
    WHEN '6-DC' THEN '03' WHEN 'M' THEN 'Non Renseigné' END AS discharge FROM orders""",
)
def code_value_decode(t):
    mode = F.when(F.col("o_orderpriority") == "1-URGENT", "6-DC").when(F.col("o_orderpriority") == "2-HIGH", "M")
    return t["orders"].select(
        "o_orderkey",
        decode("o_orderstatus", VISIT_TYPE).alias("visit_type"),
        decode(F.substring("o_orderpriority", 3, 1), SEX, "?").alias("sex"),
        decode(F.coalesce(mode, F.col("o_orderpriority")), DISCHARGE_MODE).alias("discharge"),
    )


@query(
    "lookup_with_fill",
    """SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 END, 0) AS rank
FROM orders""",
)
def lookup_with_fill(t):
    ranks = literal_table(t.spark, [("1-URGENT", 1), ("2-HIGH", 2)], "o_orderpriority string, rank int")
    return lookup(t["orders"], ranks, "o_orderpriority", {"rank": 0}).select("o_orderkey", "rank")


@query(
    "timestamps_in_zone",
    """SELECT event_id, timezone('Europe/Paris', timezone('UTC', ts)) AS ts FROM events""",
)
def timestamps_in_zone(t):
    return to_zone(t["events"].select("event_id", "ts"), "Europe/Paris")


@query(
    "parse_or_drop",
    r"""SELECT event_id, CAST(try_strptime(s, '%Y-%m-%d') AS TIMESTAMP) AS day FROM (
  SELECT event_id, CASE WHEN event_type = 'error' THEN 'not a date' WHEN event_type = 'view' THEN '2024-02-30'
    ELSE strftime(ts, '%Y-%m-%d') END AS s FROM events) WHERE try_strptime(s, '%Y-%m-%d') IS NOT NULL""",
)
def parse_or_drop_query(t):
    text = (
        F.when(F.col("event_type") == "error", "not a date")
        .when(F.col("event_type") == "view", "2024-02-30")
        .otherwise(F.date_format("ts", "yyyy-MM-dd"))
    )
    return parse_or_drop(t["events"].select("event_id", text.alias("day")), "day", "yyyy-MM-dd")


@query("missing_letters", "SELECT doc_id, translate(text, 'üö', 'uo') AS text FROM documents")
def missing_letters(t):
    return t["documents"].select("doc_id", replace_missing_letters("text").alias("text"))


@query(
    "note_columns_renamed",
    with_(NOTES, "SELECT note_id AS id, person_id AS person, note_class_source_value AS class, 'silver' AS set FROM notes"),
)
def note_columns_renamed(t):
    renamed = t.notes.withColumnsRenamed(
        {"note_id": "id", "person_id": "person", "note_class_source_value": "class"}
    )
    return renamed.select("id", "person", "class", F.lit("silver").alias("set"))
