"""Scans of logical tables under canonical column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from argentum.operators.windows import keep_first_by
from argentum.sources.fixed_values import (
    CANONICAL_COLUMNS,
    CODE_SLICES,
    PHYSICAL_TABLES,
    STAY_GROUP_SLICE,
    STAY_LETTER_SLICE,
    UNKNOWN,
)

LAYOUTS = ("i2b2", "omop")


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Fail early, with the names, when columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def canonical(raw: DataFrame, table: str, db_type: str = "i2b2") -> DataFrame:
    """Project a physical table to its canonical columns; in the i2b2 layout also cut code prefixes."""
    mapping = CANONICAL_COLUMNS[table]
    if db_type == "omop":
        return require_columns(raw, mapping.values()).select(*mapping.values())
    if db_type != "i2b2":
        raise ValueError(f"`db_type` should be one of {LAYOUTS} and not {db_type}")

    require_columns(raw, mapping)
    columns = {new: F.col(old) for old, new in mapping.items()}
    if table in CODE_SLICES:
        name, start, length = CODE_SLICES[table]
        columns[name] = F.substring(columns[name], start, length)
    if table == "cost":
        group = columns.pop("concept_cd")
        columns["drg_source_value"] = F.substring(group, *STAY_GROUP_SLICE)
        columns["letter_ghm"] = F.substring(group, *STAY_LETTER_SLICE)
    return raw.select(*[column.alias(name) for name, column in columns.items()])


def one_row_per_note(documents: DataFrame, tie_break: list[str] | None = None) -> DataFrame:
    """One row per note id: the first in the order of `tie_break`, or of all other columns."""
    if tie_break is None:
        tie_break = [c for c in documents.columns if c != "note_id"]
    return keep_first_by(documents, ["note_id"], [F.col(c) for c in tie_break])


def enrich_care_sites(care_sites: DataFrame, names: DataFrame, unknown: str = UNKNOWN) -> DataFrame:
    """Distinct care sites with the columns of `names`; unmatched ones get `unknown`.

    `names` has `care_site_source_value` and any string columns. It is a hand-kept
    dimension: built with `literal_table` it carries its own size-checked hint.
    """
    extra = [c for c in names.columns if c != "care_site_source_value"]
    return (
        care_sites.distinct()
        .join(names, "care_site_source_value", "left")
        .na.fill(unknown, subset=extra)
    )


def scan(
    raw: DataFrame,
    table: str,
    db_type: str = "i2b2",
    rename_cols: dict[str, str] | None = None,
    select_cols: list[str] | None = None,
    care_site_names: DataFrame | None = None,
) -> DataFrame:
    """Canonical scan of a physical table, with the per-table rules of the i2b2 layout."""
    df = canonical(raw, table, db_type)
    if db_type == "i2b2":
        if table == "documents":
            df = one_row_per_note(df)
        elif table == "care_site":
            df = df.distinct() if care_site_names is None else enrich_care_sites(df, care_site_names)
    if rename_cols:
        df = df.withColumnsRenamed(rename_cols)
    return df.select(*select_cols) if select_cols else df


def get_table(
    spark: SparkSession,
    table: str,
    db: str,
    db_type: str = "i2b2",
    production: bool = False,
    **options,
) -> DataFrame:
    """Scan a logical table of database `db`; `production` picks the production table names."""
    if db_type not in LAYOUTS:
        raise ValueError(f"`db_type` should be one of {LAYOUTS} and not {db_type}")
    layout = "i2b2_production" if production and db_type == "i2b2" else db_type
    return scan(spark.table(f"{db}.{PHYSICAL_TABLES[layout][table]}"), table, db_type, **options)
