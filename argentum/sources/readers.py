"""Dataset readers: dispatch by path, filtered reads, per-file facts, code lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argentum.functions.columns import to_zone
from argentum.sources.fixed_values import SURGERY_FLAGS

#: Longer value lists become a join instead of a literal list in the plan.
MAX_LITERALS = 1_000


def read_any(spark: SparkSession, path: str | None, schema=None, **names: str) -> DataFrame | None:
    """Read csv or parquet by the suffix of `path`; `{name}` parts are filled from `names`."""
    if path is None:
        return None
    if names:
        path = path.format(**names)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.csv(path, header=True) if path.endswith("csv") else reader.parquet(path)


def filtered_read(
    df: DataFrame,
    keep: list | DataFrame | None = None,
    avoid: list | DataFrame | None = None,
    key: str = "person_id",
    columns: list[str] | None = None,
    zone: str | None = None,
) -> DataFrame:
    """Rows whose key is in `keep` and not in `avoid`, projected to `columns`.

    Short lists stay literals, so they reach the parquet scan as pushed filters; long lists
    and DataFrames become semi and anti joins. Both follow one rule for nulls: a null key is
    a value like any other. It is kept if `keep` holds a null, and it is dropped only if
    `avoid` holds one.
    """
    for values, wanted in ((keep, True), (avoid, False)):
        if values is None or (isinstance(values, list) and not values):
            continue
        if isinstance(values, list) and len(values) <= MAX_LITERALS:
            listed = F.col(key).isin([v for v in values if v is not None])
            listed = F.coalesce(listed, F.lit(None in values))
            df = df.filter(listed if wanted else ~listed)
            continue
        if isinstance(values, list):
            values = df.sparkSession.createDataFrame([(v,) for v in values], df.select(key).schema)
        values = values.select(F.col(key).alias("_listed")).distinct()
        df = df.join(values, F.col(key).eqNullSafe(F.col("_listed")), "left_semi" if wanted else "left_anti")
    if columns:
        df = df.select(*columns)
    return to_zone(df, zone) if zone else df


def table_location(spark: SparkSession, name: str) -> tuple[str, str]:
    """(folder, format) of a table of the catalog; views, which have no files, and missing tables raise."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no table {name}")
    described = json.loads(spark.sql(f"DESCRIBE EXTENDED {name} AS JSON").first()[0])
    if "VIEW" in described.get("type", "VIEW") or "location" not in described:
        raise ValueError(f"{name} has no files of its own")
    return described["location"], described.get("provider", "parquet").lower()


def location_of(spark: SparkSession, table: str) -> str:
    """The folder of a Parquet table of the catalog; anything else is a path."""
    if "/" in table or not spark.catalog.tableExists(table):
        return table
    folder, kind = table_location(spark, table)
    if kind != "parquet":
        raise ValueError(f"{table} is kept as {kind}")
    return folder


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the data files under a path or of a table, empty ones included, without reading them."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    return reader.load(location_of(spark, path)).select(_plain(F.col("path")).alias("file_path"))


def _plain(path):
    # listed paths and metadata paths differ in the slashes after the scheme
    return F.regexp_replace(path, "^file:/+", "/")


def rows_per_file(spark: SparkSession, path: str) -> DataFrame:
    """Row count of every file of a dataset (a path, or a table of the catalog), empty files included."""
    path = location_of(spark, path)
    counts = spark.read.parquet(path).groupBy(_plain(F.col("_metadata.file_path")).alias("file_path")).agg(F.count("*").alias("n_rows"))
    return files_of(spark, path).join(counts, "file_path", "left").na.fill(0, subset=["n_rows"])


def first_file(spark: SparkSession, path: str, at_once: int = 16) -> DataFrame:
    """The rows of the first non-empty file of a dataset (a path, or a table); opens files in order, a few at a time."""
    path = location_of(spark, path)
    files, last = files_of(spark, path), ""
    while True:
        some = [r["file_path"] for r in files.filter(F.col("file_path") > last).orderBy("file_path").limit(at_once).collect()]
        if not some:
            return spark.read.parquet(path).limit(0)
        found = spark.read.parquet(*some).select(F.min(_plain(F.col("_metadata.file_path")))).first()[0]
        if found:
            whole = spark.read.parquet(path)
            return whole.filter(_plain(F.col("_metadata.file_path")) == found)
        last = some[-1]


def read_splits(spark: SparkSession, path: str, verify: bool = False) -> DataFrame:
    """Named splits as `write_splits` left them: a whole dataset, or an error.

    The manifest is written last, so a folder without one, or with other row counts than it names, is
    refused before anything is read from it. `verify` also compares the checksums, which
    reads all columns.
    """
    if not _exists(spark, f"{path}/{MANIFEST}/_SUCCESS"):
        raise ValueError(f"{path} has no manifest: its write did not end")
    manifest = spark.read.parquet(f"{path}/{MANIFEST}").collect()
    first = manifest[0]
    df = spark.read.schema(T.StructType.fromJson(json.loads(first["schema"]))).parquet(path)
    facts = split_facts(df, first["column"], verify)
    found = {r["split"]: (r["n_rows"], r["checksum"]) for r in facts.collect()}
    said = {r["split"]: (r["n_rows"], r["checksum"] if verify else None) for r in manifest if r["n_rows"]}
    if found != said:
        raise ValueError(f"{path} holds other rows than its manifest names: {found} instead of {said}")
    return df


#: Folder of a dataset's manifest; readers of its data skip names that begin so.
MANIFEST = "_manifest"


def split_facts(df: DataFrame, column: str, checksum: bool = True) -> DataFrame:
    """Rows of every split and a checksum of their values, whatever their order."""
    values = [c for c in df.columns if not isinstance(df.schema[c].dataType, T.MapType)]
    total = F.sum(F.xxhash64(*values).cast("decimal(38,0)")).cast("string") if checksum else F.lit(None).cast("string")
    return df.groupBy(F.col(column).cast("string").alias("split")).agg(F.count("*").alias("n_rows"), total.alias("checksum"))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_codes(codes: DataFrame, flags: list[str] | None = None) -> DataFrame:
    """Codes with any non-null flag, one row per code (lowest label survives)."""
    flags = SURGERY_FLAGS if flags is None else flags
    return (
        codes.filter(F.coalesce(*[F.col(f).cast("string") for f in flags]).isNotNull())
        .groupBy("Code")
        .agg(F.min("Libelle").alias("Libelle"))
    )
