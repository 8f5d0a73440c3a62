"""Cohort selection from coded diagnoses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from argentum.functions.columns import code_prefixes, flag_new_case
from argentum.operators.joins import join_code_family
from argentum.operators.sampling import debug_sample as sample_rows
from argentum.operators.windows import keep_first_by
from argentum.session import BROADCAST_ROWS

COHORT_COLUMNS = ["person_id", "cancer", "n_distinct_cancer"]


def _member(column, values, what: str):
    if isinstance(values, str):
        return column == values
    if isinstance(values, (list, tuple)):
        return column.isin(list(values))
    raise TypeError(f"{what} should be a str or list")


def retrieve_codes(
    conditions: DataFrame,
    values: str | list[str] | None = None,
    source: str | None = None,
    statuses: str | list[str] | None = None,
) -> DataFrame:
    """Coded diagnoses of a source and status whose 3- or 4-character prefix is wanted."""
    if source:
        conditions = conditions.filter(F.col("cdm_source") == source)
    if statuses:
        conditions = conditions.filter(
            _member(F.col("condition_status_source_value"), statuses, "statuses")
        )
    three, four = code_prefixes("condition_source_value")
    conditions = conditions.withColumns(
        {"condition_source_value_short_2": three, "condition_source_value_short_3": four}
    )
    if values:
        conditions = conditions.filter(_member(three, values, "values") | _member(four, values, "values"))
    return conditions


def family_table(spark, families: dict[str, list[str]]) -> DataFrame:
    """A dictionary family -> codes as rows, one per code."""
    rows = [(family, list(codes)) for family, codes in families.items()]
    exploded = spark.createDataFrame(rows, "cancer string, codes array<string>").select(
        "cancer", F.explode("codes").alias("code")
    )
    n_codes = sum(len(codes) for _, codes in rows)
    # same bound as for any literal table
    return F.broadcast(exploded) if n_codes <= BROADCAST_ROWS else exploded


def select_cohort(
    conditions: DataFrame,
    families: DataFrame | dict[str, list[str]],
    types: list[str],
    clean_period_years: int,
    start_date: str,
    end_date: str,
    double_cancer_exclusion: bool = True,
    source: str | None = None,
    statuses: str | list[str] | None = None,
    columns: list[str] | None = None,
    debug_sample: int = -1,
    seed: int = 0,
) -> DataFrame:
    """New cases of the wanted families, one row per (person, family).

    A case is new when the previous code of the same person and family is more than
    `clean_period_years` * 365 days older, or absent. Persons with several families drop
    out, counted over all families of the dictionary.

    Events first combine to one row per (person, family, day), ahead of the shuffle. Gaps
    are counted in days and a later event of a day is never new, so nothing is lost, and
    the windows see at most families x calendar days rows per person, however many events
    one person has.
    """
    if clean_period_years < 0:
        raise ValueError("clean_period_years must not be negative")
    columns = columns or COHORT_COLUMNS
    if isinstance(families, dict):
        families = family_table(conditions.sparkSession, families)

    ts = "condition_start_datetime"
    events = join_code_family(retrieve_codes(conditions, None, source, statuses), families)
    extra = [c for c in columns if c not in (*COHORT_COLUMNS, ts)]
    first = F.min(F.struct(ts, *extra)).alias("_first") if extra else F.min(ts).alias(ts)
    daily = events.groupBy("person_id", "cancer", F.to_date(ts).alias("_day")).agg(first)
    if extra:
        daily = daily.select("person_id", "cancer", "_day", "_first.*")

    per_person = Window.partitionBy("person_id")
    per_family = Window.partitionBy("person_id", "cancer").orderBy("_day")
    gap = F.datediff("_day", F.lag("_day").over(per_family))
    flagged = daily.withColumns(
        {
            "n_distinct_cancer": F.size(F.collect_set("cancer").over(per_person)),
            "_new_case": flag_new_case(gap, clean_period_years * 365),
        }
    )
    if double_cancer_exclusion:
        flagged = flagged.filter(F.col("n_distinct_cancer") == 1)
    cases = flagged.filter(
        F.col("_new_case")
        & F.col("cancer").isin(list(types))
        & (F.col(ts) >= F.lit(start_date).cast("timestamp"))
        & (F.col(ts) < F.lit(end_date).cast("timestamp"))
    )
    cohort = keep_first_by(cases, ["person_id", "cancer"], [F.col(ts)]).select(*columns)
    return sample_rows(cohort, ["person_id", "cancer"], debug_sample, seed)


