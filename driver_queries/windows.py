"""Windows, as-of joins, samples and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from argentum.functions.columns import flag_new_case, localise, midpoint
from argentum.operators.joins import asof, attach, exclude_keys, keep_keys
from argentum.operators.metrics import distinct_count, value_counts
from argentum.operators.ranking import dense_id, percentiles, take_lowest
from argentum.operators.sampling import (
    balance_to_class,
    debug_sample,
    first_per_class,
    keep_low_share,
    nested_samples,
    sample_keys,
    shuffle_rows,
    split_by_share,
    uniform_sample,
    weighted_sample,
)
from argentum.operators.windows import keep_one, last_non_null
from argentum.plans.align import match_dates
from driver_queries.inputs import KNOWN, MENTIONS, NOTES
from driver_queries.registry import query, with_

FIRST_LAST = "SELECT note_id, person_id, note_datetime, priority FROM notes QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY note_datetime{d}, note_id{d}) = 1"


@query("first_note", with_(NOTES, FIRST_LAST.format(d="")))
def first_note(t):
    return keep_one(t.notes, how="first", tie_break=["note_id"]).select("note_id", "person_id", "note_datetime", "priority")


@query("last_note", with_(NOTES, FIRST_LAST.format(d=" DESC")))
def last_note(t):
    return keep_one(t.notes, how="last", tie_break=["note_id"]).select("note_id", "person_id", "note_datetime", "priority")


@query(
    "last_non_null",
    """SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type,
  arg_max(value, (ts, event_id)) FILTER (event_type = 'purchase') AS last_purchase,
  arg_max(props, (ts, event_id)) FILTER (event_type = 'error') AS last_error, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id
FROM events GROUP BY user_id""",
)
def last_non_null_query(t):
    of = lambda kind, column: F.when(F.col("event_type") == kind, F.col(column))
    events = t["events"].select(
        "user_id",
        "event_type",
        of("purchase", "value").alias("last_purchase"),
        of("error", "props").alias("last_error"),
        "ts",
        "event_id",
    )
    return last_non_null(events, "user_id", "ts", "event_id")


@query(
    "previous_event_gap",
    """SELECT o_custkey, CAST(d AS TIMESTAMP) AS d, CAST(gap AS VARCHAR) AS gap, gap IS NULL OR gap > 100 AS new_case FROM (
  SELECT o_custkey, d, date_diff('day', lag(d) OVER (PARTITION BY o_custkey ORDER BY d), d) AS gap
  FROM (SELECT DISTINCT o_custkey, o_orderdate AS d FROM orders))""",
)
def previous_event_gap(t):
    from pyspark.sql.window import Window

    # distinct days first: a customer then has at most one row per calendar day
    days = t["orders"].select("o_custkey", F.col("o_orderdate").alias("d")).distinct()
    previous = F.lag("d").over(Window.partitionBy("o_custkey").orderBy("d"))
    flagged = days.withColumn("gap", F.datediff("d", previous))
    return flagged.withColumns({"new_case": flag_new_case(F.col("gap"), 100), "gap": F.col("gap").cast("string")})


ASOF_INPUT = """p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
s AS (SELECT user_id, ts AS signup_ts, CAST(max(event_id) AS VARCHAR) AS signup_id FROM events WHERE event_type = 'signup' GROUP BY ALL)"""


def asof_query(t, **options):
    probes = t["events"].filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    known = t["events"].filter("event_type = 'signup'").select(
        "user_id", F.col("ts").alias("signup_ts"), F.col("event_id").alias("signup_id")
    )
    return asof(probes, known, "user_id", "ts", "signup_ts", "signup_id", **options).select(
        "event_id", "user_id", "ts", "signup_ts", F.col("signup_id").cast("string").alias("signup_id")
    )


@query(
    "asof_backward",
    with_(
        ASOF_INPUT,
        "SELECT event_id, p.user_id, ts, signup_ts, signup_id FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.signup_ts",
    ),
)
def asof_backward(t):
    return asof_query(t)


@query(
    "asof_backward_tolerance",
    with_(
        ASOF_INPUT,
        """SELECT event_id, user_id, ts, CASE WHEN ok THEN signup_ts END AS signup_ts, CASE WHEN ok THEN signup_id END AS signup_id FROM (
  SELECT event_id, p.user_id, ts, signup_ts, signup_id, ts - signup_ts <= INTERVAL 1 DAY AS ok
  FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts >= s.signup_ts)""",
    ),
)
def asof_backward_tolerance(t):
    return asof_query(t, tolerance_seconds=86_400)


@query(
    "asof_forward",
    with_(
        ASOF_INPUT,
        "SELECT event_id, p.user_id, ts, signup_ts, signup_id FROM p ASOF LEFT JOIN s ON p.user_id = s.user_id AND p.ts <= s.signup_ts",
    ),
)
def asof_forward(t):
    return asof_query(t, direction="forward")


@query(
    "asof_nearest",
    with_(
        ASOF_INPUT,
        """SELECT event_id, user_id, ts, arg_min(signup_ts, (gap, signup_ts)) AS signup_ts, arg_min(signup_id, (gap, signup_ts)) AS signup_id
FROM (SELECT event_id, p.user_id, ts, signup_ts, signup_id, abs(epoch_us(ts) - epoch_us(signup_ts)) AS gap
  FROM p LEFT JOIN s ON p.user_id = s.user_id) GROUP BY ALL""",
    ),
)
def asof_nearest(t):
    return asof_query(t, direction="nearest")


ONCE = """once AS (SELECT * FROM mentions WHERE date_dt IS NOT NULL QUALIFY count(*) OVER (PARTITION BY note_id, date_dt) = 1)"""


@query(
    "asof_exact",
    with_(
        NOTES,
        MENTIONS,
        KNOWN,
        """SELECT note_id, text_start_char, date_dt, known_date, CAST(label AS VARCHAR) AS label FROM mentions LEFT JOIN known
  ON mentions.person_id = known.person_id AND date_dt = known_date WHERE date_dt IS NOT NULL""",
    ),
)
def asof_exact_query(t):
    joined = asof(t.dates, t.known, "person_id", "date_dt", "known_date", "label", tolerance_seconds=0)
    return joined.select("note_id", "text_start_char", "date_dt", "known_date", F.col("label").cast("string").alias("label"))


@query(
    "match_dates_within_days",
    with_(
        NOTES,
        MENTIONS,
        KNOWN,
        ONCE,
        """hits AS (SELECT once.*, known_date AS k, label AS lab FROM once ASOF LEFT JOIN known
  ON once.person_id = known.person_id AND date_dt >= known_date)""",
        """labelled AS (SELECT note_id, text_start_char, date_dt,
    CASE WHEN date_dt - k <= INTERVAL 5 DAY THEN k END AS known_date,
    CASE WHEN date_dt - k <= INTERVAL 5 DAY THEN lab ELSE 0 END AS label FROM hits)""",
        """SELECT * FROM (SELECT *, sum(label) OVER (PARTITION BY note_id) AS matched_date_in_doc FROM labelled)
WHERE date_dt > TIMESTAMP '1930-01-01' AND matched_date_in_doc > 0""",
    ).replace("AS matched_date_in_doc", "::BIGINT AS matched_date_in_doc"),
)
def match_dates_within_days(t):
    narrow = t.dates_once.select("note_id", "person_id", "date_dt", "text_start_char")
    aligned = match_dates(narrow, t.known, tolerance_seconds=5 * 86_400)
    return aligned.select("note_id", "text_start_char", "date_dt", "known_date", "label", "matched_date_in_doc")


@query(
    "localised_timestamps",
    "SELECT event_id, timezone('UTC', timezone('Europe/Paris', ts)) AS ts FROM events",
)
def localised_timestamps(t):
    return t["events"].select("event_id", localise(F.col("ts").cast("timestamp"), "Europe/Paris").alias("ts"))


@query(
    "mention_midpoint",
    with_(NOTES, MENTIONS, "SELECT note_id, text_start_char, (text_start_char + text_end_char) / 2.0 AS position FROM mentions WHERE date_dt IS NOT NULL"),
)
def mention_midpoint(t):
    return t.dates.select("note_id", "text_start_char", midpoint("text_start_char", "text_end_char").alias("position"))


H = "md5(concat_ws(':', {keys}, '{seed}'))"


@query(
    "sample_persons",
    f"""SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders)
ORDER BY {H.format(keys='CAST(o_custkey AS VARCHAR)', seed=29)}, o_custkey LIMIT 200""",
)
def sample_persons(t):
    return sample_keys(t["orders"], "o_custkey", 200, 29)


@query(
    "sample_nested",
    f"""SELECT o_custkey, CASE WHEN r <= 40 THEN 'dev' ELSE 'test' END AS set FROM (
  SELECT o_custkey, row_number() OVER (ORDER BY {H.format(keys='CAST(o_custkey AS VARCHAR)', seed=3)}, o_custkey) AS r
  FROM (SELECT DISTINCT o_custkey FROM orders)) WHERE r <= 140""",
)
def sample_nested(t):
    dev, test = nested_samples(t["orders"], "o_custkey", 40, 100, 3)
    return dev.withColumn("set", F.lit("dev")).unionByName(test.withColumn("set", F.lit("test")))


@query(
    "sample_uniform_large",
    f"""SELECT o_orderkey, o_totalprice FROM orders
ORDER BY {H.format(keys='CAST(o_orderkey AS VARCHAR)', seed=0)}, o_orderkey LIMIT 5000""",
)
def sample_uniform_large(t):
    return uniform_sample(t["orders"].select("o_orderkey", "o_totalprice"), ["o_orderkey"], 5000)


@query(
    "sample_weighted",
    f"""SELECT o_orderkey FROM (SELECT o_orderkey, greatest(o_totalprice - 100000, 0) AS w,
  (('0x' || substr({H.format(keys='CAST(o_orderkey AS VARCHAR)', seed=5)}, 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM orders)
WHERE w > 0 ORDER BY ln(-ln(u)) - ln(w), o_orderkey LIMIT 2000""",
)
def sample_weighted(t):
    weighted = t["orders"].select("o_orderkey", F.greatest(F.col("o_totalprice") - 100000, F.lit(0.0)).alias("w"))
    return weighted_sample(weighted, ["o_orderkey"], "w", 2000, 5).select("o_orderkey")


@query(
    "sample_with_ties",
    """SELECT priority, count(*) AS n FROM (
  SELECT substr(o_orderpriority, 1, 1) AS priority FROM orders ORDER BY priority, o_orderstatus
  LIMIT (SELECT count(*) // 3 FROM orders)) GROUP BY priority""",
)
def sample_with_ties(t):
    rows = t["orders"].select(F.substring("o_orderpriority", 1, 1).alias("priority"), "o_orderstatus")
    lowest = take_lowest(rows, [F.col("priority"), F.col("o_orderstatus")], rows.count() // 3)
    return lowest.groupBy("priority").agg(F.count("*").alias("n"))


@query(
    "balance_with_nulls",
    """SELECT label, CASE WHEN label IS NULL THEN n ELSE least(n, (SELECT count(*) FROM orders WHERE o_orderpriority = '2-HIGH')) END AS n FROM (
  SELECT CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN NULL WHEN '4' THEN 1 ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) END AS label,
    count(*) AS n FROM orders GROUP BY 1)""",
)
def balance_with_nulls(t):
    first = F.substring("o_orderpriority", 1, 1).cast("int")
    label = F.when(first == 4, 1).when(first < 4, first)
    # keys that many rows share
    rows = t["orders"].select(label.alias("label"), (F.col("o_custkey") % 7).alias("key"))
    return balance_to_class(rows, "label", 2, ["key"]).groupBy("label").agg(F.count("*").alias("n"))


@query(
    "keep_lowest_share",
    """SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey
LIMIT (SELECT CAST(floor(0.7 * count(*)) AS BIGINT) FROM orders)""",
)
def keep_lowest_share(t):
    return keep_low_share(t["orders"].select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", 0.3).select("o_orderkey")


@query(
    "first_rows_per_class",
    """SELECT o_orderpriority, o_orderkey FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 30""",
)
def first_rows_per_class(t):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    rows = t["orders"].select("o_orderpriority", "o_orderkey", "o_totalprice")
    return first_per_class(rows, "o_orderpriority", order, 30).drop("o_totalprice")


@query(
    "shuffled_rows",
    f"SELECT c_custkey, c_name FROM customer ORDER BY {H.format(keys='CAST(c_custkey AS VARCHAR)', seed=1)}",
)
def shuffled_rows(t):
    return shuffle_rows(t["customer"].select("c_custkey", "c_name"), ["c_custkey"], 1)


@query(
    "debug_sample",
    f"SELECT doc_id FROM documents ORDER BY {H.format(keys='CAST(doc_id AS VARCHAR)', seed=0)}, doc_id LIMIT 50",
)
def debug_sample_query(t):
    return debug_sample(t["documents"].select("doc_id"), ["doc_id"], 50)


@query(
    "random_split",
    f"""SELECT doc_id, CASE WHEN (('0x' || substr({H.format(keys='CAST(doc_id AS VARCHAR)', seed=42)}, 1, 13))::BIGINT + 0.5)
  / 4503599627370496.0 < 0.1 THEN 'val' ELSE 'train' END AS set FROM documents""",
)
def random_split(t):
    train, val = split_by_share(t["documents"].select("doc_id"), ["doc_id"], 0.1, 42)
    return train.withColumn("set", F.lit("train")).unionByName(val.withColumn("set", F.lit("val")))


@query(
    "dense_row_ids",
    "SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS text_id, l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem",
)
def dense_row_ids(t):
    keys = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return dense_id(t["lineitem"].select(*keys), [F.col(k) for k in keys])


@query(
    "percentile_bounds",
    """SELECT unnest(range(0, 11)) AS decile, unnest(list_transform(
  (SELECT quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) FROM orders), lambda x: round(x, 4))) AS bound""",
)
def percentile_bounds(t):
    bounds = percentiles(t["orders"], "o_totalprice", [i / 10 for i in range(11)], "o_orderkey")
    rows = t.spark.createDataFrame(list(enumerate(bounds)), "decile long, bound double")
    return rows.withColumn("bound", F.round("bound", 4))


@query("distinct_persons", "SELECT count(DISTINCT o_custkey) AS n_distinct FROM orders")
def distinct_persons(t):
    return distinct_count(t["orders"], "o_custkey")


@query("value_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def value_counts_query(t):
    return value_counts(t["orders"], ["o_orderstatus", "o_orderpriority"])


@query(
    "value_shares_by_group",
    """SELECT o_orderstatus, o_orderpriority, round(n / sum(n) OVER (PARTITION BY o_orderstatus), 9) AS share
FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)""",
)
def value_shares_by_group(t):
    shares = value_counts(t["orders"], ["o_orderpriority"], ["o_orderstatus"], normalize=True)
    return shares.withColumn("share", F.round("share", 9))


@query(
    "value_counts_per_person",
    "SELECT o_orderstatus, count(*) AS n FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) GROUP BY ALL",
)
def value_counts_per_person(t):
    return value_counts(t["orders"].dropDuplicates(["o_custkey", "o_orderstatus"]), ["o_orderstatus"])


@query(
    "known_and_new_persons",
    """SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AS known FROM customer""",
)
def known_and_new_persons(t):
    persons = t["customer"].select("c_custkey")
    rich = t["orders"].filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    inside = keep_keys(persons, rich, ["c_custkey"]).withColumn("known", F.lit(True))
    return inside.unionByName(exclude_keys(persons, rich, ["c_custkey"]).withColumn("known", F.lit(False)))


@query(
    "attach_one_to_one",
    """SELECT c_custkey, c_name, n, last_order FROM customer JOIN (
  SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_order FROM orders GROUP BY ALL) ON c_custkey = o_custkey""",
)
def attach_one_to_one(t):
    per_person = t["orders"].groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.max("o_orderdate").alias("last_order")
    )
    return attach(t["customer"].select("c_custkey", "c_name"), per_person, ["c_custkey"], validate="one_to_one")
