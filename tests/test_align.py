import math
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from argentum.operators import joins
from argentum.functions.columns import mask_span
from argentum.operators.joins import asof, assert_unique, attach, join_spans
from argentum.plans.align import align, match_dates, proximity_weight
from argentum.session import stage

D0 = datetime(2020, 1, 1)


def random_sides(seed, n=300):
    rng = random.Random(seed)
    # one key holds most rows; instants repeat on both sides
    key = lambda: "hot" if rng.random() < 0.6 else f"k{rng.randint(0, 5)}"
    instant = lambda: D0 + timedelta(hours=rng.randint(0, 400))
    probes = [(i, key(), instant()) for i in range(n)]
    known = [(key(), instant(), rng.randint(1, 3)) for _ in range(n // 2)]
    return probes, known


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 0, 6 * 3600])
@pytest.mark.parametrize("pieces", ["1", "7"])
def test_asof_equals_brute_force(spark, direction, tolerance, pieces, monkeypatch):
    # small pieces of the timeline, so that neighbours lie in others
    monkeypatch.setattr(joins, "stage", lambda df, label: stage(df.repartitionByRange(int(pieces), "k", "_ts").sortWithinPartitions("k", "_ts").withColumn("_piece", F.spark_partition_id()), label))
    probes, known = random_sides(hash((direction, tolerance or -1)) % 1000)
    p = spark.createDataFrame(probes, "id int, k string, ts timestamp")
    r = spark.createDataFrame(known, "k string, at timestamp, label int")
    got = {x.id: (x.at, x.label) for x in asof(p, r, "k", "ts", "at", "label", direction, tolerance).collect()}
    best = {}
    for k, at, label in known:
        best[k, at] = max(label, best.get((k, at), 0))
    for i, k, ts in probes:
        sides = [(at, v) for (kk, at), v in best.items() if kk == k]
        sides = [s for s in sides if (s[0] <= ts or direction != "backward") and (s[0] >= ts or direction != "forward")]
        sides.sort(key=lambda s: (abs(s[0] - ts), s[0]))
        expected = sides[0] if sides else (None, None)
        if tolerance is not None and expected[0] is not None and abs(expected[0] - ts) > timedelta(seconds=tolerance):
            expected = (None, None)
        assert got[i] == expected
    assert len(got) == len(probes)


def test_a_busy_day_is_cut(spark):
    """One key holds nearly all rows inside one hour: several tasks share it."""
    kept = []
    instant = F.timestamp_seconds(F.col("id") % 3600)
    p = spark.range(30_000).select("id", F.lit("hot").alias("k"), instant.alias("ts"))
    r = spark.range(30_000).select(F.lit("hot").alias("k"), F.timestamp_micros(F.col("id") * 100_000).alias("at"), F.col("id").alias("label"))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(joins, "stage", lambda df, label: kept.append(stage(df, label)) or kept[-1])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = asof(p, r, "k", "ts", "at", "label")
    assert out.filter(F.col("at").isNull() | (F.col("at") > F.col("ts"))).count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [x["count"] for x in kept[0].groupBy("k", "_piece").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def test_asof_equals_pandas(spark):
    probes, known = random_sides(7)
    best = pd.DataFrame(known, columns=["k", "at", "label"]).sort_values("label").drop_duplicates(["k", "at"], keep="last")
    left = pd.DataFrame(probes, columns=["id", "k", "ts"]).sort_values("ts")
    expected = pd.merge_asof(left, best.sort_values("at"), by="k", left_on="ts", right_on="at", tolerance=pd.Timedelta("1D"))
    got = asof(
        spark.createDataFrame(probes, "id int, k string, ts timestamp"),
        spark.createDataFrame(known, "k string, at timestamp, label int"),
        "k", "ts", "at", "label", tolerance_seconds=86_400,
    ).toPandas()
    merged = expected.merge(got, on="id")
    assert ((merged.at_x == merged.at_y) | (merged.at_x.isna() & merged.at_y.isna())).all()


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("tolerance", [0.000001, 1, 3600, 90_000])
def test_a_tolerance_takes_no_global_order(spark, direction, tolerance):
    """Instants before and after the epoch, at the edges of cells, far away, repeated."""
    rng = random.Random(str((direction, tolerance)))
    base = [datetime(1969, 12, 31, 23), D0, datetime(1, 2, 3), datetime(9999, 1, 1)]
    step = timedelta(seconds=max(tolerance / 4, 0.000001))
    instant = lambda: rng.choice(base) + rng.randint(-9, 9) * step + timedelta(microseconds=rng.randint(-1, 1))
    probes = [(i, rng.choice("ab"), instant()) for i in range(300)] + [(300, None, D0), (301, "a", None), (302, "a", D0)]
    known = [(rng.choice("ab"), instant(), rng.randint(1, 3)) for _ in range(60)] + [("a", None, 9), (None, D0, 9)]
    p = spark.createDataFrame(probes, "id int, k string, ts timestamp")
    r = spark.createDataFrame(known, "k string, at timestamp, label int")
    out = asof(p, r, "k", "ts", "at", "label", direction, tolerance)
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    got = {x.id: (x.at, x.label) for x in out.collect()}
    best = {}
    for k, at, label in known:
        if at is not None and k is not None:
            best[k, at] = max(label, best.get((k, at), 0))
    for i, k, ts in probes:
        sides = [(at, v) for (kk, at), v in best.items() if kk == k and ts is not None and abs(at - ts) <= timedelta(seconds=tolerance)]
        sides = [s for s in sides if (s[0] <= ts or direction != "backward") and (s[0] >= ts or direction != "forward")]
        assert got[i] == min(sides, key=lambda s: (abs(s[0] - ts), s[0]), default=(None, None))


def test_zero_tolerance_is_an_equi_join(spark):
    p = spark.createDataFrame([(1, "a", D0), (2, "b", D0)], "id int, k string, ts timestamp")
    r = spark.createDataFrame([("a", D0), ("a", D0)], "k string, at timestamp")
    out = {x.id: x._value for x in asof(p, r, "k", "ts", "at", tolerance_seconds=0).collect()}
    assert out == {1: True, 2: None}
    with pytest.raises(ValueError):
        asof(p, r, "k", "ts", "at", direction="sideways")


MENTION = """note_id string, person_id string, lexical_variant string, date_dt timestamp, text_start_char int, text_end_char int,
span string, span_start_char int, span_end_char int"""


def mention(note, person, date, start, span="le DD ici"):
    return (note, person, "DD", date, start, start + 2, f"{span} {start}", 3, 5)


def known_table(spark, *items):
    return spark.createDataFrame(list(items), "person_id string, known_date timestamp, label int")


def test_labels_floor_and_note_sum(spark, rows):
    old = datetime(1925, 1, 1)
    mentions = spark.createDataFrame(
        [
            mention("n1", "p", D0, 0),
            mention("n1", "p", D0 + timedelta(1), 10),
            mention("n1", "p", old, 20),
            mention("n2", "p", D0 + timedelta(2), 0),
        ],
        MENTION,
    )
    # the match before the floor still counts in the note sum
    known = known_table(spark, ("p", D0, 1), ("p", old, 2), ("p", None, 1))
    out = rows(match_dates(mentions, known), "note_id", "text_start_char", "label", "matched_date_in_doc")
    assert out == [("n1", 0, 1, 3), ("n1", 10, 0, 3)]
    unlabelled = match_dates(mentions, known.drop("label"))
    assert rows(unlabelled, "text_start_char", "label") == [(0, True), (10, False)]


def test_proximity_equals_all_pairs(spark):
    rng = random.Random(1)
    points = [("n", i, rng.randint(0, 400_000) / 2, int(rng.random() < 0.2)) for i in range(400)]
    df = spark.createDataFrame(points, "note_id string, id int, position double, label int")
    got = {r.id: r.p for r in proximity_weight(df).collect()}
    for _, i, x, label in points:
        if label == 0:
            density = lambda at: math.exp(-0.5 * ((x - at) / 1500) ** 2) / (1500 * math.sqrt(2 * math.pi))
            assert got[i] == pytest.approx(sum(density(at) for _, _, at, y in points if y), rel=1e-9, abs=1e-300)
    far = spark.createDataFrame([("n", 1, 0.0, 1), ("n", 2, 200_000.0, 0), ("m", 3, 0.0, 0)], df.schema)
    assert {r.id: r.p for r in proximity_weight(far).collect()} == {2: 0.0, 3: 0.0}


def examples_input(spark):
    mentions, known = [], []
    for n in range(30):
        person, note = f"p{n % 10}", f"n{n:02d}"
        for j in range(5):
            mentions.append(mention(note, person, D0 + timedelta(days=10 * n + j), 100 * j, f"le DD {note}"))
        mentions.append(mention(note, person, D0 + timedelta(days=10 * n + 4), 900))  # a repeated date
        known.append((person, D0 + timedelta(days=10 * n), 1))
        known.append((person, D0 + timedelta(days=10 * n + 1), 2))
    return spark.createDataFrame(mentions, MENTION), known_table(spark, *known)


@pytest.mark.parametrize("negatives", ["proximity", "uniform"])
def test_align(spark, rows, negatives):
    mentions, known = examples_input(spark)
    out = align(known, mentions=mentions, negatives=negatives).collect()
    labels = [r.label for r in out]
    # the quota counts label 1 only
    assert (labels.count(1), labels.count(2), labels.count(0)) == (30, 30, 30)
    assert sorted(r.text_id for r in out) == list(range(90))
    assert all(r.masked_span[r.masked_span_start_char : r.masked_span_end_char] == "<mask>" for r in out)
    assert not any(r.text_start_char in (400, 900) for r in out)
    again = align(known, mentions=mentions.repartition(3), negatives=negatives).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    doubled = align(known, mentions=mentions, negatives=negatives, false_examples_multiplier=9)
    assert doubled.filter("label = 0").count() == 60
    with pytest.raises(ValueError, match="fewer"):
        align(known, mentions=mentions, negatives=negatives, false_examples_multiplier=9, strict=True)


def test_align_texts_puts_set_first(spark):
    texts = spark.createDataFrame(
        [("n", "p", "train", "vu le 01/01/2020 puis le 05/01/2020")], "note_id string, person_id string, set string, note_text string"
    )
    out = align(known_table(spark, ("p", D0, 1)), texts)
    assert out.columns[0] == "set"
    assert sorted((r.set, r.label, r.masked_span) for r in out.collect()) == [
        ("train", 0, "vu le 01/01/2020 puis le <mask>"),
        ("train", 1, "vu le <mask> puis le 05/01/2020"),
    ]
    with pytest.raises(ValueError):
        align(known_table(spark, ("p", D0, 1)))


def test_mask_and_spans(spark, rows):
    df = spark.createDataFrame([("été 01/01/2020 fin", 4, 14)], "span string, span_start_char int, span_end_char int")
    assert rows(mask_span(df), "masked_span", "masked_span_start_char", "masked_span_end_char") == [("été <mask> fin", 4, 10)]
    spans = "note_id string, text_start_char int, text_end_char int, label int"
    a = spark.createDataFrame([("n", 0, 5, 1), ("n", 7, 9, 0)], spans)
    b = spark.createDataFrame([("n", 0, 5, 0), ("n", 8, 9, 0)], spans)
    assert rows(join_spans(a, b, ("_a", "_b"), validate="one_to_one"), "label_a", "label_b") == [(1, 0)]
    # the check is part of the plan: it raises when rows are made, on either side
    for checked in (assert_unique(a, ["note_id"]), attach(b, a, ["note_id"], validate="many_to_one"), attach(a, b, ["note_id"], validate="one_to_one")):
        with pytest.raises(Exception, match="keys are not unique"):
            checked.collect()
    one = b.dropDuplicates(["note_id"])
    assert attach(a, one, ["note_id"], validate="many_to_one").count() == a.join(one, "note_id").count() > 0
    twice = spark.createDataFrame([(None, 1), (None, 2)], "k string, v int")
    with pytest.raises(Exception, match="keys are not unique"):
        assert_unique(twice, ["k"]).collect()
    assert rows(assert_unique(twice, ["v"])) == [(None, 1), (None, 2)]
    with pytest.raises(ValueError):
        attach(a, b, ["note_id"], validate="maybe")


def test_one_to_one_check_takes_the_shuffles_of_the_join_only(spark, rows):
    a = spark.createDataFrame([("n", 1), ("m", 2)], "k string, v int")
    b = spark.createDataFrame([("n", 3), ("o", 4), (None, 5)], "k string, w int")
    checked = attach(a.hint("merge"), b, ["k"], validate="one_to_one")
    assert checked._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
    assert rows(checked) == [("n", 1, 3)]
    assert rows(attach(a, b, ["k"], "full", "one_to_one")) == rows(a.join(b, ["k"], "full"))
    for left, right in ((a.union(a), b), (a, b.union(b)), (b.union(b), a)):
        with pytest.raises(Exception, match="keys are not unique"):
            attach(left, right, ["k"], "left", "one_to_one").collect()


def test_zone(spark, rows):
    mentions = spark.createDataFrame([mention("n", "p", D0, 0)], MENTION)
    known = known_table(spark, ("p", D0, 1))
    out = match_dates(mentions, known, tz="Europe/Paris").select(F.col("date_dt"))
    assert rows(out) == [(D0 - timedelta(hours=1),)]


def test_texts_of_keeps_the_notes_found(spark, rows):
    from argentum.plans.align import texts_of

    texts = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "note_id string, n int")
    found = spark.createDataFrame([("a",), ("a",), (None,)], "note_id string")
    assert rows(texts_of(texts, found), "n") == [(1,), (2,), (4,)]
    assert rows(texts_of(texts, found.filter("note_id is not null")), "n") == [(1,), (2,)]
