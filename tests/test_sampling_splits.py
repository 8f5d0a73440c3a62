import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import argentum.operators.ranking as ranking
from argentum.functions.columns import order_hash
from argentum.operators.ranking import bucket_of, dense_id, global_rank, order_statistics, percentiles, take_lowest
from argentum.operators.sampling import (
    balance_to_class,
    first_per_class,
    keep_low_share,
    nested_samples,
    sample_keys,
    split_by_share,
    uniform_sample,
    weighted_sample,
)
from argentum.plans.splits import split_dev_alignable, split_dev_prealigned, split_existing, split_n_persons, split_test, split_three_way


@pytest.fixture
def numbers(spark):
    return spark.range(500).withColumn("v", (F.col("id") * 37) % 50)


def test_global_rank_is_dense_and_ordered(numbers):
    order = [F.col("v"), F.col("id")]
    got = sorted((r.rank, r.v, r.id) for r in global_rank(numbers.repartition(5), order).collect())
    assert [g[0] for g in got] == list(range(500))
    assert [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert dense_id(numbers, order).columns[0] == "text_id"


def test_both_cuts_agree(numbers, rows, monkeypatch):
    order = [F.col("v"), F.col("id")]
    small = rows(take_lowest(numbers, order, 123))
    monkeypatch.setattr(ranking, "SMALL_N", 10)
    assert rows(take_lowest(numbers, order, 123)) == small
    assert len(small) == 123
    assert take_lowest(numbers, order, 10_000).count() == 500
    assert take_lowest(numbers, order, 0).count() == 0


def test_percentiles_equal_numpy(spark, numbers):
    values = [r.v for r in numbers.collect()]
    shares = [i / 100 for i in range(0, 101, 2)]
    assert percentiles(numbers, "v", shares, "id") == pytest.approx(list(np.percentile(values, range(0, 101, 2))))
    assert percentiles(numbers.filter("id < 0"), "v", shares, "id") == []
    bounds = [0.0, 1.0, 1.0, 5.0]
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 0.5, 1.0, 4.9, 5.0)], "x double")
    assert [r[0] for r in df.select(bucket_of(F.col("x"), bounds)).collect()] == [None, 0, 0, 2, 2, None]


def test_samples(numbers, rows):
    a = rows(uniform_sample(numbers, ["id"], 50, 1))
    assert a == rows(uniform_sample(numbers.repartition(9), ["id"], 50, 1)) and len(a) == 50
    assert a != rows(uniform_sample(numbers, ["id"], 50, 2))
    assert sample_keys(numbers, "v", 1000).count() == 50
    inner, outer = nested_samples(numbers, "v", 10, 15, 3)
    assert (inner.count(), outer.count()) == (10, 15)
    assert inner.join(outer, "v").count() == 0


def test_weighted_sample_prefers_heavy_rows(spark):
    df = spark.range(4000).withColumn("w", F.when(F.col("id") % 4 == 0, 0.0).when(F.col("id") % 4 == 1, 9.0).otherwise(1e-12))
    got = [r.id % 4 for r in weighted_sample(df, ["id"], "w", 1000).collect()]
    assert got.count(1) == 1000
    more = [r.id % 4 for r in weighted_sample(df, ["id"], "w", 3500).collect()]
    assert more.count(0) == 0 and len(more) == 3000
    mild = spark.range(20_000).withColumn("w", F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0))
    even = sum(r.id % 2 == 0 for r in weighted_sample(mild, ["id"], "w", 1000).collect())
    assert 700 < even < 800


@pytest.mark.parametrize("rate", [0.3, 0.33, 0.0, 1.0])
def test_keep_low_share(numbers, rate):
    kept = keep_low_share(numbers, "v", "id", rate)
    expected = sorted((r.v, r.id) for r in numbers.collect())[: int((1 - rate) * 500)]
    assert sorted((r.v, r.id) for r in kept.collect()) == expected


@pytest.mark.parametrize("n", [9, 10, 11, 25])
@pytest.mark.parametrize("small", [10, 1000])
def test_exactly_n_with_nulls_and_ties(spark, monkeypatch, n, small):
    monkeypatch.setattr(ranking, "SMALL_N", small)
    df = spark.createDataFrame([(None if i % 7 == 0 else i % 3, "x" * 5) for i in range(40)], "v int, text string")
    got = sorted((r.v is not None, r.v or 0) for r in take_lowest(df, [F.col("v")], n).collect())
    assert got == sorted((r.v is not None, r.v or 0) for r in df.collect())[:n]


def test_balance_keeps_unlabelled_rows_and_exact_quotas(spark):
    rows = [(i // 4, 0) for i in range(40)] + [(i, 1) for i in range(10)] + [(i, None) for i in range(5)] + [(1, 2)] * 30
    df = spark.createDataFrame(rows, "id int, label int")
    counts = {r.label: r["count"] for r in balance_to_class(df, "label", 1, ["id"]).groupBy("label").count().collect()}
    assert counts == {0: 10, 1: 10, 2: 10, None: 5}


def test_classes(numbers):
    df = numbers.withColumn("label", F.when(F.col("id") < 30, 1).when(F.col("id") < 40, 2).otherwise(0))
    counts = lambda x: {r.label: r["count"] for r in x.groupBy("label").count().collect()}
    assert counts(balance_to_class(df, "label", 1, ["id"])) == {0: 30, 1: 30, 2: 10}
    assert counts(balance_to_class(df, "label", 2, ["id"])) == {0: 10, 1: 10, 2: 10}
    with pytest.raises(ValueError):
        balance_to_class(df, "label", 9, ["id"])
    assert balance_to_class(df, "label", -1, ["id"]).count() == 500
    assert counts(first_per_class(df, "label", [F.col("id")], 7)) == {0: 7, 1: 7, 2: 7}
    rest, share = split_by_share(df, ["id"], 0.2)
    assert rest.count() + share.count() == 500 and 60 < share.count() < 140


@pytest.fixture
def texts(spark):
    t0 = datetime(2020, 1, 1)
    rows = [
        (f"n{i}", f"p{i % 60}", t0 + timedelta(days=i), "RCP" if i % 3 else "X", f"le {1 + i % 28:02d}/03/2020 et {1 + i % 27:02d}/04/2020")
        for i in range(240)
    ]
    return spark.createDataFrame(
        rows, "note_id string, person_id string, note_datetime timestamp, note_class_source_value string, note_text string"
    )


def persons(df):
    return {r.person_id for r in df.select("person_id").distinct().collect()}


def test_split_test_is_disjoint_and_covers(spark, texts):
    existing = spark.createDataFrame([("p1",), ("p2",)], "person_id string")
    other, test = split_test(texts, 10, 29, ["RCP"], [existing])
    pool = texts.filter("note_class_source_value = 'RCP' and person_id not in ('p1', 'p2')")
    assert len(persons(test)) == 10 and not persons(test) & persons(other)
    assert other.count() + test.count() == pool.count()
    assert other.columns[0] == "set"
    train, nothing = split_existing(texts, [existing], ["RCP"])
    assert nothing is None and train.count() == pool.count()


def test_three_way(texts):
    train, test, dev = split_three_way(texts, 20, 10, 3)
    assert [len(persons(x)) for x in (train, test, dev)] == [30, 20, 10]
    assert dev.count() == 10
    assert not persons(train) & persons(test) and not persons(dev) & (persons(train) | persons(test))
    last = {r.person_id: r.note_id for r in dev.collect()}
    assert all(int(n[1:]) == 180 + int(p[1:]) for p, n in last.items())


def test_dev_alignable(spark, texts):
    from argentum.plans.align import align

    known = spark.createDataFrame(
        [(f"p{i}", datetime(2020, 3, 1 + i % 28), 1) for i in range(40)], "person_id string, known_date timestamp, label int"
    )
    train, test, dev = split_dev_alignable(texts, known, lambda t: align(known, t), 10, 5, 6, 29)
    groups = {r.alignment: r.n for r in dev.groupBy("alignment").agg(F.count("*").alias("n")).collect()}
    assert groups == {"dev matched": 5, "dev without cr": 6}
    assert len(persons(test)) == 10
    assert not persons(dev) & (persons(train) | persons(test)) and not persons(train) & persons(test)
    without = persons(dev.filter("alignment = 'dev without cr'"))
    assert not without & {f"p{i}" for i in range(40)}

    aligned = align(known, texts)
    examples, dev2 = split_dev_prealigned(texts, known, aligned, 5, 6)
    assert sorted(r.text_id for r in examples.collect()) == list(range(examples.count()))
    matched = persons(dev2.filter("alignment = 'dev matched'"))
    assert len(matched) == 5 and not matched & persons(examples)


def test_n_persons(texts):
    train, val = split_n_persons(texts, 15, 0)
    assert len(persons(train)) == 15 and not persons(train) & persons(val)
    assert train.count() + val.count() == 240
    assert math.isclose(train.count() / 15, 4)


def test_order_statistics_of_odd_values(spark):
    import random

    rng = random.Random(3)
    values = [rng.choice([0.0, -0.0, 1e-300, 5.0, 1e308, -1e308, float("inf"), float("-inf"), rng.random(), rng.lognormvariate(0, 40)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    at = order_statistics(df, "v", list(range(0, 500, 7)))
    assert at == {p: sorted(values)[p] for p in range(0, 500, 7)}
    assert order_statistics(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"), "v", [0]) == {0: 1.0}
    assert percentiles(spark.createDataFrame([(7,), (7,), (None,)], "v long"), "v", [0, 0.5, 1], "v") == [7.0, 7.0, 7.0]


@pytest.mark.parametrize("n", [1_500, 2_999, 3_000, 9_000])
def test_large_samples_take_no_sort(spark, rows, n):
    from argentum.operators import ranking

    numbers = spark.range(3_000).select("id", (F.col("id") % 3).alias("x"))
    expected = sorted((r.id for r in numbers.select("id", order_hash("id").alias("h")).orderBy("h").limit(n).collect()))
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ranking, "_WHOLE", 10)
        sample = uniform_sample(numbers, ["id"], n)
        assert sorted(r.id for r in sample.collect()) == expected
    # a key that all rows share: as many stay as fit
    assert uniform_sample(numbers, ["x"], n).count() == min(n, 3_000)
    assert "rangepartitioning" not in sample._jdf.queryExecution().executedPlan().toString()


def test_balance_spreads_ties(spark):
    """Most rows of a class share their key."""
    df = spark.range(6_000).select(F.when(F.col("id") < 2_500, 1).when(F.col("id") < 5_900, 2).alias("label"), F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("key"))
    out = balance_to_class(df, "label", 1, ["key"])
    assert {r["label"]: r["count"] for r in out.groupBy("label").count().collect()} == {1: 2_500, 2: 2_500, None: 100}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "rangepartitioning" not in plan
    assert balance_to_class(df.filter("key is null"), "label", -1, ["key"]).count() == 0
