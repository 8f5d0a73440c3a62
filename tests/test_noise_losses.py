import numpy as np
import pytest
from pyspark.sql import functions as F

from argentum.functions.losses import PAIRS, dmi_loss, loss, mean_loss
from argentum.functions.probability import argmax, binarise, softmax, to_prediction
from argentum.plans.noise import (
    bucket_samples,
    correct_labels,
    flip_labels,
    keep_low_loss,
    label_mix,
    loss_profile,
    mean_loss_by_epoch,
    mean_loss_by_sample,
    moving_loss,
    rolling_probability,
    switched_share,
)

RNG = np.random.default_rng(0)


@pytest.fixture(scope="module")
def trace(spark):
    matrix = RNG.gamma(2.0, size=(40, 6)).round(3)
    seen = RNG.random((40, 6)) > 0.1
    seen[0] = False  # a sample that was never seen
    rows = [(i, e, float(matrix[i, e])) for i in range(40) for e in range(6) if seen[i, e]]
    samples = spark.createDataFrame([(i, i % 3) for i in range(40)], "sample_id int, label int")
    return spark.createDataFrame(rows, "sample_id int, epoch int, loss double"), samples, np.where(seen, matrix, 0.0)


def test_moving_loss_equals_the_epoch_loop(trace):
    losses, samples, matrix = trace
    expected = (matrix - matrix.mean(axis=0)).sum(axis=1)
    got = {r.sample_id: r.moving_loss for r in moving_loss(losses, samples).collect()}
    assert [got[i] for i in range(40)] == pytest.approx(list(expected))
    kept = {r.sample_id for r in keep_low_loss(moving_loss(losses, samples), 0.3).collect()}
    assert kept == set(np.argsort(expected, kind="stable")[: int(0.7 * 40)])
    by_epoch = {r.epoch: r.mean_loss for r in mean_loss_by_epoch(losses, 40).collect()}
    assert [by_epoch[e] for e in range(6)] == pytest.approx(list(matrix.mean(axis=0)))


def test_profile_equals_numpy(trace):
    losses, samples, matrix = trace
    means = matrix.mean(axis=1)
    bounds = np.percentile(means, range(0, 101, 20))
    groups = [[i for i in range(40) if bounds[j] <= means[i] < bounds[j + 1]] for j in range(5)]
    bucketed, got_bounds = bucket_samples(mean_loss_by_sample(losses, 6, samples), 20)
    assert got_bounds == pytest.approx(list(bounds))
    assert sorted((r.bucket, r.sample_id) for r in bucketed.collect()) == [(j, i) for j in range(5) for i in groups[j]]

    seen = sorted({i for i in range(40) if matrix[i].any()})
    sub = matrix[seen]
    sub_means = sub.mean(axis=1)
    sub_bounds = np.percentile(sub_means, range(0, 101, 20))
    sub_groups = [[i for i in range(len(seen)) if sub_bounds[j] <= sub_means[i] < sub_bounds[j + 1]] for j in range(5)]
    curves = np.array([sub[g].mean(axis=0)[:4] for g in sub_groups])
    profile = loss_profile(losses, samples, step=20, first_epochs=4)
    got = {(r.bucket, r.epoch): r.mean_loss for r in profile["curves"].collect()}
    assert [got[j, e] for j in range(5) for e in range(4)] == pytest.approx(list(curves.ravel()))
    pooled = {r.epoch: r.mean_loss for r in profile["pooled"].collect()}
    assert [pooled[e] for e in range(4)] == pytest.approx(list(curves[:4].mean(axis=0)))
    variance = {r.bucket: r.variance for r in profile["variance"].collect()}
    assert [variance[j] for j in range(5)] == pytest.approx([np.var(c) for c in curves])
    mix = {r.bucket: r.n_label_1 for r in profile["label_mix"].collect()}
    assert mix == {j: sum(seen[i] % 3 == 1 for i in g) for j, g in enumerate(sub_groups)}
    assert label_mix(bucketed, samples, [0]).count() == 5


def test_ring_of_probabilities(spark):
    rows = [(1, e, [0.1 * e, 1 - 0.1 * e]) for e in (0, 1, 2, 4)]
    probs = spark.createDataFrame(rows, "sample_id int, epoch int, probs array<double>")
    got = {r.epoch: r.probs_bar[0] for r in rolling_probability(probs, 2, 2).collect()}
    ring, expected = [0.0, 0.0], {}
    for _, e, p in rows:
        ring[e % 2] = p[0]
        expected[e] = sum(ring) / 2
    assert got == pytest.approx(expected)


def test_flip_rules(spark):
    rows = [
        (1, 0, [0.2, 0.8]),  # ratio 4
        (2, 0, [0.5, 0.5]),  # tie: the lowest class is the maximum
        (3, 1, [1.0, 0.0]),  # own probability 0
        (4, 0, [0.25, 0.5]),  # ratio exactly delta
        (5, 1, [0.4, 0.6]),
    ]
    df = spark.createDataFrame(rows, "sample_id int, label int, probs_bar array<double>")
    out = {r.sample_id: (r.new_label, r.changed, r.soft_label) for r in flip_labels(df, 2.0, 2).collect()}
    assert {k: v[:2] for k, v in out.items()} == {1: (1, True), 2: (0, False), 3: (0, True), 4: (0, False), 5: (1, False)}
    assert out[1][2] == pytest.approx([0.01, 0.99])
    assert switched_share(df.select("sample_id", "label"), df.select("sample_id", F.lit(0).alias("label"))).first()[0] == 40.0


def test_correction_over_epochs_equals_a_loop(spark):
    probs = RNG.dirichlet([1, 1, 1], size=(15, 7))
    rows = [(i, e, [float(x) for x in probs[i, e]]) for i in range(15) for e in range(7)]
    df = spark.createDataFrame(rows, "sample_id int, epoch int, probs array<double>")
    labels = spark.createDataFrame([(i, i % 3) for i in range(15)], "sample_id int, label int")
    got = {r.sample_id: r.new_label for r in correct_labels(rolling_probability(df, 2, 3), labels, 1.1, 0.2, 2).collect()}
    for i in range(15):
        y, ring = i % 3, np.zeros((2, 3))
        for e in range(7):
            ring[e % 2] = probs[i, e]
            bar = ring.mean(axis=0)
            if e >= 2 and bar.argmax() != y and bar.max() > (1.1 + 0.2 * (e - 2)) * bar[y]:
                y = int(bar.argmax())
        assert got[i] == y


@pytest.fixture(scope="module")
def predictions(spark):
    z = RNG.normal(size=(30, 3)) * 3
    y = RNG.integers(0, 3, 30)
    df = spark.createDataFrame([(i, [float(v) for v in z[i]], int(y[i])) for i in range(30)], "id int, logits array<double>, label int")
    return df, z, y


def numpy_losses(z, y, q=0.7, gamma=0.5):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    lp, c, i = np.log(p), np.clip(p, 1e-7, 1), np.arange(len(y))
    hot = np.clip(np.eye(3)[y], 1e-4, 1)
    ce, mae = -lp[i, y], 1 - p[i, y]
    rce = -(c * np.log(hot)).sum(axis=1)
    nce = lp[i, y] / lp.sum(axis=1)
    gce = (1 - c[i, y] ** q) / q
    ngce = (1 - c[i, y] ** q) / (3 - (c**q).sum(axis=1))
    focal = -((1 - p) ** gamma) * lp
    nfl = focal[i, y] / focal.sum(axis=1)
    a, b = 0.5, 2.0
    return {
        "CE": ce, "RCE": rce, "NRCE": rce / 2, "NCE": nce, "GCE": gce, "NGCE": ngce, "MAE": mae, "NMAE": mae / 4,
        "Focal": focal[i, y], "NFL": nfl, "SCE": a * ce + b * rce, "NCEandRCE": a * nce + b * rce, "NCEandMAE": a * nce + b * mae,
        "GCEandMAE": gce + b * mae, "GCEandRCE": gce + b * rce, "GCEandNCE": gce + nce, "NGCEandNCE": a * ngce + b * nce,
        "NGCEandMAE": a * ngce + b * mae, "NGCEandRCE": a * ngce + b * rce, "MAEandRCE": a * mae + b * rce,
        "NFLandNCE": a * nfl + b * nce, "NFLandMAE": a * nfl + b * mae, "NFLandRCE": a * nfl + b * rce,
    }


def test_losses_equal_numpy(predictions):
    df, z, y = predictions
    expected = numpy_losses(z, y)
    assert set(PAIRS) <= set(expected)
    columns = [
        loss(name, F.col("logits"), F.col("label"), 3, alpha=0.5, beta=2.0, gamma=0.5).alias(name) for name in expected
    ]
    got = df.select("id", *columns).toPandas().sort_values("id")
    for name, values in expected.items():
        assert got[name].to_numpy() == pytest.approx(values, rel=1e-9), name
    with pytest.raises(ValueError):
        loss("nothing", F.col("logits"), F.col("label"), 3)


def test_weighted_mean_and_determinant(predictions):
    df, z, y = predictions
    w = [1.0, 3.0, 0.5]
    ce = numpy_losses(z, y)["CE"]
    weighted = df.withColumn("loss", loss("CE", F.col("logits"), F.col("label"), 3, weight=w))
    assert mean_loss(weighted, weight=w).first()[0] == pytest.approx((ce * np.array(w)[y]).sum() / np.array(w)[y].sum())
    e = np.exp(z)
    p = e / e.sum(axis=1, keepdims=True)
    expected = -np.log(abs(np.linalg.det(np.eye(3)[y].T @ p)) + 1e-3)
    assert dmi_loss(df, "logits", "label", 3).first()[0] == pytest.approx(expected)


def test_determinant_of_many_classes(spark):
    rng = np.random.default_rng(0)
    z, y = rng.normal(size=(60, 9)), np.arange(60) % 9
    df = spark.createDataFrame([(row.tolist(), int(k)) for row, k in zip(z, y, strict=True)], "logits array<double>, label int")
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    expected = -np.log(abs(np.linalg.det(np.eye(9)[y].T @ p)) + 1e-3)
    assert dmi_loss(df, "logits", "label", 9).first()[0] == pytest.approx(expected)


def test_predictions(spark):
    df = spark.createDataFrame([([800.0, 1.0, -800.0],), ([0.0, 0.0, -1.0],)], "z array<double>")
    out = df.select(softmax(F.col("z")).alias("p"), argmax(F.col("z")).alias("k"), to_prediction(F.col("z"), 3, True).alias("m")).collect()
    assert out[0].p == [1.0, 0.0, 0.0] and [r.k for r in out] == [0, 0] and out[0].m == [1, 1, 0] and out[1].m == [0, 0, 0]
    labels = spark.createDataFrame([(0,), (1,), (2,)], "k int")
    assert [r[0] for r in labels.select(binarise(F.col("k"), 3)).collect()] == [0, 1, 0]
    assert [r[0] for r in labels.select(binarise(F.col("k"), 2)).collect()] == [0, 1, 2]
