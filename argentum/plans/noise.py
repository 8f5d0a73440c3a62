"""Label noise: loss ranking, loss profile, likelihood-ratio label correction.

Training happens elsewhere and leaves long tables `(sample_id, epoch, loss)` and
`(sample_id, epoch, probs)`, one row per sample and epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from argentum.functions.probability import argmax, at
from argentum.operators.ranking import bucket_of, percentiles
from argentum.operators.sampling import keep_low_share
from argentum.session import stage

# fixed value: mass that a corrected soft label spreads over the other classes
SOFT_LABEL_EPS = 1e-2


def loss_per_sample(losses: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Total loss of every sample; samples of the list without a loss count as 0."""
    totals = losses.groupBy("sample_id").agg(F.sum("loss").alias("total_loss"))
    if samples is None:
        return totals
    return samples.select("sample_id").join(totals, "sample_id", "left").na.fill(0.0, ["total_loss"])


def moving_loss(losses: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Sum over epochs of (loss - mean loss of the epoch).

    An unseen sample has loss 0 and counts in the mean, so the means of all epochs add up
    to the mean total loss over samples: one aggregate by sample and one scalar replace a
    mean per epoch, where each epoch holds a large part of the table.
    """
    totals = loss_per_sample(losses, samples)
    return totals.select(
        "sample_id", (F.col("total_loss") - totals.agg(F.avg("total_loss")).scalar()).alias("moving_loss")
    )


def keep_low_loss(moving: DataFrame, forget_rate: float) -> DataFrame:
    """Samples to keep for training: the lowest int((1 - forget_rate) * n) moving losses."""
    return keep_low_share(moving, "moving_loss", "sample_id", forget_rate).select("sample_id")


def mean_loss_by_epoch(losses: DataFrame, n_samples: int) -> DataFrame:
    """Mean over all samples, unseen ones as 0."""
    return losses.groupBy("epoch").agg((F.sum("loss") / F.lit(n_samples)).alias("mean_loss"))


def mean_loss_by_sample(losses: DataFrame, n_epochs: int, samples: DataFrame | None = None) -> DataFrame:
    return loss_per_sample(losses, samples).select(
        "sample_id", (F.col("total_loss") / F.lit(n_epochs)).alias("mean_loss")
    )


def bucket_samples(means: DataFrame, step: int = 10) -> tuple[DataFrame, list[float]]:
    """Samples with the percentile bucket of their mean loss; the maximum gets none and drops out."""
    bounds = percentiles(means, "mean_loss", [i / 100 for i in range(0, 101, step)], "sample_id")
    bucketed = means.withColumn("bucket", bucket_of(F.col("mean_loss"), bounds))
    return bucketed.filter("bucket is not null"), bounds


def loss_curves(losses: DataFrame, bucketed: DataFrame, first_epochs: int = 20) -> DataFrame:
    """Mean loss per bucket and epoch over the first epochs, unseen (sample, epoch) pairs as 0.

    One join by sample; sums then combine per (bucket, epoch) ahead of the shuffle.
    """
    epochs = losses.select("epoch").distinct().orderBy("epoch").limit(first_epochs)
    sizes = bucketed.groupBy("bucket").agg(F.count("*").alias("_n"))
    # buckets x epochs, both bounded by the arguments
    grid = sizes.select(
        "bucket", "_n", F.explode(epochs.agg(F.collect_list("epoch")).scalar()).alias("epoch")
    )
    sums = (
        losses.join(bucketed.select("sample_id", "bucket"), "sample_id")
        .groupBy("bucket", "epoch")
        .agg(F.sum("loss").alias("_sum"))
    )
    return grid.join(sums, ["bucket", "epoch"], "left").select(
        "bucket", "epoch", (F.coalesce("_sum", F.lit(0.0)) / F.col("_n")).alias("mean_loss")
    )


def pooled_curve(curves: DataFrame, n_buckets: int) -> DataFrame:
    """Unweighted mean of the curves of the first buckets."""
    return curves.filter(F.col("bucket") < n_buckets).groupBy("epoch").agg(F.avg("mean_loss").alias("mean_loss"))


def curve_variance(curves: DataFrame) -> DataFrame:
    """Population variance of every bucket's centred curve."""
    centred = F.col("mean_loss") - F.avg("mean_loss").over(Window.partitionBy("bucket"))
    return (
        curves.withColumn("centred_loss", centred)
        .groupBy("bucket")
        .agg(F.var_pop("centred_loss").alias("variance"))
    )


def label_mix(bucketed: DataFrame, labels: DataFrame, classes: list[int]) -> DataFrame:
    """Samples of each class per bucket, one column per class."""
    counts = [F.count_if(F.col("label") == c).alias(f"n_label_{c}") for c in classes]
    return bucketed.join(labels.select("sample_id", "label"), "sample_id").groupBy("bucket").agg(*counts)


def rolling_probability(probs: DataFrame, window_size: int, num_classes: int) -> DataFrame:
    """Mean class probabilities over a ring of `window_size` epochs, as `probs_bar`.

    Slot (epoch mod size) holds the sample's latest probabilities of that slot; unfilled
    slots count as 0. Windows hold one row per epoch of a sample.
    """
    w = Window.partitionBy("sample_id").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    zeros = F.array_repeat(F.lit(0.0), num_classes)
    slots = [
        F.coalesce(
            F.last(F.when(F.col("epoch") % window_size == s, F.col("probs")), ignorenulls=True).over(w), zeros
        )
        for s in range(window_size)
    ]
    total = slots[0]
    for slot in slots[1:]:
        total = F.zip_with(total, slot, lambda a, b: a + b)
    mean = F.transform(total, lambda x: x / F.lit(float(window_size)))
    return probs.withColumn("probs_bar", mean)


def ratio_threshold(epoch: Column, base: float, increment: float = 0.0, start: int = 0) -> Column:
    return F.lit(float(base)) + F.lit(float(increment)) * F.greatest(epoch - start, F.lit(0))


def rejects(bar: Column, label: Column, delta: Column) -> Column:
    """The likelihood ratio rejects the label: max(p) / p[label] > delta, infinite for p[label] = 0."""
    return (argmax(bar) != label) & (F.array_max(bar) > delta * at(bar, label))


def soft_label(label: Column, num_classes: int, eps: float = SOFT_LABEL_EPS) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(num_classes - 1)),
        lambda k: F.when(k == label, F.lit(1 - eps)).otherwise(F.lit(eps / (num_classes - 1))),
    )


def flip_labels(df: DataFrame, delta: float | Column, num_classes: int) -> DataFrame:
    """One correction step on `(sample_id, label, probs_bar)`: new and soft label, and what changed."""
    delta = delta if isinstance(delta, Column) else F.lit(float(delta))
    bar, label = F.col("probs_bar"), F.col("label")
    flipped = df.withColumn("new_label", F.when(rejects(bar, label, delta), argmax(bar)).otherwise(label))
    return flipped.withColumns(
        {
            "changed": F.col("new_label") != label,
            "soft_label": soft_label(F.col("new_label"), num_classes),
        }
    )


def correct_labels(
    rolled: DataFrame,
    labels: DataFrame,
    delta_base: float,
    increment: float = 0.0,
    start_epoch: int = 0,
) -> DataFrame:
    """The correction run over all epochs from `start_epoch`: each epoch starts from the last label.

    A fold over the epochs of a sample; its array holds one entry per epoch.
    """
    steps = (
        rolled.filter(F.col("epoch") >= start_epoch)
        .groupBy("sample_id")
        .agg(F.sort_array(F.collect_list(F.struct("epoch", "probs_bar"))).alias("_steps"))
    )

    def step(label: Column, s: Column) -> Column:
        delta = ratio_threshold(s["epoch"], delta_base, increment, start_epoch)
        bar = s["probs_bar"]
        return F.when(rejects(bar, label, delta), argmax(bar)).otherwise(label)

    joined = labels.select("sample_id", F.col("label").cast("int").alias("label")).join(steps, "sample_id", "left")
    final = F.coalesce(F.aggregate("_steps", F.col("label"), step), F.col("label"))
    return joined.select("sample_id", "label", final.alias("new_label"))


def label_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy("epoch", label).agg(F.count("*").alias("n"))


def switched_share(old: DataFrame, new: DataFrame) -> DataFrame:
    """Percentage of samples whose label changed."""
    both = old.select("sample_id", F.col("label").alias("old_label")).join(
        new.select("sample_id", F.col("label").alias("new_label")), "sample_id"
    )
    changed = F.avg((F.col("old_label") != F.col("new_label")).cast("int"))
    return both.agg(F.round(changed * 100, 2).alias("percent_switched"))


def changed_texts(flipped: DataFrame, texts: DataFrame) -> DataFrame:
    """Old label, new label and text of the samples that changed."""
    return (
        flipped.filter(F.col("label") != F.col("new_label"))
        .select("sample_id", F.col("label").alias("old_label"), "new_label")
        .join(texts.select("sample_id", "text"), "sample_id")
    )


def mean_probability(probs: DataFrame) -> DataFrame:
    """Mean probability of every class per epoch over samples."""
    return (
        probs.select("epoch", F.posexplode("probs").alias("class", "p"))
        .groupBy("epoch", "class")
        .agg(F.avg("p").alias("mean_p"))
    )


def loss_profile(
    losses: DataFrame,
    labels: DataFrame | None = None,
    step: int = 10,
    first_epochs: int = 20,
    classes: tuple[int, ...] = (0, 1, 2),
    pooled_share: int = 80,
) -> dict[str, DataFrame]:
    """Curves, pooled curve and variance per percentile bucket, and the label mix when labels are given."""
    n_epochs = losses.select("epoch").distinct().count()
    bucketed, _ = bucket_samples(stage(mean_loss_by_sample(losses, n_epochs), "means"), step)
    curves = loss_curves(losses, bucketed, first_epochs)
    out = {
        "curves": curves,
        "pooled": pooled_curve(curves, pooled_share // step),
        "variance": curve_variance(curves),
    }
    if labels is not None:
        out["label_mix"] = label_mix(bucketed, labels, list(classes))
    return out
