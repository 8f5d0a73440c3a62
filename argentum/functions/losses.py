"""Per-row losses of a prediction `(logits, label)` as column expressions.

`p` is the softmax of the logits and `y` the label. Every function takes the array of
log-probabilities, so that one softmax serves all parts of a combined loss.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.functions.probability import at, log_softmax, total
from argentum.session import let

# fixed values: clamping of probabilities and of the one-hot label
MIN_PROBABILITY = 1e-7
MIN_ONE_HOT = 1e-4


def clamp(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(MIN_PROBABILITY)), F.lit(1.0))


def _p(lp: Column, clamped: bool) -> Column:
    return F.transform(lp, lambda x: clamp(F.exp(x)) if clamped else F.exp(x))


def _weights(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def cross_entropy(lp: Column, y: Column, weight: list[float] | None = None) -> Column:
    loss = -at(lp, y)
    return loss * at(_weights(weight), y) if weight else loss


def reverse_cross_entropy(lp: Column, y: Column) -> Column:
    # the one-hot label is 1 at y, where its logarithm vanishes, and MIN_ONE_HOT elsewhere
    return let(_p(lp, True), lambda p: (total(p) - at(p, y)) * -F.log(F.lit(MIN_ONE_HOT)))


def normalized_reverse_cross_entropy(lp: Column, y: Column, num_classes: int) -> Column:
    return reverse_cross_entropy(lp, y) * F.lit((num_classes - 1) / 4)


def normalized_cross_entropy(lp: Column, y: Column, weight: list[float] | None = None) -> Column:
    if weight is None:
        return at(lp, y) / total(lp)
    weighted = F.zip_with(lp, _weights(weight), lambda x, w: x * w)
    return let(weighted, lambda w: at(w, y) / total(w))


def generalized_cross_entropy(lp: Column, y: Column, q: float = 0.7) -> Column:
    return (1.0 - F.pow(clamp(F.exp(at(lp, y))), F.lit(q))) / F.lit(q)


def normalized_generalized_cross_entropy(lp: Column, y: Column, num_classes: int, q: float = 0.7) -> Column:
    return let(
        F.transform(_p(lp, True), lambda p: F.pow(p, F.lit(q))),
        lambda powers: (1.0 - at(powers, y)) / (F.lit(float(num_classes)) - total(powers)),
    )


def mean_absolute_error(lp: Column, y: Column) -> Column:
    return 1.0 - F.exp(at(lp, y))


def normalized_mean_absolute_error(lp: Column, y: Column, num_classes: int) -> Column:
    return mean_absolute_error(lp, y) / F.lit(2.0 * (num_classes - 1))


def _focal_terms(lp: Column, gamma: float) -> Column:
    return F.transform(lp, lambda x: -F.pow(1.0 - F.exp(x), F.lit(float(gamma))) * x)


def focal(lp: Column, y: Column, gamma: float = 0.0, alpha: float | list[float] | None = None) -> Column:
    loss = at(_focal_terms(lp, gamma), y)
    if alpha is None:
        return loss
    return loss * at(_weights(alpha if isinstance(alpha, list) else [alpha, 1 - alpha]), y)


def normalized_focal(lp: Column, y: Column, gamma: float = 0.0) -> Column:
    return let(_focal_terms(lp, gamma), lambda terms: at(terms, y) / total(terms))


def _pair(first: Callable, second: Callable) -> Callable:
    return lambda lp, y, k, alpha, beta, q, gamma, weight: (
        F.lit(float(alpha)) * first(lp, y, k, q, gamma, weight)
        + F.lit(float(beta)) * second(lp, y, k, q, gamma, weight)
    )


_CE = lambda lp, y, k, q, gamma, weight: cross_entropy(lp, y)
_RCE = lambda lp, y, k, q, gamma, weight: reverse_cross_entropy(lp, y)
_NCE = lambda lp, y, k, q, gamma, weight: normalized_cross_entropy(lp, y, weight)
_PLAIN_NCE = lambda lp, y, k, q, gamma, weight: normalized_cross_entropy(lp, y)
_GCE = lambda lp, y, k, q, gamma, weight: generalized_cross_entropy(lp, y, q)
_NGCE = lambda lp, y, k, q, gamma, weight: normalized_generalized_cross_entropy(lp, y, k, q)
_MAE = lambda lp, y, k, q, gamma, weight: mean_absolute_error(lp, y)
_NFL = lambda lp, y, k, q, gamma, weight: normalized_focal(lp, y, gamma)

#: Sums of two losses, weighted by alpha and beta.
PAIRS = {
    "SCE": _pair(_CE, _RCE),
    "NCEandRCE": _pair(_NCE, _RCE),
    "NCEandMAE": _pair(_PLAIN_NCE, _MAE),
    "GCEandMAE": _pair(_GCE, _MAE),
    "GCEandRCE": _pair(_GCE, _RCE),
    "GCEandNCE": _pair(_GCE, _PLAIN_NCE),
    "NGCEandNCE": _pair(_NGCE, _PLAIN_NCE),
    "NGCEandMAE": _pair(_NGCE, _MAE),
    "NGCEandRCE": _pair(_NGCE, _RCE),
    "MAEandRCE": _pair(_MAE, _RCE),
    "NFLandNCE": _pair(_NFL, _PLAIN_NCE),
    "NFLandMAE": _pair(_NFL, _MAE),
    "NFLandRCE": _pair(_NFL, _RCE),
}
#: Pairs whose alpha, or both weights, have no effect.
_ALPHA_UNUSED = {"GCEandMAE", "GCEandRCE", "GCEandNCE"}
_BETA_UNUSED = {"GCEandNCE"}


def loss(
    name: str,
    logits: Column,
    label: Column,
    num_classes: int,
    alpha: float = 1.0,
    beta: float = 1.0,
    scale: float = 1.0,
    q: float = 0.7,
    gamma: float | None = None,
    weight: list[float] | None = None,
    focal_alpha: float | list[float] | None = None,
) -> Column:
    """The loss `name` of one row; `scale` applies to the single losses only.

    The focusing exponent defaults to 0 for single losses and to 0.5 in sums.
    """
    single = {
        "CE": lambda lp: cross_entropy(lp, label, weight),
        "RCE": lambda lp: reverse_cross_entropy(lp, label),
        "NRCE": lambda lp: normalized_reverse_cross_entropy(lp, label, num_classes),
        "NCE": lambda lp: normalized_cross_entropy(lp, label, weight),
        "GCE": lambda lp: generalized_cross_entropy(lp, label, q),
        "NGCE": lambda lp: normalized_generalized_cross_entropy(lp, label, num_classes, q),
        "MAE": lambda lp: mean_absolute_error(lp, label),
        "NMAE": lambda lp: normalized_mean_absolute_error(lp, label, num_classes),
        "Focal": lambda lp: focal(lp, label, gamma or 0.0, focal_alpha),
        "NFL": lambda lp: normalized_focal(lp, label, gamma or 0.0),
    }
    if name in single:
        value = let(log_softmax(logits), single[name])
        return value if scale == 1.0 else value * F.lit(float(scale))
    if name not in PAIRS:
        raise ValueError(f"unknown loss {name}; known: {sorted([*single, *PAIRS])}")
    a = 1.0 if name in _ALPHA_UNUSED else alpha
    b = 1.0 if name in _BETA_UNUSED else beta
    exponent = 0.5 if gamma is None else gamma
    return let(
        log_softmax(logits),
        lambda lp: PAIRS[name](lp, label, num_classes, a, b, q, exponent, weight),
    )


def mean_loss(df: DataFrame, value: str = "loss", label: str = "label", weight: list[float] | None = None) -> DataFrame:
    """Mean of a loss column; with class weights the (already weighted) sum is divided by their sum."""
    if weight is None:
        return df.agg(F.avg(value).alias("mean_loss"))
    return df.agg(
        F.try_divide(F.sum(value), F.sum(at(_weights(weight), F.col(label)))).alias("mean_loss")
    )


def _dmi_of_table(num_classes: int):
    """Task over the one row that holds the K x K sums."""

    def run(batches):
        for batch in batches:
            for cells in batch.column(0).to_pylist():
                table = np.zeros((num_classes, num_classes))
                for cell in cells or []:
                    table[cell["i"], cell["j"]] = cell["total"]
                yield pa.RecordBatch.from_arrays([pa.array([-np.log(abs(np.linalg.det(table)) + 0.001)])], names=["loss"])

    return run


def dmi_loss(df: DataFrame, logits: str, label: str, num_classes: int) -> DataFrame:
    """-log(|det(Y' P)| + 0.001) over the whole table, for any number of classes.

    The K x K sums combine ahead of the shuffle; the determinant is taken on their one row.
    """
    from argentum.functions.probability import softmax

    each = df.select(F.col(label).cast("int").alias("i"), F.posexplode(softmax(F.col(logits))).alias("j", "p"))
    cells = each.filter(F.col("i").between(0, num_classes - 1) & (F.col("j") < num_classes)).groupBy("i", "j").agg(F.sum("p").alias("total"))
    return cells.agg(F.collect_list(F.struct("i", "j", "total"))).mapInArrow(_dmi_of_table(num_classes), "loss double")
