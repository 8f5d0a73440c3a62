"""Logits, probabilities and predictions held in arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from argentum.session import let


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def log_softmax(logits: Column) -> Column:
    def shifted(top: Column) -> Column:
        return let(
            top + F.log(total(F.transform(logits, lambda x: F.exp(x - top)))),
            lambda norm: F.transform(logits, lambda x: x - norm),
        )

    return let(F.array_max(logits), shifted)


def softmax(logits: Column) -> Column:
    return F.transform(log_softmax(logits), F.exp)


def argmax(values: Column) -> Column:
    """0-based position of the maximum, the lowest on ties."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def at(values: Column, index: Column) -> Column:
    """Element at a 0-based index."""
    return F.element_at(values, index.cast("int") + 1)


def sigmoid_prediction(logit: Column) -> Column:
    """Rounded sigmoid with the half-to-even rule: 1 only when the probability exceeds one half."""
    return (logit > 0).cast("int")


def to_prediction(logits: Column, num_classes: int, multilabel: bool = False) -> Column:
    """Class index for exclusive classes, else one 0/1 flag per logit."""
    if num_classes > 1 and not multilabel:
        return argmax(logits)
    return F.transform(logits, sigmoid_prediction)


def binarise(prediction: Column, num_classes: int) -> Column:
    """With more than two classes, predictions above 1 count as 0."""
    return F.when(prediction > 1, 0).otherwise(prediction) if num_classes > 2 else prediction
