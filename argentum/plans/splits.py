"""Person-disjoint splits. Every splitter takes texts and returns DataFrames with a `set` column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.operators.joins import exclude_keys, keep_keys
from argentum.operators.ranking import dense_id
from argentum.operators.sampling import nested_samples, sample_keys
from argentum.operators.windows import last_non_null
from argentum.session import stage


def of_classes(texts: DataFrame, note_classes: list[str] | None = None) -> DataFrame:
    if note_classes is None:
        return texts
    return texts.filter(F.col("note_class_source_value").isin(list(note_classes)))


def without_persons(texts: DataFrame, existing: list[DataFrame] | None = None) -> DataFrame:
    """Texts of persons that occur in none of the existing datasets."""
    if not existing:
        return texts
    known = reduce(DataFrame.unionByName, [df.select("person_id") for df in existing])
    return exclude_keys(texts, known, ["person_id"])


def tag(texts: DataFrame, name: str) -> DataFrame:
    """`set` as the first column."""
    return texts.select(F.lit(name).alias("set"), *[c for c in texts.columns if c != "set"])


def split_test(
    texts: DataFrame,
    n_test: int,
    seed: int,
    note_classes: list[str] | None = None,
    existing: list[DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(not test, test): the texts of `n_test` sampled persons are the test set."""
    texts = without_persons(of_classes(texts, note_classes), existing)
    persons = sample_keys(texts, "person_id", n_test, seed)
    return (
        tag(exclude_keys(texts, persons, ["person_id"]), "not test"),
        tag(keep_keys(texts, persons, ["person_id"]), "test"),
    )


def split_existing(
    texts: DataFrame, existing: list[DataFrame], note_classes: list[str] | None = None
) -> tuple[DataFrame, None]:
    """Everything outside the existing datasets; there is no second set."""
    return without_persons(of_classes(texts, note_classes), existing), None


def split_three_way(
    texts: DataFrame, n_test: int, n_dev: int, seed: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, dev): disjoint persons; dev keeps the last text per person."""
    dev, test = nested_samples(texts, "person_id", n_dev, n_test, seed)
    return (
        tag(exclude_keys(texts, dev.union(test), ["person_id"]), "train"),
        tag(keep_keys(texts, test, ["person_id"]), "test"),
        tag(last_non_null(keep_keys(texts, dev, ["person_id"])), "dev"),
    )


def _dev_texts(texts: DataFrame, matched: DataFrame, matched_persons: DataFrame, without: DataFrame) -> DataFrame:
    """Last text per dev person, with the group the person came from."""
    notes = keep_keys(matched, matched_persons, ["person_id"]).select("note_id")
    chosen = keep_keys(texts, notes, ["note_id"]).unionByName(keep_keys(texts, without, ["person_id"]))
    flagged = last_non_null(chosen).join(
        matched_persons.withColumn("_matched", F.lit(True)), "person_id", "left"
    )
    group = F.when(F.col("_matched"), "dev matched").otherwise("dev without cr")
    return flagged.select(F.lit("dev").alias("set"), group.alias("alignment"), *texts.columns)


def split_dev_alignable(
    texts: DataFrame,
    known: DataFrame,
    aligner: Callable[[DataFrame], DataFrame],
    n_test: int = 200,
    n_dev_matched: int = 20,
    n_dev_without: int = 20,
    seed: int = 29,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train, test, dev): after the test persons are set aside, `aligner` labels the rest.

    Dev takes persons with a matched date (their matched notes) and persons without any
    known date; the last text per person. Dev persons are not in train.
    """
    test = sample_keys(texts, "person_id", n_test, seed)
    rest = exclude_keys(texts, test, ["person_id"])
    matched = stage(aligner(rest).filter(F.col("label").cast("int") == 1).select("person_id", "note_id").distinct(), "matched")
    dev_matched = sample_keys(matched, "person_id", n_dev_matched, seed)
    dev_without = sample_keys(exclude_keys(rest, known, ["person_id"]), "person_id", n_dev_without, seed)
    return (
        tag(exclude_keys(rest, dev_matched.union(dev_without), ["person_id"]), "train"),
        tag(keep_keys(texts, test, ["person_id"]), "test"),
        _dev_texts(texts, matched, dev_matched, dev_without),
    )


def split_dev_prealigned(
    texts: DataFrame,
    known: DataFrame,
    aligned: DataFrame,
    n_dev_matched: int,
    n_dev_without: int,
    seed: int = 29,
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(train examples with new text ids, dev texts) from examples that are aligned already.

    Dev persons without a known date stay in the train examples unless `strict`.
    """
    to_text = lambda df: df.withColumns({c: F.col(c).cast("string") for c in ("person_id", "note_id")})
    texts, aligned = to_text(texts), to_text(aligned)
    known = known.select(F.col("person_id").cast("string").alias("person_id"))
    matched = aligned.filter(F.col("label").cast("int") == 1).select("person_id", "note_id").distinct()
    dev_matched = sample_keys(matched, "person_id", n_dev_matched, seed)
    dev_without = sample_keys(exclude_keys(texts, known, ["person_id"]), "person_id", n_dev_without, seed)
    held_out = dev_matched.union(dev_without) if strict else dev_matched
    train = exclude_keys(aligned, held_out, ["person_id"]).withColumn("set", F.lit("train"))
    order = [F.col(c) for c in ("note_id", "text_start_char", "text_end_char", "label")]
    return dense_id(train.drop("text_id"), order, "text_id"), _dev_texts(texts, matched, dev_matched, dev_without)


def split_n_persons(df: DataFrame, n_persons: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, val): examples of `n_persons` sampled persons, and the rest."""
    persons = sample_keys(df, "person_id", n_persons, seed)
    return (
        tag(keep_keys(df, persons, ["person_id"]), "train"),
        tag(exclude_keys(df, persons, ["person_id"]), "val"),
    )
