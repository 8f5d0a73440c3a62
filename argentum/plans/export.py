"""Export tables for training and for annotation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from argentum.functions.columns import replace_missing_letters
from argentum.operators.joins import keep_keys
from argentum.operators.sampling import balance_to_class, split_by_share
from argentum.sources.fixed_values import ANNOTATION_CONSTANTS


def to_model_schema(
    df: DataFrame,
    text_col: str = "masked_span",
    id_col: str = "text_id",
    span_cols: tuple[str, str] = ("masked_span_start_char", "masked_span_end_char"),
    label_col: str | None = "label",
    fix_letters: bool = False,
) -> DataFrame:
    """Columns id, text, span_start, span_end and, unless only predicting, label."""
    text = replace_missing_letters(text_col) if fix_letters else F.col(text_col)
    columns = [
        F.col(id_col).alias("id"),
        text.alias("text"),
        F.col(span_cols[0]).alias("span_start"),
        F.col(span_cols[1]).alias("span_end"),
    ]
    if label_col is not None:
        columns.append(F.col(label_col).alias("label"))
    return df.select(*columns)


def export_splits(
    splits: dict[str, DataFrame], balance: int = -1, balanced: str = "train", seed: int = 0, **columns: object
) -> DataFrame:
    """Named splits as one table with a `set` column; `balance` cuts one split to a class size."""
    parts = []
    for name, df in splits.items():
        part = to_model_schema(df, **columns)
        if name == balanced:
            part = balance_to_class(part, "label", balance, ["id"], seed)
        parts.append(part.withColumn("set", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def csv_to_splits(
    df: DataFrame, test_size: float = 0.1, seed: int = 42, label_col: str | None = "to_keep", **columns: object
) -> DataFrame:
    """Mapped rows with missing letters replaced, split in train and val; no split without labels."""
    defaults = {
        "text_col": "note_text",
        "id_col": "text_id",
        "span_cols": ("offset_begin", "offset_end"),
    }
    mapped = to_model_schema(df, label_col=label_col, fix_letters=True, **{**defaults, **columns})
    if label_col is None:
        return mapped
    train, val = split_by_share(mapped, ["id"], test_size, seed)
    return train.withColumn("set", F.lit("train")).unionByName(val.withColumn("set", F.lit("val")))


def annotation_tables(mentions: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, texts) for annotators: constant label columns; texts of the notes with entities."""
    entities = mentions.withColumnsRenamed(
        {"text_start_char": "offset_begin", "text_end_char": "offset_end"}
    ).withColumns({name: F.lit(value) for name, value in ANNOTATION_CONSTANTS.items()})
    texts = keep_keys(documents.select("note_id", "note_text"), entities, ["note_id"]).withColumn(
        "title", F.col("note_id").cast("string")
    )
    return entities, texts
