"""Documents to records by a user's own function."""

from __future__ import annotations

import sys
import traceback
from collections.abc import Callable, Iterable, Iterator, Mapping

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: What Python values are in the typed schema of a callback.
TYPES = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType(), bytes: T.BinaryType()}
#: Records, and characters of documents, that a worker turns into one batch.
BATCH_RECORDS, BATCH_CHARS = 10_000, 4_000_000


def record_schema(schema: str | T.StructType | Mapping[str, object]) -> T.StructType:
    """A schema from DDL, a struct, or names with Python types, Spark types or sample values."""
    if isinstance(schema, str):
        return T.StructType.fromDDL(schema)
    if isinstance(schema, T.StructType):
        return schema

    def kind(x: object) -> T.DataType:
        if isinstance(x, T.DataType):
            return x
        found = TYPES.get(x if isinstance(x, type) else type(x))
        if found is None:
            raise TypeError(f"no column type for {x!r}")
        return found

    return T.StructType([T.StructField(name, kind(x)) for name, x in schema.items()])


def extract(
    notes: DataFrame,
    callback: Callable[..., Iterable[Mapping[str, object]] | None],
    schema: str | T.StructType | Mapping[str, object],
    keep: tuple[str, ...] = ("note_id",),
    context: tuple[str, ...] = (),
    text: str = "note_text",
    errors: str = "raise",
) -> DataFrame:
    """One row per record that `callback(text, **context)` gives for a document, after the columns `keep`.

    Records are mappings; a field that one lacks is null, and a field that the schema lacks
    is an error. Documents without a text are left out, and so are those without records.
    `errors="raise"` stops at a failing document and names it by `keep`; with `"report"` it
    has one row with null fields whose column `error` holds the message, while
    records that it gave before are left out, and all other rows have a null there.

    The callback travels to the workers by value, with its module unless that is an installed one.

    A narrow job without a shuffle: only `keep`, `context` and the text travel to the
    workers, and a worker holds one document's records and one batch.
    """
    if errors not in ("raise", "report"):
        raise ValueError(f"unknown way with errors: {errors}")
    home = sys.modules.get(getattr(callback, "__module__", None) or "")
    if home and "site-packages" not in (getattr(home, "__file__", None) or "site-packages"):
        cloudpickle.register_pickle_by_value(home)
    fields = record_schema(schema)
    clash = [n for n in fields.names if n in keep] + (["error"] if errors == "report" and "error" in (*keep, *fields.names) else [])
    if clash:
        raise ValueError(f"columns would be there twice: {clash}")
    carried = list(dict.fromkeys([*keep, *context]))
    narrow = notes.filter(notes[text].isNotNull()).select(*[notes[c] for c in carried], notes[text].alias("_text"))
    own = [narrow.schema[c] for c in keep]
    result = T.StructType([*own, *fields.fields, *([T.StructField("error", T.StringType())] if errors == "report" else [])])
    return narrow.mapInArrow(_job(callback, to_arrow_schema(fields), keep, context, errors == "report"), result)


def _job(callback: Callable, fields: pa.Schema, keep: tuple[str, ...], context: tuple[str, ...], report: bool):
    def records_of(body: str, around: dict) -> pa.RecordBatch:
        """One document's records, checked against the schema."""
        records = []
        for record in callback(body, **around) or ():
            unknown = set(record) - set(fields.names)
            if unknown:
                raise KeyError(f"fields that the schema lacks: {sorted(unknown)}")
            records.append(record)
        columns = [pa.array([r.get(f.name) for r in records], f.type) for f in fields]
        return pa.RecordBatch.from_arrays(columns, schema=pa.schema([f.with_nullable(True) for f in fields]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts, messages, size = [], [], [], 0

            def flush() -> pa.RecordBatch:
                columns = [batch.column(c).take(pa.array(rows, pa.int64())) for c in keep]
                columns += [pa.concat_arrays([p.column(i) for p in parts]) for i in range(len(fields))]
                names = [*keep, *fields.names]
                if report:
                    columns.append(pa.array(messages, pa.string()))
                    names.append("error")
                return pa.RecordBatch.from_arrays(columns, names=names)

            arounds = [batch.column(c).to_pylist() for c in context]
            for row, body in enumerate(batch.column("_text").to_pylist()):
                message = None
                try:
                    found = records_of(body, {c: a[row] for c, a in zip(context, arounds)})
                except Exception as error:
                    name = ", ".join(f"{c} {batch.column(c)[row].as_py()!r}" for c in keep)
                    message = f"{type(error).__name__}: {error}"
                    if not report:
                        raise ValueError(f"extraction failed at {name}: {message}\n{traceback.format_exc()}") from error
                    found = pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in fields], schema=pa.schema([f.with_nullable(True) for f in fields]))
                rows += [row] * found.num_rows
                messages += [message] * found.num_rows
                if found.num_rows:
                    parts.append(found)
                size += len(body)
                if rows and (len(rows) >= BATCH_RECORDS or size >= BATCH_CHARS):
                    yield flush()
                    rows, parts, messages, size = [], [], [], 0
            if rows:
                yield flush()

    return run
