"""Conversations of different layouts as canonical turns, and turns as text for training.

A layout is recognised by its schema fingerprint: the hash of the sorted nested field paths
that a row fills. The fingerprint selects a declarative mapping, which turns the row into
`turns`, an array of (role, text). Only column expressions are used.

The template marks a turn as `<|turn|>role<|text|>text<|end|>`. Control strings inside roles
and texts are escaped with a backslash after their first character, and a backslash is
doubled, so that one pass over `\\x -> x` restores them.

Columns that a step writes (`layout` and `turns`, `formatted` and `loss_spans`) replace columns
of the same name; all others stay, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from argentum.llm.names import unused

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

# Control strings of common chat formats, which texts may hold.
CONTROLS = (
    TURN,
    TEXT,
    END,
    "<|im_start|>",
    "<|im_end|>",
    "<|endoftext|>",
    "<|startoftext|>",
    "<s>",
    "</s>",
    "[INST]",
    "[/INST]",
    "<<SYS>>",
    "<</SYS>>",
)


@dataclass(frozen=True)
class Layout:
    """`paths` are the filled field paths; `turns` are (role, path), or a path to an array of (role, text) fields."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None  # array column, role field, text field
    roles: tuple[tuple[str, str], ...] = ()  # names of speakers here, as canonical roles


LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), messages=("messages", "role", "content")),
    Layout(
        "from_value",
        ("conversations[].from", "conversations[].value"),
        messages=("conversations", "from", "value"),
        roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant")),
    ),
    Layout("prompt_completion", ("completion", "prompt"), turns=(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), turns=(("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", ("instruction", "output"), turns=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", ("input", "instruction", "output"), turns=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system_prompt", ("completion", "prompt", "system"), turns=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("nested_example", ("example.answer", "example.question"), turns=(("user", "example.question"), ("assistant", "example.answer"))),
)


def field_paths(schema: T.StructType, keep: Sequence[str] = ()) -> list[tuple[str, str]]:
    """(path, column to test) of every leaf; elements of an array are tested by the array."""
    found = []

    def walk(kind: T.DataType, path: str, column: str) -> None:
        if isinstance(kind, T.StructType):
            for field in kind.fields:
                name = field.name.replace("`", "``")
                walk(field.dataType, f"{path}.{field.name}" if path else field.name, column if "[]" in path else f"{column}.`{name}`" if column else f"`{name}`")
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, f"{path}[]", column)
        else:
            found.append((path, column))

    for field in schema.fields:
        if field.name not in keep:
            walk(T.StructType([field]), "", "")
    return found


def known_paths(layouts: Sequence[Layout]) -> set[str]:
    return {path for layout in layouts for path in layout.paths}


def fingerprint(df: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the sorted field paths that a row fills, among the paths that any layout knows.

    Other columns of a table don't change it. An empty array is filled.
    """
    known = known_paths(layouts)
    filled = [F.when(F.col(column).isNotNull(), F.lit(path)) for path, column in sorted(field_paths(df.schema)) if path in known]
    return F.xxhash64(F.array_join(F.array(*filled), "\n") if filled else F.lit(""))


def _turn(role: Column, text: Column, names: Sequence[tuple[str, str]] = ()) -> Column:
    role = named = F.coalesce(role.cast("string"), F.lit(""))
    for own, canonical in names:
        named = F.when(role == own, canonical).otherwise(named)
    return F.struct(named.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _turns_of_messages(layout: Layout) -> Column:
    column, role, text = layout.messages
    return F.transform(F.col(f"`{column}`"), lambda m: _turn(m[role], m[text], layout.roles))


def canonical_turns(df: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """Add `layout` (string) and `turns` (array of (role, text)).

    A row of unknown fingerprint keeps null in both, so that it can be counted and mapped
    later. A null role or text becomes an empty string; an empty message array, no turns.
    """
    helper = unused(df.columns, "_print")
    by_paths = {path: column for path, column in field_paths(df.schema)}
    usable = [x for x in layouts if all(path in by_paths for path in x.paths)]
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in usable:
        # the literal is hashed by the same function as the row
        same = F.col(helper) == F.xxhash64(F.lit("\n".join(sorted(layout.paths))))
        if layout.messages:
            made = _turns_of_messages(layout)
        else:
            made = F.array(*[_turn(F.lit(role), F.col(by_paths[path])) for role, path in layout.turns])
        name, turns = F.when(same, layout.name).otherwise(name), F.when(same, made).otherwise(turns)
    return df.withColumn(helper, fingerprint(df, layouts)).withColumns({"layout": name, "turns": turns}).drop(helper)


def gather_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn as one row per conversation with `messages`, an array of (role, content).

    Turns are ordered by number, ties by role and text; null roles and texts are empty; rows
    that repeat stay. A conversation has to be whole for its text, so it must fit in a task.
    """
    parts = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    made = rows.groupBy(F.col(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(parts)).alias("messages"))
    return made.withColumn("messages", F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))))


def _literal(text: str) -> str:
    return "".join(f"\\{x}" if not x.isalnum() and x not in "_ <>/" else x for x in text)


def escape(text: Column, controls: Sequence[str] = CONTROLS) -> Column:
    """Put a backslash behind the first character of every control string and double backslashes."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    heads = "|".join(f"{_literal(x[0])}(?={_literal(x[1:])})" for x in sorted(set(controls)))
    return F.regexp_replace(doubled, F.lit(f"({heads})"), F.lit("$1\\\\"))


def unescape(text: Column) -> Column:
    """Undo `escape`."""
    return F.regexp_replace(text, F.lit(r"(?s)\\(.)"), F.lit("$1"))


def format_turns(df: DataFrame, trained: Sequence[str] = ("assistant",)) -> DataFrame:
    """Add `formatted` (string) and `loss_spans`, an array of (start, end) in code points.

    The spans are the escaped texts of the trained roles; empty texts have empty spans.
    Rows without turns (null) give an empty text.
    """
    pieces = F.transform(
        F.coalesce("turns", F.array().cast("array<struct<role:string,text:string>>")),
        lambda t: F.struct(F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT)).alias("head"), escape(t["text"]).alias("body"), t["role"].isin(*trained).alias("trained")),
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def walk(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.length(p["head"])
        end = begin + F.length(p["body"])
        one = F.when(p["trained"], F.array(F.struct(begin.alias("start"), end.alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
        return F.struct((end + len(END)).alias("at"), F.concat(acc["spans"], one).alias("spans"))

    helper = unused(df.columns, "_pieces")
    out = df.withColumn(helper, pieces)
    return out.withColumns(
        {
            "formatted": F.array_join(F.transform(helper, lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""),
            "loss_spans": F.aggregate(helper, start, walk, lambda acc: acc["spans"]),
        }
    ).drop(helper)


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text."""
    ended = F.split(formatted, _literal(END))
    full = F.slice(ended, 1, F.size(ended) - 1)

    def one(part: Column) -> Column:
        two = F.split(F.substring(part, len(TURN) + 1, 2**31 - 1), _literal(TEXT), 2)
        return F.struct(unescape(two[0]).alias("role"), unescape(two[1]).alias("text"))

    return F.transform(full, one)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
