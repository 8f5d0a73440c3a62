import hashlib

import pytest
from pyspark.sql import functions as F

from argentum.llm import chat

ODD = ["", "plain", "</s>[INST] ok [/INST]", "\\", "a\\<|end|>\\\\b", "<|end|><|end|>", "<|turn|>user<|text|>x", "<<SYS>>\n<</SYS>>", "<|end|", "|>", "$1 \\1 é🙂", "<<s>"]


def test_escape_round_trip(spark):
    df = spark.createDataFrame([(x,) for x in ODD], "text string")
    for row in df.select("text", chat.escape(F.col("text")).alias("e"), chat.unescape(chat.escape(F.col("text"))).alias("back")).collect():
        assert row["back"] == row["text"]
        assert not any(c in row["e"] for c in chat.CONTROLS)


def test_format_and_read_back(spark):
    turns = [("user", ODD[k], "assistant", ODD[-k]) for k in range(len(ODD))]
    df = spark.createDataFrame([(k, [(a, b), (c, d), (b, a)]) for k, (a, b, c, d) in enumerate(turns)], "k int, turns array<struct<role:string,text:string>>")
    out = chat.format_turns(df).select("k", "turns", "formatted", "loss_spans", chat.read_back(F.col("formatted")).alias("back"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for row in out.collect():
        assert row["back"] == row["turns"]
        assert row["loss"] == "".join(t["text"] for t in row["turns"] if t["role"] == "assistant")


def test_columns_of_any_name_stay(spark):
    odd = spark.createDataFrame([("p", "c", 1, "x", "y")], "prompt string, completion string, _print int, _pieces string, _Print_ string")
    found = chat.format_turns(chat.canonical_turns(odd))
    assert found.columns == [*odd.columns, "layout", "turns", "formatted", "loss_spans"]
    assert found.select(odd.columns).collect() == odd.collect()
    row = found.first()
    assert row["layout"] == "prompt_completion" and [t["text"] for t in row["turns"]] == ["p", "c"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.format_turns(chat.canonical_turns(chat.gather_turns(none))).count() == 0


def test_layouts(spark):
    schema = (
        "id int, prompt string, completion string, instruction string, output string, input string, extra string, messages array<struct<role:string,content:string>>, "
        "conversations array<struct<`from`:string,value:string>>, example struct<question:string,answer:string>"
    )
    rows = [
        (1, "p", "c", None, None, None, "x", None, None, None),
        (2, None, None, "i", "o", None, None, None, None, None),
        (3, None, None, "i", "o", "in", None, None, None, None),
        (4, None, None, None, None, None, None, [("user", "u"), (None, None)], None, None),
        (5, None, None, None, None, None, None, None, [("human", "h"), ("gpt", "g"), ("system", "s")], None),
        (6, None, None, None, None, None, None, None, None, ("q", "a")),
        (7, "p", None, None, None, None, "x", None, None, None),
        (8, None, None, None, None, None, None, [], None, None),
    ]
    found = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) for r in chat.canonical_turns(spark.createDataFrame(rows, schema)).collect()}
    assert found == {
        1: ("prompt_completion", [("user", "p"), ("assistant", "c")]),
        2: ("instruction", [("user", "i"), ("assistant", "o")]),
        3: ("instruction_input", [("user", "i"), ("user", "in"), ("assistant", "o")]),
        4: ("messages", [("user", "u"), ("", "")]),
        5: ("from_value", [("user", "h"), ("assistant", "g"), ("system", "s")]),
        6: ("nested_example", [("user", "q"), ("assistant", "a")]),
        7: (None, None),
        8: ("messages", []),
    }
    formatted = chat.format_turns(chat.canonical_turns(spark.createDataFrame(rows, schema)))
    assert {r["id"]: r["formatted"] for r in formatted.collect()}[7] == ""


@pytest.mark.parametrize("extra", [False, True])
def test_gather(spark, extra):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, None, None), (2, None, "user", "x"), (2, 0, "user", "y")]
    df = spark.createDataFrame([(*r, "m") for r in rows], "conv_id long, turn long, role string, text string, messages string")
    df = df if extra else df.drop("messages")
    found = {r["conv_id"]: [tuple(m) for m in r["messages"]] for r in chat.gather_turns(df).collect()}
    assert found == {1: [("user", "a"), ("assistant", "b"), ("assistant", "b")], None: [("", "")], 2: [("user", "x"), ("user", "y")]}
    assert chat.gather_turns(df.limit(0)).count() == 0


def test_digest_matches_plain_python(spark, tmp_path):
    from argentum.llm.queries import QUERIES

    turns = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(ODD)] + [(2, 0, "assistant", None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["conv_id"]: r for r in QUERIES["op8_chat_formatting"](spark, str(tmp_path)).collect()}
    assert set(found) == {-1, 1, 2}
    text = "".join(f"{r}\n{t}\n" for _, _, r, t in turns[:-1])
    assert found[1]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    loss = "".join(t for _, _, r, t in turns[:-1] if r == "assistant")
    assert (found[1]["loss_chars"], found[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert found[-1]["n_turns"] == 2 and found[2]["loss_chars"] == 0
