from datetime import datetime

import pytest
from pyspark.sql import functions as F

from argentum.functions.columns import decode, parse_or_drop, replace_missing_letters, to_zone
from argentum.operators.metrics import all_allowed, binary_scores, distinct_count, value_counts
from argentum.plans.export import annotation_tables, csv_to_splits, export_splits, to_model_schema
from argentum.plans.quality import contradictions, flag_reports, gold_examples, gold_labels, report_strata, score, silver_quality
from argentum.session import broadcast_if_small, stage
from argentum.sources.sinks import write_loss_trace

SPAN = "note_id string, text_start_char int, text_end_char int, label int"


def test_scores(spark):
    rows = [(1, 1, "a"), (1, 0, "a"), (0, 1, "a"), (0, 0, "a"), (0, 0, "b"), (1, 1, "c")]
    df = spark.createDataFrame(rows, "prediction int, label int, status string")
    total = binary_scores(df).first()
    assert (total.tp, total.fp, total.fn) == (2, 1, 1) and total.f1 == pytest.approx(2 / 3)
    by = {r.status: (r.precision, r.recall, r.f1) for r in binary_scores(df, by=["status"]).collect()}
    # a stratum without positives scores 0
    assert by == {"a": (0.5, 0.5, 0.5), "b": (0.0, 0.0, 0.0), "c": (1.0, 1.0, 1.0)}


def test_score_from_logits(spark):
    rows = [([0.0, 1.0, 5.0], 1, "x"), ([0.0, 2.0, 1.0], 1, "x"), ([3.0, 0.0, 0.0], 0, "y")]
    df = spark.createDataFrame(rows, "logits array<double>, label int, status string")
    out = score(df, 3, loss_name="CE").first()
    assert (out.tp, out.fp, out.fn) == (1, 0, 1) and out.loss > 0
    by = score(df, 3, by=["status"], loss_name="MAE")
    assert by.count() == 2 and "loss" in by.columns
    single = spark.createDataFrame([([0.3], 1), ([0.0], 1), ([-2.0], 0)], "logits array<double>, label int")
    assert score(single, 1).first().tp == 1


def test_all_allowed_with_nulls(spark, rows):
    df = spark.createDataFrame([("1", "a"), ("1", None), ("2", "a"), ("2", "z"), ("3", None)], "note_id string, m string")
    assert rows(all_allowed(df, "note_id", "m", ["a"])) == [("1",)]


def test_counts(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "g string, v int")
    assert rows(value_counts(df, ["v"], ["g"], normalize=True)) == [("a", 1, 1.0), ("b", 2, 1.0)]
    assert rows(value_counts(df, ["v"])) == [(1, 2), (2, 1)]
    assert rows(value_counts(df, ["v"], normalize=True)) == [(1, pytest.approx(2 / 3)), (2, pytest.approx(1 / 3))]
    assert distinct_count(df, "v").first()[0] == 2 and distinct_count(df, "v", exact=False).first()[0] == 2


def test_silver_quality(spark, rows):
    gold = spark.createDataFrame([("n", 0, 1, 1), ("n", 2, 3, 0), ("n", 4, 5, 1), ("n", 6, 7, 1)], SPAN)
    silver = spark.createDataFrame([("n", 0, 1, 0), ("n", 2, 3, 2), ("n", 4, 5, 1), ("n", 6, 8, 1)], SPAN)
    out = silver_quality(gold, silver).first()
    assert (out.n_false_positive, out.n_false_negative, out.n_positive, out.n_negative) == (1, 1, 2, 1)
    texts = spark.createDataFrame([("n", "t")], "note_id string, note_text string")
    assert rows(contradictions(gold, silver, texts), "text_start_char", "kind", "note_text") == [
        (0, "false negative", "t"),
        (2, "false positive", "t"),
    ]


def test_gold_examples(spark, rows):
    text = "vu le 01/02/2020 puis le 03/02/2020"
    texts = spark.createDataFrame([("n", text), ("m", text)], "note_id string, note_text string")
    dates = spark.createDataFrame([("n", "p", datetime(2020, 5, 1)), ("m", "q", datetime(2020, 5, 1))], "note_id string, person_id string, note_datetime timestamp")
    annotations = spark.createDataFrame(
        [
            ("n", "01/02/2020", 6, 16, True, None, ""),
            ("n", "03/02/2020", 25, 35, False, True, ""),
            ("n", "03/02/2020", 26, 36, False, False, "shifted"),
        ],
        "note_id string, lexical_variant string, offset_begin int, offset_end int, gold_label_value boolean, added_by_user boolean, remark string",
    )
    assert gold_labels(annotations).count() == 2
    out = gold_examples(annotations, texts, dates)
    assert rows(out, "set", "text_id", "note_id", "person_id", "label", "masked_span") == [
        ("test", 0, "n", "p", True, "vu le <mask> puis le 03/02/2020")
    ]
    with pytest.raises(ValueError):
        gold_examples(annotations, texts, dates.union(dates))


def test_gold_examples_cut_annotated_mentions_only(spark, rows, monkeypatch):
    import argentum.plans.quality as quality

    staged = []

    def noted(df, label):
        staged.append(stage(df, label))
        return staged[-1]

    monkeypatch.setattr(quality, "stage", noted)
    text = "vu le 01/02/2020 puis le 03/02/2020 et le 05/02/2020"
    texts = spark.createDataFrame([(n, text) for n in "nmo"] + [("null", None), (None, text)], "note_id string, note_text string")
    dates = spark.createDataFrame([(n, "p", datetime(2020, 5, 1)) for n in ["n", "m", "o", "null"]], "note_id string, person_id string, note_datetime timestamp")
    annotations = spark.createDataFrame(
        [(n, "", s, s and s + 10, True, False, "") for n, s in [("n", 25), ("n", 42), ("m", 26), ("m", None), ("null", 6), (None, 6), ("absent", 6), ("o", -30)]],
        "note_id string, lexical_variant string, offset_begin int, offset_end int, gold_label_value boolean, added_by_user boolean, remark string",
    )
    want = [("n", 0, 25, "vu le 01/02/2020 puis le <mask> et le 05/02/2020"), ("n", 1, 42, "vu le 01/02/2020 puis le 03/02/2020 et le <mask>")]
    columns = ["note_id", "text_id", "text_start_char", "masked_span"]
    assert rows(gold_examples(annotations, texts, dates), *columns) == want
    assert [found.count() for found in staged] == [2]
    # repeated texts multiply the examples without the check; with it they are found by all of their mentions
    both = texts.union(texts)
    assert [r[3] for r in rows(gold_examples(annotations, both, validate=False), *columns)] == [w[3] for w in want for _ in "12"]
    shifted = annotations.filter("note_id = 'm'")
    for broken in (lambda: gold_examples(shifted, both), lambda: gold_examples(shifted, texts, dates.union(dates)), lambda: gold_examples(annotations.union(annotations), texts, dates)):
        with pytest.raises(Exception, match="keys are not unique"):
            broken().collect()


def test_annotations_make_texts_after_spreading(spark):
    from driver_queries.inputs import Tables
    from driver_queries.quality import annotations

    plan = annotations(Tables(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan and "discuté" not in plan[plan.index("Repartition") :]


def test_report_strata(spark, rows):
    df = spark.createDataFrame([("1", "p"), ("2", "q")], "note_id string, person_id string")
    reports = spark.createDataFrame([("p",), ("p",)], "person_id string")
    assert rows(flag_reports(df, reports), "note_id", "has_bp_report") == [("1", True), ("2", False)]
    assert rows(report_strata(df, reports), "note_id", "set") == [("1", "test_with_bp"), ("2", "test_without_bp")]


def test_export(spark, rows):
    df = spark.createDataFrame(
        [(i, "ü", 0, 1, int(i > 6)) for i in range(10)], "text_id int, masked_span string, masked_span_start_char int, masked_span_end_char int, label int"
    )
    assert to_model_schema(df, label_col=None).columns == ["id", "text", "span_start", "span_end"]
    out = export_splits({"train": df, "val": df}, balance=1)
    assert {(r.set, r.label): r["count"] for r in out.groupBy("set", "label").count().collect()} == {
        ("train", 0): 3, ("train", 1): 3, ("val", 0): 7, ("val", 1): 3,
    }
    columns = {"text_col": "masked_span", "span_cols": ("masked_span_start_char", "masked_span_end_char")}
    both = csv_to_splits(df, 0.3, label_col="label", **columns)
    assert both.count() == 10 and {r.text for r in both.collect()} == {"u"}
    assert "set" not in csv_to_splits(df, label_col=None, **columns).columns


def test_annotation_tables(spark, rows):
    mentions = spark.createDataFrame([("n", 0, 10)], "note_id string, text_start_char int, text_end_char int")
    docs = spark.createDataFrame([("n", "a"), ("m", "b")], "note_id string, note_text string")
    entities, texts = annotation_tables(mentions, docs)
    assert rows(entities) == [("n", 0, 10, "Biopsie/Cytoponction", False, "pas de diagnostic", "biopsie")]
    assert rows(texts) == [("n", "a", "n")]


def test_columns(spark, rows):
    df = spark.createDataFrame([("2020-07-01", "ü"), ("x", "ö")], "d string, t string")
    assert rows(parse_or_drop(df, "d", "yyyy-MM-dd"), "d") == [(datetime(2020, 7, 1),)]
    assert rows(df.select(replace_missing_letters("t"))) == [("o",), ("u",)]
    assert rows(df.select(decode("d", {"x": "yes"}, "no"))) == [("no",), ("yes",)]
    local = to_zone(parse_or_drop(df, "d", "yyyy-MM-dd"), "Europe/Paris")
    assert rows(local, "d") == [(datetime(2020, 7, 1, 2),)]


def test_stage_and_hints(spark, rows, tmp_path):
    df = spark.range(5).withColumn("x", F.array(F.col("id")))
    assert rows(stage(df, "t")) == rows(df)
    hinted = lambda d: "hint" in d._jdf.queryExecution().logical().toString().lower()
    assert hinted(broadcast_if_small(df)) and not hinted(broadcast_if_small(df, max_rows=2))
    losses = spark.createDataFrame([(1, 0, 2.0)], "sample_id int, epoch int, loss double")
    moving = spark.createDataFrame([(1, 0.0)], "sample_id int, moving_loss double")
    path = write_loss_trace(losses, moving, str(tmp_path / "trace"))
    assert spark.read.parquet(f"{path}/loss_values").count() == 1
