import random
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from argentum.functions.normal import Normal, normalise, source_offset, source_place
from argentum.functions.snippets import Options, ends_sentence, find_mentions
from argentum.functions.text import ABBREVIATIONS, DATE_FAMILIES, DATE_PATTERN, TOKEN_PATTERN, date_family, find_dates, find_spans, parse_date, sentences
from argentum.plans.align import count_mentions, mentioned_once
from argentum.plans import mentions as job
from argentum.plans.mentions import extract_mentions, extract_periods, normalise_notes

NOTED = datetime(2021, 5, 5)


def notes(spark, *texts):
    rows = [(str(i), f"p{i}", NOTED, text) for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "note_id string, person_id string, note_datetime timestamp, note_text string")


def test_formats(spark, rows):
    variants = {
        "12/03/2020": datetime(2020, 3, 12),
        "2.3.2020": datetime(2020, 3, 2),
        "2020-03-12": datetime(2020, 3, 12),
        "12-03-98": datetime(1998, 3, 12),
        "12/03/20": datetime(2020, 3, 12),
        "1er mars 2019": datetime(2019, 3, 1),
        "3 Août 2018": datetime(2018, 8, 3),
        "3 avril": datetime(2021, 4, 3),
        "décembre 2017": datetime(2017, 12, 1),
        "31/02/2020": None,
        "45/01/2020": None,
        "29 février 2019": None,
        "03/2019": datetime(2019, 3, 1),
        "13/2019": None,
        "2019/03/12": datetime(2019, 3, 12),
        "janv. 2019": datetime(2019, 1, 1),
        "12 sept. 98": datetime(1998, 9, 12),
        "12 mars 19": datetime(2019, 3, 12),
        "29/02": None,
        "12/03": datetime(2021, 3, 12),
        "Dans 3 jours": datetime(2021, 5, 8),
        "depuis 2 ans": datetime(2019, 5, 5),
        "la semaine dernière": datetime(2021, 4, 28),
        "l’an prochain": datetime(2022, 5, 5),
        "mercredi dernier": datetime(2021, 4, 28),
        "mercredi prochain": datetime(2021, 5, 12),
        "après-demain": datetime(2021, 5, 7),
        "ce jour": NOTED.replace(hour=0),
        "depuis 2019": datetime(2019, 1, 1),
    }
    df = spark.createDataFrame([(v,) for v in variants], "v string")
    parsed = {r.v: r.d for r in df.select("v", parse_date(F.col("v"), F.lit(NOTED)).alias("d")).collect()}
    assert parsed == variants
    assert rows(spark.createDataFrame([("3 avril",)], "v string").select(parse_date(F.col("v")))) == [(None,)]


def test_edges_and_neighbours(spark):
    df = notes(
        spark,
        "12/03/2020",
        "Score 5 12/03/2020 fin",
        "12/03/2020 7,5 mg",
        "le 12/03/2020 13/03/2020 là",
        "112/03/2020 et 12/03/20201",
        "",
        None,
        "5: 12/03/2020, 7 mg",
    )
    found = {(r.note_id, r.lexical_variant, r.date_dt is None) for r in extract_mentions(df, drop_na=False).collect()}
    assert found == {
        ("0", "12/03/2020", False),
        ("1", "12/03/2020", True),
        ("2", "12/03/2020", True),
        ("3", "12/03/2020", True),
        ("3", "13/03/2020", True),
        ("7", "12/03/2020", False),
    }
    kept = extract_mentions(df, drop_na=False, ignore_excluded=False)
    assert kept.filter("date_dt is null").count() == 0


def test_token_window(spark, rows):
    df = notes(spark, "a b  c\nd 12/03/2020. e f ====== g 9 01/01/2021 h")
    one = rows(extract_mentions(df, 2, 3), "span", "span_start_char", "span_end_char")
    # the excluded date and the separator are not in the window
    assert one == [("c\nd 12/03/2020. e f", 4, 14)]
    text = rows(extract_mentions(df, 1, 5, attr="text", ignore_excluded=False), "span")
    assert ("d 12/03/2020. e f ====== g",) in text
    assert rows(extract_mentions(df, 0, 0), "span", "span_start_char") == [("12/03/2020", 0)]
    with pytest.raises(ValueError):
        extract_mentions(df, mode="page")


def test_sentence_window(spark, rows):
    df = notes(spark, "Un. Deux trois. Vu le 12/03/2020 ici. Quatre!\nCinq. Six")
    pick = lambda b, a: rows(extract_mentions(df, b, a, mode="sentence"), "span")[0][0]
    assert pick(0, 0) == "Vu le 12/03/2020 ici."
    assert pick(1, 1) == "Deux trois. Vu le 12/03/2020 ici. Quatre!"
    assert pick(9, 9) == "Un. Deux trois. Vu le 12/03/2020 ici. Quatre!\nCinq. Six"


PIECES = st.lists(
    st.sampled_from(["12/03/2020", "1/1/99", "mars 2019", "mot", "5", "====", ".", " ", "\n", "  ", "été", "a.", "x!"]), max_size=40
)


@settings(max_examples=200, deadline=None)
@given(PIECES, st.integers(0, 6), st.integers(0, 6), st.booleans(), st.sampled_from(["NORM", "TEXT"]), st.sampled_from(["token", "sentence"]))
def test_offsets_hold_in_text_and_snippet(pieces, before, after, ignore, attr, mode):
    text = "".join(pieces)
    pattern = re.compile(DATE_PATTERN)
    found = list(find_mentions(text, pattern, Options(before, after, ignore, attr, mode)))
    assert [m.lexical_variant for m in found] == pattern.findall(text)
    for m in found:
        assert text[m.text_start_char : m.text_end_char] == m.lexical_variant
        assert m.span[m.span_start_char : m.span_end_char] == m.lexical_variant
        if attr == "TEXT" and not ignore:
            assert m.span in text
        if mode == "token" and before == after == 0:
            assert m.span == m.lexical_variant
        if attr == "TEXT" and not ignore and mode == "sentence" and before == after == 9:
            assert m.span == text.strip()


def test_large_windows_cover_the_text():
    text = "a b 12/03/2020 c d"
    m = next(find_mentions(text, re.compile(DATE_PATTERN), Options(99, 99, True, "NORM", "token")))
    assert m.span == text


def test_native_spans_match_the_arrow_job(spark, rows):
    df = notes(spark, "12/03/2020 a 1er mars 2019", "rien", "é 01/01/2020é 02/02/2020", None, "")
    native = df.select("note_id", F.explode_outer(find_spans(F.col("note_text"), DATE_PATTERN)).alias("m")).filter("m is not null")
    arrow = extract_mentions(df, drop_na=False)
    fields = ["lexical_variant", "text_start_char", "text_end_char"]
    assert rows(native, "note_id", *[f"m.{f}" for f in fields]) == rows(arrow, "note_id", *fields)


def test_result_does_not_depend_on_partitions(spark, rows):
    df = notes(spark, *[f"note {i} du {1 + i % 28:02d}/03/2020 et 5 01/01/2020" for i in range(40)])
    assert rows(extract_mentions(df.repartition(1))) == rows(extract_mentions(df.repartition(7)))


def test_counts(spark, rows):
    d = datetime(2020, 1, 1)
    df = spark.createDataFrame(
        [("n", d, 0), ("n", d, 9), ("n", datetime(2020, 1, 2), 20), ("m", d, 0), ("m", None, 5)],
        "note_id string, date_dt timestamp, text_start_char int",
    )
    assert rows(count_mentions(df), "note_id", "text_start_char", "count_date") == [
        ("m", 0, 1),
        ("m", 5, None),
        ("n", 0, 2),
        ("n", 20, 1),
        ("n", 9, 2),
    ]
    assert rows(mentioned_once(df), "note_id", "text_start_char") == [("m", 0), ("n", 20)]


def test_spans_of_a_text_with_many_hits(spark):
    import time

    n = 50_000
    df = spark.createDataFrame([("x1 " * n,)], "text string").cache()
    df.count()
    start = time.time()
    spans = df.select(find_spans(F.col("text"), "[0-9]+").alias("s")).first().s
    assert time.time() - start < 30
    assert len(spans) == n and all((s.text_start_char, s.text_end_char) == (3 * k + 1, 3 * k + 2) for k, s in enumerate(spans))


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Extraction from another folder, without the package on the workers' path."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
import __spark_entry__ as e
from argentum.session import get_session
spark = get_session("cwd", "local[2]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "2"}})
print("ROWS", e.queries()["mentions_offsets"](spark, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert int(done.stdout.split("ROWS")[1]) > 0, done.stderr[-2000:]


def test_families(spark):
    samples = {
        "year_first": "2019/03/12",
        "numeric": "12.03.19",
        "written": "1er févr. 19",
        "numeric_month": "3-2019",
        "day_month": "1/03",
        "day": "3",
        "written_month": "DÉC. 2019",
        "day_word": "aujourd’hui",
        "distance": "il y a environ trois mois",
        "next_to_now": "l'année passée",
        "weekday": "Lundi prochain",
        "year": "en 2019",
    }
    df = spark.createDataFrame([(v, k) for k, v in samples.items()] + [("rien", None)], "v string, name string")
    assert set(samples) == set(DATE_FAMILIES)
    assert df.filter(~date_family(F.col("v")).eqNullSafe(F.col("name"))).collect() == []


FORMS = st.lists(
    st.sampled_from(
        ["12/03/2020", "12/03", "03/2019", "2019-03-12", "2019/3/1", "12 mars 19", "1er", "3", "19", "mars", "janv.", "sept.", "sept", "2019", "avr", "du ", "entre le ", " au ", " et le ", "dans ", "depuis ", "il y a ", "deux", "jours", "ans", "hier"]
        + ["la semaine ", "l’an ", "dernière", "dernier", "lundi ", "en ", "h", "%", "mm", "été", "/", "-", ".", ",", " ", " ", " ", "\n", "x"]
    ),
    max_size=30,
)


@settings(max_examples=500, deadline=None)
@given(FORMS)
def test_joint_pattern_finds_the_longest_of_all_families(pieces):
    """At every place the longest match of any family, from left to right."""
    text = "".join(pieces)
    families = [re.compile(rf"(?iu)\b(?:{p})(?![\wÀ-ɏ])") for p in DATE_FAMILIES.values()]
    want, at = [], 0
    while at <= len(text):
        here = [m for m in (f.match(text, at) for f in families) if m]
        if here:
            want.append(max(m.end() for m in here))
            want[-1] = (at, want[-1])
            at = want[-1][1]
        else:
            at += 1
    assert [m.span() for m in re.finditer(DATE_PATTERN, text)] == want


def test_what_is_no_date():
    pattern = re.compile(DATE_PATTERN)
    for text in ["TA 12/8", "score 1/2", "12/10 mm", "10/12%", "0,12/03", "12/03/", "12/03.5", "112/03/2020", "45/2019/3", "12 mai 19 h", "2 mars 20%", "septembre", "sept cas", "mars", "marsouin 2019", "du 3 au service", "en 20190"]:
        found = [m.group() for m in pattern.finditer(text)]
        assert found == (["12 mai"] if "mai" in text else ["2 mars"] if "2 mars" in text else []), text


PERIODS = {
    "du 3 au 10 mars 2019": ("3", datetime(2019, 3, 3), "10 mars 2019", datetime(2019, 3, 10)),
    "Du 28 décembre au 3 janvier 2020": ("28 décembre", datetime(2019, 12, 28), "3 janvier 2020", datetime(2020, 1, 3)),
    "entre le 1er et le 5 avril": ("1er", datetime(2021, 4, 1), "5 avril", datetime(2021, 4, 5)),
    "du 28/12 au 03/01/20": ("28/12", datetime(2019, 12, 28), "03/01/20", datetime(2020, 1, 3)),
    "du 28 au 03/04/2020": ("28", datetime(2019, 4, 28), "03/04/2020", datetime(2020, 4, 3)),
    "du 12/03/2020 au 15/03/2020": ("12/03/2020", datetime(2020, 3, 12), "15/03/2020", datetime(2020, 3, 15)),
}


def test_periods(spark, rows):
    texts = [f"suivi {p} fin" for p in PERIODS] + ["le 3 mars 2019 au 10 mars 2019", "du 3 au service", None, "", "du 3 mars 2019 ou 10 mars 2019"]
    df = notes(spark, *texts)
    found = {r.note_id: (r.start_variant, r.start_dt, r.end_variant, r.end_dt) for r in extract_periods(df).collect()}
    assert found == {str(i): v for i, v in enumerate(PERIODS.values())}
    for r in extract_periods(df).collect():
        text = texts[int(r.note_id)]
        assert text[r.start_char :].startswith(r.start_variant) and text[: r.end_char].endswith(r.end_variant)
    # the days are mentions of their own
    assert rows(extract_mentions(df.filter("note_id = '0'")), "lexical_variant", "date_dt") == [("10 mars 2019", datetime(2019, 3, 10)), ("3", datetime(2019, 3, 3))]
    native = df.select("note_id", "note_datetime", F.explode_outer(find_dates(F.col("note_text"))).alias("m")).filter("m is not null")
    native = native.select("note_id", "m.lexical_variant", parse_date(F.col("m.lexical_variant"), F.col("note_datetime"), F.col("m.end_variant")).alias("date_dt"), "m.text_start_char")
    assert rows(native) == rows(extract_mentions(df, drop_na=False), "note_id", "lexical_variant", "date_dt", "text_start_char")


ALL = Normal(True, True, True, True)
LETTERS = st.text(st.sampled_from("aéE\u0301œŒæß’“» =-_\nx1İ日"), max_size=60)


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.booleans(), st.booleans(), st.booleans(), st.booleans())
def test_normal_form_leads_back(text, lowercase, accents, quotes, pollution):
    form, breaks = normalise(text, Normal(lowercase, accents, quotes, pollution))
    places = [source_place(breaks, i) for i in range(len(form))]
    assert places == sorted(places) and all(0 <= p < len(text) for p in places)
    for c, p in zip(form, places):
        assert c in normalise(text[p], Normal(lowercase, accents, quotes, False))[0]
    if not (lowercase or accents or quotes or pollution):
        assert form == text
    if accents:
        assert not set(form) & set("é\u0301œŒæ")
    if pollution:
        assert not re.search(r"(?<!\S)[=_*#~-]{4,}(?!\S)", text) or len(form) < len(text)


def test_normal_form_switches():
    text = "Été “sûr” ====== l’œuvre"
    assert normalise(text, Normal(pollution=False))[0] == text
    assert normalise(text, Normal())[0] == "Été “sûr” l’œuvre"
    assert normalise(text, Normal(True, False, False, False))[0] == "été “sûr” ====== l’œuvre"
    assert normalise(text, Normal(False, True, False, False))[0] == "Ete “sur” ====== l’oeuvre"
    assert normalise(text, Normal(False, False, True, False))[0] == "Été \"sûr\" ====== l'œuvre"


def test_mentions_of_a_normal_form(spark, rows):
    text = "Cœur e\u0301tudie\u0301 ===== le 3 FE\u0301VRIER 2019, aujourd’hui"
    df = notes(spark, text, "", None)
    found = extract_mentions(df, 1, 1, normal=ALL)
    for r in found.collect():
        assert text[r.text_start_char : r.text_end_char] == r.lexical_variant
    got = rows(found, "lexical_variant", "date_dt", "span")
    assert got == [("3 FE\u0301VRIER 2019", datetime(2019, 2, 3), "le 3 fevrier 2019,"), ("aujourd’hui", datetime(2021, 5, 5), ", aujourd'hui")]
    assert rows(extract_mentions(df, 1, 1), "lexical_variant") == [("aujourd’hui",)]
    form = normalise_notes(df, ALL, keep=("note_id", "person_id"))
    back = form.select("note_id", F.length("normal_text"), source_offset(F.col("breaks"), F.length("normal_text") - 1))
    assert rows(back) == [("0", len(normalise(text, ALL)[0]), len(text) - 1), ("1", 0, None), ("2", None, None)]


TOKENS = ["Dr.", "M.", "X.", "(cf.", "fin.", "fin.)", "non!", "quoi?»", "p.", "3", "Suite", "suite", "-", "1.", "2)", "a)", "É.", "…", "à"]


def test_native_sentences_match_the_helper(spark):
    rng = random.Random(8)
    texts = [[(rng.choice(TOKENS), rng.choice([" ", " ", "\n", " \n", "\n\n", "  "])) for _ in range(rng.randrange(25))] for _ in range(300)]
    joined = ["".join(t + s for t, s in pairs) for pairs in texts] + ["", "  Un. Deux", "\n", "fin.  "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(joined)] + [(-1, None)], "i int, text string")
    got = {r.i: [tuple(s) for s in r.s] for r in df.filter("i >= 0").select("i", sentences(F.col("text")).alias("s")).collect()}
    for i, text in enumerate(joined):
        lead = len(text) - len(text.lstrip())
        tokens, parts = re.findall(TOKEN_PATTERN, text), [""]
        for token, following in zip(tokens, [*tokens[1:], None]):
            parts[-1] += token
            if ends_sentence(token, following, ABBREVIATIONS):
                parts.append("")
        want, at = [], lead
        for part in parts:
            want.append((part, at, at + len(part)))
            at += len(part)
        assert got[i] == (want if tokens else []), text


def test_sentences_and_abbreviations(spark, rows):
    df = notes(spark, "Vu par le Dr. A. Martin, cf. p. 3 le 12/03/2020. suite ici. Fin\nde ligne. Autre\n- liste")
    pick = lambda **o: rows(extract_mentions(df, 0, 0, mode="sentence", attr="TEXT", **o), "span")[0][0]
    assert pick() == "Vu par le Dr. A. Martin, cf. p. 3 le 12/03/2020. suite ici."
    assert pick(abbreviations=()).startswith("A. Martin") or "Dr." not in pick(abbreviations=())


def test_dates_counted_inside_a_note_take_no_shuffle(spark, rows, monkeypatch):
    texts = ["le 12/03/2020 puis 12 mars 2020, et 13/03/2020 ; 3 14/03/2020 ; 31/02/2020", "15/03/2020", "hier, 04/05/2021 et demain", "rien 7", None, "16/03/2020 " * 3 + "a 17/03/2020"]
    df = notes(spark, *texts)
    once = extract_mentions(df, once=True)
    assert "Exchange" not in once._jdf.queryExecution().executedPlan().toString()
    columns = ["note_id", "text_start_char", "date_dt", "span", "count_date"]
    want = rows(mentioned_once(extract_mentions(df)), *columns)
    assert rows(once, *columns) == want and len(want) == 4
    # a note whose snippets fill several batches
    monkeypatch.setattr(job, "BATCH_CHARS", 30)
    assert rows(extract_mentions(df, once=True), *columns) == want


PIECES = ["12/03/2020", "12.3.2020", "12 mars 2020", "du 3 au 10 mars 2019", "3", "2,5", "hier", "31/02/2020", "03/2019", "1/4/2021", "vu", "=====", "\n", "M."]


def test_dates_without_snippets_are_the_same(spark, rows):
    pick = random.Random(5)
    df = notes(spark, *[" ".join(pick.choice(PIECES) for _ in range(pick.randint(0, 25))) for _ in range(300)])
    columns = ["note_id", "person_id", "lexical_variant", "date_dt", "text_start_char", "text_end_char"]
    for options in ({}, {"ignore_excluded": False}, {"drop_na": False}, {"once": True}, {"once": True, "tz": "Europe/Paris"}):
        narrow = extract_mentions(df, snippets=False, **options)
        assert [c for c in narrow.columns if c != "count_date"] == columns
        assert rows(narrow, *columns) == rows(extract_mentions(df, **options), *columns)


def test_dates_counted_by_their_numbers_equal_counts_of_days(spark, rows):
    pick = random.Random(6)
    common = ["12/03/2020", "12.3.2020", "12-03-2020", "31/02/2020", "31/2/2020", "1/4/2021", "01/04/2021", "3", "vu", "5/13/2020"]
    df = notes(spark, *[" ".join(pick.choice(common) for _ in range(pick.randint(1, 8))) for _ in range(300)])
    columns = ["note_id", "text_start_char", "date_dt", "span"]
    assert rows(extract_mentions(df, once=True), *columns) == rows(mentioned_once(extract_mentions(df)), *columns)
    assert job._alone([("a",) * 3 + (False,) + (None,) * 3 + ("12 mars 2020",)], True) is None


@pytest.mark.parametrize("once", [False, True])
def test_texts_are_made_once_and_after_spreading(spark, once):
    notes = spark.range(6).repartition(3).select(F.col("id").alias("note_id"), F.concat(F.lit("marker du "), F.date_format(F.timestamp_seconds(F.col("id") * 86400), "dd/MM/yyyy")).alias("note_text"))
    more = notes.unionAll(spark.createDataFrame([(6, None), (7, "sans date")], "note_id long, note_text string"))
    found = extract_mentions(more, once=once)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("marker du ") == 1
    assert sorted(r["note_id"] for r in found.collect()) == list(range(6))


def test_wanted_mentions_are_those_of_all(spark, rows):
    pick = random.Random(7)
    df = notes(spark, *[" ".join(pick.choice(PIECES) for _ in range(pick.randint(0, 25))) for _ in range(200)])
    number = F.crc32(F.concat_ws("-", "note_id", "text_start_char")) % 3
    for options in ({}, {"drop_na": False, "ignore_excluded": False}, {"snippets": False}, {"mode": "sentence", "n_before": 1, "n_after": 1}, {"normal": Normal(True, True, True, True)}):
        every = extract_mentions(df, **options)
        some = every.filter(number == 0).cache()
        spans = some.select("note_id", F.struct(F.col("text_start_char").alias("start"), F.col("text_end_char").alias("end")).alias("x"))
        # offsets where no mention is, and pairs that lack one
        other = F.expr("array(struct(0, 3), struct(-9, 1), struct(99999, 100009), struct(cast(null as int), 10), cast(null as struct<col1: int, col2: int>))")
        places = spans.groupBy("note_id").agg(F.concat(F.collect_list("x"), other.cast("array<struct<start: int, end: int>>")).alias("places"))
        got = extract_mentions(df.join(places, "note_id", "left"), only="places", **options)
        assert got.columns == every.columns
        assert 0 < some.count() < every.count() and rows(got) == rows(some)
    with pytest.raises(ValueError):
        extract_mentions(df, once=True, only="places")
