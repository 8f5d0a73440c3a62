"""Ways to write dates and periods, normal forms of texts, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from argentum.functions.normal import Normal, source_offset
from argentum.functions.text import ABBREVIATIONS, find_dates, parse_date, sentences
from argentum.plans.mentions import extract_mentions, extract_periods, normalise_notes
from driver_queries.registry import query, with_

# fixed values: French months and their abbreviations
LONG = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
SHORT = ["janv.", "févr.", "mars", "avr.", "mai", "juin", "juil.", "août", "sept.", "oct.", "nov.", "déc."]


def _quoted(values: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in values)


def _pick(values: list[str], place: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), place.cast("int"))


def _month_sql(names: list[str], day: str = "d") -> str:
    return f"[{_quoted(names)}][month({day})]"


def _turn(values: list[str], days: list[str]):
    """One of the sayings, with its day, by the customer's number: a function, as the driver's columns need a session."""
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(days))
    return (
        lambda d: _pick(values, F.col("o_custkey") % len(values) + 1),
        f"[{_quoted(values)}][o_custkey % {len(values)} + 1]",
        f"CASE o_custkey % {len(values)} {cases} END",
    )


_FIRST = "date_trunc('month', d)"
_TEXT = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
#: What a note says by family: as a function of the day, as SQL, and the day that it means.
FORMS = {
    "year_first": (lambda d: F.date_format(d, "yyyy/MM/dd"), "strftime(d, '%Y/%m/%d')", "d"),
    "numeric_month": (lambda d: F.date_format(d, "MM/yyyy"), "strftime(d, '%m/%Y')", _FIRST),
    "day_month": (lambda d: F.date_format(d, "dd/MM"), "strftime(d, '%d/%m')", "d"),
    "written": (lambda d: _TEXT(F.dayofmonth(d), " ", _pick(SHORT, F.month(d)), " ", F.date_format(d, "yy")), f"day(d) || ' ' || {_month_sql(SHORT)} || ' ' || strftime(d, '%y')", "d"),
    "written_month": (lambda d: _TEXT(_pick(SHORT, F.month(d)), " ", F.year(d)), f"{_month_sql(SHORT)} || ' ' || year(d)", _FIRST),
    "distance": _turn(["dans 3 jours", "depuis deux ans", "il y a environ 2 semaines", "dans un mois"], ["d + 3", "d - INTERVAL 2 YEAR", "d - 14", "d + INTERVAL 1 MONTH"]),
    "next_to_now": _turn(["la semaine dernière", "l’an dernier", "le mois prochain", "l'année passée"], ["d - 7", "d - INTERVAL 1 YEAR", "d + INTERVAL 1 MONTH", "d - INTERVAL 1 YEAR"]),
    "weekday": _turn(["lundi dernier", "vendredi prochain"], ["d - ((isodow(d) + 5) % 7 + 1)::INTEGER", "d + ((11 - isodow(d)) % 7 + 1)::INTEGER"]),
}


def _said_notes(t, saying: Column):
    text = _TEXT("Patient ", F.col("o_custkey"), " vu ", saying, " en consultation.")
    return t["orders"].select(F.col("o_orderkey").cast("string").alias("note_id"), F.col("o_orderdate").cast("timestamp").alias("note_datetime"), text.alias("note_text"))


_SAID = "said AS (SELECT CAST(o_orderkey AS VARCHAR) AS note_id, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders)"


def _form_sql(said: str, day: str) -> str:
    return f"""WITH {_SAID}
SELECT note_id, {said} AS lexical_variant, CAST({day} AS TIMESTAMP) AS date_dt, CAST(length('Patient ' || o_custkey || ' vu ') AS INTEGER) AS text_start_char FROM said"""


def _register(family: str, saying, said: str, day: str) -> None:
    @query(f"mentions_form_{family}", _form_sql(said, day))
    def build(t):
        return extract_mentions(_said_notes(t, saying(F.col("o_orderdate"))), 2, 2).select("note_id", "lexical_variant", "date_dt", "text_start_char")


for _family, _form in FORMS.items():
    _register(_family, *_form)


@query("mentions_native_form", _form_sql(*FORMS["written"][1:]))
def mentions_native_form(t):
    """Array expressions alone, without the Arrow job."""
    notes = _said_notes(t, FORMS["written"][0](F.col("o_orderdate")))
    found = notes.select("note_id", "note_datetime", F.explode(find_dates(F.col("note_text"))).alias("m"))
    day = parse_date(F.col("m.lexical_variant"), F.col("note_datetime"), F.col("m.end_variant"))
    return found.select("note_id", "m.lexical_variant", day.alias("date_dt"), "m.text_start_char")


def _period() -> Column:
    """Ten days, of which the first lacks what stands in the last."""
    first, last, turn = F.col("o_orderdate"), F.date_add(F.col("o_orderdate").cast("date"), 9), F.col("o_custkey") % 3
    written = lambda d: _TEXT(F.dayofmonth(d), " ", _pick(LONG, F.month(d)))
    numeric = _TEXT("entre le ", F.date_format(first, "dd/MM"), " et le ", F.date_format(last, "dd/MM/yyyy"))
    day = _TEXT("du ", F.dayofmonth(first), " au ", written(last), " ", F.year(last))
    same = (turn == 1) & (F.month(first) == F.month(last))
    return F.when(turn == 0, numeric).when(same, day).otherwise(_TEXT("du ", written(first), " au ", written(last), " ", F.year(last)))


@query(
    "mentions_periods",
    f"""WITH d AS (SELECT CAST(o_orderkey AS VARCHAR) AS note_id, o_custkey, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + 9 AS e FROM orders),
s AS (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN strftime(d, '%d/%m') WHEN o_custkey % 3 = 1 AND month(d) = month(e) THEN CAST(day(d) AS VARCHAR)
    ELSE day(d) || ' ' || {_month_sql(LONG)} END AS a,
  CASE WHEN o_custkey % 3 = 0 THEN strftime(e, '%d/%m/%Y') ELSE day(e) || ' ' || {_month_sql(LONG, 'e')} || ' ' || year(e) END AS b,
  CASE WHEN o_custkey % 3 = 0 THEN 'entre le ' ELSE 'du ' END AS x, CASE WHEN o_custkey % 3 = 0 THEN ' et le ' ELSE ' au ' END AS y FROM d),
p AS (SELECT *, length('Patient ' || o_custkey || ' vu ' || x) AS begins FROM s)
SELECT note_id, a AS start_variant, CAST(d AS TIMESTAMP) AS start_dt, CAST(begins AS INTEGER) AS start_char, b AS end_variant, CAST(e AS TIMESTAMP) AS end_dt,
  CAST(begins + length(a || y || b) AS INTEGER) AS end_char FROM p""",
)
def mentions_periods(t):
    return extract_periods(_said_notes(t, _period()), keep=("note_id",))


#: All four switches over accents, ligatures, typographic quotes and a separator line.
ALL_NORMAL = Normal(lowercase=True, accents=True, quotes=True, pollution=True)
_HEAD, _MIDDLE, _TAIL = "Œdème “", "” ====== Vu l’Été, le ", ", cœur d’âge mûr."


def _accented_notes(t):
    d = F.col("o_orderdate")
    text = _TEXT(_HEAD, F.col("o_custkey"), _MIDDLE, F.dayofmonth(d), " ", F.upper(_pick(LONG, F.month(d))), " ", F.year(d), _TAIL)
    return t["orders"].select(F.col("o_orderkey").cast("string").alias("note_id"), text.alias("note_text"))


_ACCENTED = f"""{_SAID},
parts AS (SELECT note_id, d, '{_HEAD}' || o_custkey || '{_MIDDLE}' AS ahead, day(d) || ' ' || upper({_month_sql(LONG)}) || ' ' || year(d) AS v FROM said)"""


@query(
    "mentions_normal_form",
    with_(
        _ACCENTED,
        """SELECT note_id, v AS lexical_variant, CAST(d AS TIMESTAMP) AS date_dt, CAST(length(ahead) AS INTEGER) AS text_start_char, CAST(length(ahead || v) AS INTEGER) AS text_end_char,
  'vu l''ete, le ' || lower(strip_accents(v)) || ', coeur' AS span, 13 AS span_start_char, CAST(13 + length(v) AS INTEGER) AS span_end_char FROM parts""",
    ),
)
def mentions_normal_form(t):
    found = extract_mentions(_accented_notes(t), 3, 2, normal=ALL_NORMAL)
    return found.select("note_id", "lexical_variant", "date_dt", "text_start_char", "text_end_char", "span", "span_start_char", "span_end_char")


@query(
    "normal_form_offsets",
    with_(
        _ACCENTED,
        f"""SELECT note_id, lower(strip_accents(translate(replace(replace(ahead, '====== ', ''), 'Œ', 'oe'), '’“”', '''""'))) AS head,
  CAST(length(ahead) AS INTEGER) AS source_start, CAST(length(ahead) - 6 AS INTEGER) AS normal_start, CAST(length(ahead || v || '{_TAIL}') - 1 AS INTEGER) AS source_of_last FROM parts""",
    ),
)
def normal_form_offsets(t):
    """The way back from the normal form, by native expressions."""
    form = normalise_notes(_accented_notes(t), ALL_NORMAL)
    found = form.select("note_id", "normal_text", "breaks", F.get(find_dates(F.col("normal_text")), 0)["text_start_char"].alias("normal_start"))
    return found.select(
        "note_id",
        F.substring(F.col("normal_text"), F.lit(1), F.col("normal_start")).alias("head"),
        source_offset(F.col("breaks"), F.col("normal_start")).alias("source_start"),
        "normal_start",
        source_offset(F.col("breaks"), F.length("normal_text") - 1).alias("source_of_last"),
    )


@query("documents_normal_form", "SELECT doc_id, lower(strip_accents(replace(replace(text, 'œ', 'oe'), 'æ', 'ae'))) AS normal_text FROM documents")
def documents_normal_form(t):
    return normalise_notes(t["documents"], Normal(lowercase=True, accents=True, pollution=False), "text", ("doc_id",)).select("doc_id", "normal_text")


def _clinic_notes(t):
    """Stops that end no sentence, a line of a list, a wrapped line."""
    day = F.date_format("o_orderdate", "dd/MM/yyyy")
    text = _TEXT("Vu par le Dr. Martin (cf. p. 3).\n- revu avec M. X le ", day, ", suite\nprévue p. ", F.col("o_custkey"), " du dossier. \nFin de l'avis ! Merci.")
    return t["orders"].select(F.col("o_orderkey").cast("string").alias("note_id"), text.alias("note_text"))


@query(
    "mentions_sentence_abbreviations",
    """WITH n AS (SELECT CAST(o_orderkey AS VARCHAR) AS note_id, o_custkey, strftime(o_orderdate, '%d/%m/%Y') AS d FROM orders)
SELECT note_id, '- revu avec M. X le ' || d || ', suite' || chr(10) || 'prévue p. ' || o_custkey || ' du dossier.' AS span, 20 AS span_start_char, 30 AS span_end_char FROM n""",
)
def mentions_sentence_abbreviations(t):
    return extract_mentions(_clinic_notes(t), 0, 0, mode="sentence", attr="TEXT").select("note_id", "span", "span_start_char", "span_end_char")


@query(
    "sentences_of_documents",
    rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+\s*')) AS token, generate_subscripts(regexp_extract_all(text, '\S+\s*'), 1) AS i FROM documents),
n AS (SELECT *, lead(token) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM t),
p AS (SELECT *, regexp_extract(token, '^\S*') AS body, length(token) - length(replace(token, chr(10), '')) AS lines FROM n),
e AS (SELECT doc_id, i, token, following IS NULL OR lines > 1
  OR (lines = 1 AND regexp_matches(following, '^(\p{{Lu}}|[^\p{{L}}\p{{N}}]|[0-9]{{1,2}}[.)]\s|[a-z][.)]\s)'))
  OR (body <> token AND regexp_matches(body, '[!?…][.!?…]*["»”’'')\]]*$'))
  OR (body <> token AND regexp_matches(body, '\.["»”’'')\]]*$') AND (regexp_matches(body, '[!?…]\.+["»”’'')\]]*$') OR (NOT regexp_matches(following, '^\p{{Ll}}')
    AND NOT regexp_matches(body, '^[(\[{{"«“‘'']*\p{{L}}\.$') AND lower(regexp_extract(body, '^[(\[{{"«“‘'']*(.*?)\.$', 1)) NOT IN ({_quoted(list(ABBREVIATIONS))})))) AS ends FROM p),
s AS (SELECT doc_id, token, sum(ends::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) - ends::INTEGER AS k FROM e)
SELECT doc_id, CAST(k AS INTEGER) AS position, CAST(sum(length(token)) AS INTEGER) AS n_chars FROM s GROUP BY doc_id, k""",
)
def sentences_of_documents(t):
    found = t["documents"].select("doc_id", F.posexplode(sentences(F.col("text"))).alias("position", "s"))
    return found.select("doc_id", "position", F.length("s.sentence").alias("n_chars"))
