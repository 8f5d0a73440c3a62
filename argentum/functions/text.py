"""Dates, matched spans and coded strings in free text: patterns and native expressions.

Spark returns regex matches but not their positions. A text is therefore cut into the
matches and the gaps around them: `gap_0 match_0 gap_1 ... match_m-1 gap_m`; positions
are running sums of their lengths.

Tokens are whitespace-delimited pieces that keep their trailing whitespace; a date
mention is always one token of its own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from argentum.session import let

# fixed values: French month names with their usual abbreviations, in calendar order, as patterns
MONTHS = [
    r"janv(?:ier|\.)?",
    r"f[ée]v(?:rier|r\.?|\.)",
    r"mars",
    r"avr(?:il|\.)?",
    r"mai",
    r"juin",
    r"juil(?:let|\.)?",
    r"ao[uû]t",
    r"sept(?:embre|\.)",
    r"oct(?:obre|\.)?",
    r"nov(?:embre|\.)?",
    r"d[ée]c(?:embre|\.)?",
]
_MONTH = "(?:" + "|".join(MONTHS) + ")"
#: No word goes on here; engines differ in whether an accented letter is one of a word.
_END = r"(?![\wÀ-ɏ])"
_DAY = "(?:1er|[0-9]{1,2})"
#: Two digits are a year unless they count something.
_YEAR = r"(?:[0-9]{4}|[0-9]{2}(?![0-9/.,:%]|\s*(?:%|(?:h|heures?|ans?|mois|jours?|semaines?|mm|cm|mg|kg|g|ml)\b)))"

# fixed values: French numerals and what they stand for
NUMBER_WORDS = {
    "un": 1,
    "une": 1,
    "deux": 2,
    "trois": 3,
    "quatre": 4,
    "cinq": 5,
    "six": 6,
    "sept": 7,
    "huit": 8,
    "neuf": 9,
    "dix": 10,
    "onze": 11,
    "douze": 12,
    "treize": 13,
    "quatorze": 14,
    "quinze": 15,
    "seize": 16,
    "vingt": 20,
    "trente": 30,
    "quarante": 40,
    "cinquante": 50,
    "soixante": 60,
    "cent": 100,
    "mille": 1000,
}
# fixed values: French words for a day, without accents, and its distance from the day of the note
DAY_WORDS = {
    "avant-hier": -2,
    "hier": -1,
    "aujourd'hui": 0,
    "ce jour": 0,
    "demain": 1,
    "apres-demain": 2,
}
# fixed values: French days of the week, as the engine's functions know them
WEEKDAYS = {"lundi": "MO", "mardi": "TU", "mercredi": "WE", "jeudi": "TH", "vendredi": "FR", "samedi": "SA", "dimanche": "SU"}
_AMOUNT = "(?:[0-9]{1,3}|" + "|".join(sorted(NUMBER_WORDS, key=len, reverse=True)) + ")"
_UNIT = "(?:jours?|semaines?|mois|ans?|ann[ée]es?)"
_LAST_NEXT = "(?:derni(?:er|[èe]re)|pass[ée]e?|prochaine?)"

#: Ways to write a date. At one place at most one family fits longer than the others, and it
#: stands ahead of those that would fit a part of it: the joint pattern finds the longest.
DATE_FAMILIES = {
    "year_first": r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}",
    "numeric": r"[0-9]{1,2}[/.\-][0-9]{1,2}[/.\-](?:[0-9]{4}|[0-9]{2})",
    "written": rf"{_DAY}\s+{_MONTH}(?:\s+{_YEAR})?",
    "numeric_month": r"(?<![0-9/.\-])(?:0?[1-9]|1[0-2])[/\-](?:19|20)[0-9]{2}(?![/\-.][0-9])",
    "day_month": r"(?<![0-9/.,\-])(?:0?[1-9]|[12][0-9]|3[01])/(?:0[1-9]|1[0-2])(?![/\-]|[.,][0-9]|\s*(?:%|mm))",
    # the first day of a period, whose month stands with the last
    "day": rf"(?:(?<=\bdu\s)|(?<=\bentre\sle\s)){_DAY}(?=\s+(?:au|et\s+le)\s+(?:{_DAY}\s+{_MONTH}|[0-9]{{1,2}}/[0-9]{{1,2}}(?:/[0-9]{{2,4}})?){_END})",
    "written_month": rf"{_MONTH}\s+[0-9]{{4}}",
    "day_word": "(?:avant-hier|hier|aujourd['’]hui|ce jour|demain|apr[èe]s-demain)",
    "distance": rf"(?:il\s+y\s+a|depuis|dans)\s+(?:environ\s+)?{_AMOUNT}\s+{_UNIT}",
    "next_to_now": rf"(?:la\s+semaine|le\s+mois|l['’]ann[ée]e|l['’]an)\s+{_LAST_NEXT}",
    "weekday": rf"(?:{'|'.join(WEEKDAYS)})\s+(?:dernier|prochain)",
    "year": r"(?:en|depuis)\s+(?:19|20)[0-9]{2}(?![/.\-][0-9])",
}
#: What a date of each family begins with: lets the matcher skip most words at their first letter.
_LEADS = [
    ("0-9", ["year_first", "numeric", "written", "numeric_month", "day_month", "day"]),
    ("jfmasond", ["written_month"]),
    ("ahcdil", ["day_word", "distance", "next_to_now"]),
    ("lmjvsd", ["weekday"]),
    ("ed", ["year"]),
]


def _lead(letters: str) -> str:
    """Look-ahead for one of `letters` in either case, spelled out: a plain set is much cheaper than folding each character."""
    folded = ("ſ" if "s" in letters else "") + ("İı" if "i" in letters else "")
    return f"(?=(?-i:[{letters}{letters.upper() if letters.isalpha() else ''}{folded}]))"


DATE_PATTERN = (
    r"(?iu)"
    + _lead("jfmasondhcilve").replace("[", "[0-9")
    + r"\b(?:"
    + "|".join(_lead(letters) + "(?:" + "|".join(DATE_FAMILIES[f] for f in names) + ")" for letters, names in _LEADS)
    + ")"
    + _END
)
#: Whatever `DATE_PATTERN` matches has this in it.
DATE_HINT = r"(?iu)[0-9]|hier|aujourd|demain|ce jour|il\s+y\s+a|depuis|dans\s|derni|pass[ée]|prochain"
#: What stands between the two dates of a period, and ahead of the first.
BETWEEN_PATTERN = r"(?iu)^\s+(?:au|et\s+le)\s+$"
AHEAD_PATTERN = r"(?iu)\b(?:du|entre\s+le)\s+$"
#: Characters that the pattern ahead of a period looks at.
AHEAD = 12
#: Separator lines and the like, left out of normalised snippets.
POLLUTION_PATTERN = r"^[=_*#~\-]{4,}\s*$"
#: A neighbour token that makes a date part of a table of values.
NUMBER_PATTERN = (
    r"(?iu)^[+\-±~]?(?:\d+(?:[.,]\d+)*|\d+/\d+|(?:zéro|" + "|".join(NUMBER_WORDS) + r"|million|milliard)s?)\s*$"
)
TOKEN_PATTERN = r"\S+\s*"
# fixed values: French abbreviations that a full stop follows
ABBREVIATIONS = ("dr", "drs", "pr", "prs", "m", "mm", "mme", "mlle", "me", "st", "ste", "p", "pp", "cf", "ex", "env", "art", "fig", "tel", "tél", "av", "bd", "vol", "chap", "réf", "hab", "max", "min")
#: Punctuation at a token's end; a line of a list; what may stand ahead of an abbreviation.
STOP_PATTERN = r"[.!?…]+[\"»”’')\]]*$"
LIST_PATTERN = r"^(?:[-–—•*·]|[0-9]{1,2}[.)]|[a-z][.)])\s"
OPENING = "([{\"«“‘'"


def date_family(variant: Column) -> Column:
    """Name of the family that a mention belongs to."""
    name = F.lit(None).cast("string")
    for family, pattern in reversed(DATE_FAMILIES.items()):
        whole = "^[0-9]{1,2}$|^1er$" if family == "day" else rf"^(?:{pattern})$"
        name = F.when(variant.rlike("(?iu)" + whole), F.lit(family)).otherwise(name)
    return name


def month_number(text: Column) -> Column:
    """Number of the first French month name in `text`."""
    number = F.lit(None).cast("int")
    for i in range(len(MONTHS), 0, -1):
        number = F.when(text.rlike(rf"(?iu)\b{MONTHS[i - 1]}{_END}"), F.lit(i)).otherwise(number)
    return number


def _full_year(year: Column) -> Column:
    """Two digits are 1969 to 2068."""
    return F.when(F.length(year) == 2, F.concat(F.when(year >= "69", "19").otherwise("20"), year)).otherwise(year)


def _parse_rare(variant: Column, note_year: Column) -> Column:
    """Year-first, two-digit-year, yearless, dayless and written forms."""
    words = F.split(variant, r"\s+")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    day = F.regexp_extract(first, r"^\d{1,2}", 0)
    year = F.when(last.rlike(r"^(?:\d{4}|\d{2})$") & (F.size(words) > 1), _full_year(last)).otherwise(note_year)
    written = F.concat_ws(
        "/",
        year,
        month_number(variant).cast("string"),
        F.when(day == "", "1").otherwise(day),
    )
    parts = F.split(variant, r"[/.\-]")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    numbers = (
        F.when(variant.rlike(rf"^{DATE_FAMILIES['year_first']}$"), F.concat_ws("/", parts))
        .when(variant.rlike(rf"^{DATE_FAMILIES['numeric']}$"), F.concat_ws("/", _full_year(part(3)), part(2), part(1)))
        .when(variant.rlike(r"^\d{1,2}[/\-]\d{4}$"), F.concat(part(2), F.lit("/"), part(1), F.lit("/1")))
        .when(variant.rlike(r"^\d{1,2}/\d{1,2}$"), F.concat(note_year, F.lit("/"), part(2), F.lit("/"), part(1)))
        .when(year.isNotNull() & month_number(variant).isNotNull(), written)
    )
    return F.try_to_timestamp(numbers, F.lit("yyyy/M/d"))


_RELATIVE = "|".join(f"(?:{DATE_FAMILIES[name]})" for name in ("day_word", "distance", "next_to_now", "weekday", "year"))


def _parse_relative(variant: Column, note_day: Column) -> Column:
    """Days, weeks, months and years away from the note's day; a year alone is its first day."""
    text = F.translate(F.lower(variant), "éèê’", "eee'")
    amounts = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    said = F.regexp_extract(text, rf"^(?:il\s+y\s+a|depuis|dans)\s+(?:environ\s+)?({_AMOUNT})\s", 1)
    amount = F.coalesce(F.try_element_at(amounts, said), said.try_cast("int"), F.lit(1))
    amount = F.when(text.rlike(r"^dans\s|\sprochain"), amount).otherwise(-amount)
    unit = F.regexp_extract(text, r"[\s'](jour|semaine|mois|an)", 1)
    day = (
        F.when(unit == "jour", F.date_add(note_day, amount))
        .when(unit == "semaine", F.date_add(note_day, amount * 7))
        .when(unit == "mois", F.add_months(note_day, amount))
        .when(unit == "an", F.add_months(note_day, amount * 12))
    )
    for word, code in WEEKDAYS.items():
        ahead = F.next_day(note_day, code)
        back = F.date_sub(F.next_day(F.date_sub(note_day, 1), code), 7)
        day = F.when(text.rlike(rf"^{word}\s"), F.when(amount > 0, ahead).otherwise(back)).otherwise(day)
    for word, distance in DAY_WORDS.items():
        day = F.when(text == word, F.date_add(note_day, distance)).otherwise(day)
    year = F.regexp_extract(text, r"^(?:en|depuis)\s+(\d{4})$", 1)
    return F.when(year != "", F.make_date(year.try_cast("int"), F.lit(1), F.lit(1))).otherwise(day).cast("timestamp")


def _parse(variant: Column, noted: Column) -> Column:
    """Any form; for values that are bound, as it uses them often."""
    return (
        F.when(variant.rlike(_COMMON), parse_common(variant))
        .when(variant.rlike(rf"(?iu)^(?:{_RELATIVE})$"), _parse_relative(variant, F.to_date(noted)))
        .otherwise(_parse_rare(variant, F.year(noted).cast("string")))
    )


def _parse_start(s: Column) -> Column:
    """The first day of a period (`v`) with what it lacks from the last (`e`); see `parse_date`."""
    first, last = s["v"], s["e"]
    year = F.when(last.rlike(rf"^{DATE_FAMILIES['numeric']}$"), F.regexp_extract(last, r"[0-9]+$", 0)).otherwise(F.regexp_extract(last, r"\s([0-9]+)$", 1))
    lacks = F.when(first.rlike(r"(?iu)^(?:1er|[0-9]{1,2})$"), F.concat(first, F.regexp_extract(last, r"(?iu)^(?:1er|[0-9]{1,2})(.*)$", 1)))
    lacks = lacks.when(first.rlike(r"^[0-9]{1,2}/[0-9]{1,2}$") & (year != ""), F.concat(first, F.lit("/"), year))
    lacks = lacks.when(first.rlike(rf"(?iu)^{_DAY}\s+{_MONTH}$") & (year != ""), F.concat(first, F.lit(" "), year))

    def ordered(days: Column) -> Column:
        start, end = F.get(days, 0), F.get(days, 1)
        return F.when(start > end, F.add_months(F.to_date(start), -12).cast("timestamp")).otherwise(start)

    # one copy of the parser for both days; the last one only matters where the first was completed
    both = let(lacks, lambda text: F.array(F.coalesce(text, first), F.when(text.isNotNull(), last)))
    return let(F.transform(both, lambda text: _parse(text, s["n"])), ordered)


#: The form that most dates have.
_COMMON = r"^\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4}$"


def parse_common(variant: Column) -> Column:
    """A date of the common numeric form as timestamp."""
    return F.try_to_timestamp(F.translate(variant, ".-", "//"), F.lit("d/M/yyyy"))


def parse_date(variant: Column, note_datetime: Column | None = None, end_variant: Column | None = None) -> Column:
    """A mention as timestamp, null when it is no calendar date.

    Two-digit years count as 2000-2068 or 1969-1999. A missing day is the first of the
    month; a missing year is the year of the note, and null without one. Relative mentions count from
    the day of the note, and are null without one.

    With `end_variant` (null for most) the mention begins a period: a day alone has the month and year
    of the last day, a day and month its year; a start that would then lie after the end is of
    the year before.

    The common numeric form has a short path; the rest is bound as a lambda, which keeps the
    generated code of the row loop small enough to be compiled.
    """
    noted = F.lit(None).cast("timestamp") if note_datetime is None else note_datetime.cast("timestamp")
    last = F.lit(None).cast("string") if end_variant is None else end_variant
    rest = let(F.struct(variant.alias("v"), noted.alias("n"), last.alias("e")), _parse_start)
    return F.when(variant.rlike(_COMMON), parse_common(variant)).otherwise(rest)


def _cut(text: Column, pattern: str, body) -> Column:
    """Bind the matches of a pattern and the gaps around them, each evaluated once."""
    return let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: let(F.split(text, pattern, -1), lambda gaps: body(hits, gaps)),
    )


def _range(n: Column) -> Column:
    """0..n-1, empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _sums(sizes: Column) -> Column:
    """Sums up to and with each element; copies its array per element, so for short arrays."""
    add = lambda acc, n: F.concat(acc, F.array(F.coalesce(F.element_at(F.when(F.size(acc) > 0, acc), -1), F.lit(0)) + n))
    return F.aggregate(sizes, F.array().cast("array<int>"), add)


def _running(sizes: Column) -> Column:
    """Sums of the elements before each position, with the grand total last.

    In blocks of about the square root of the length, so that a long text isn't copied per match.
    """

    def of_blocks(width: Column) -> Column:
        blocks = F.transform(_range(F.ceil(F.size(sizes) / width).cast("int")), lambda b: _sums(F.slice(sizes, b * width + 1, width)))

        def shifted(parts: Column) -> Column:
            totals = F.concat(F.array(F.lit(0)), _sums(F.transform(parts, lambda x: F.element_at(x, -1))))
            return let(totals, lambda t: F.flatten(F.transform(parts, lambda x, b: F.transform(x, lambda v: v + F.get(t, b)))))

        return F.concat(F.array(F.lit(0)), let(blocks, shifted))

    return let(F.greatest(F.ceil(F.sqrt(F.size(sizes).cast("double"))).cast("int"), F.lit(1)), of_blocks)


def _item(values: Column, i: Column) -> Column:
    return F.element_at(values, i + 1)


def find_spans(text: Column, pattern: str) -> Column:
    """Array of (lexical_variant, text_start_char, text_end_char), 0-based half-open."""

    def spans(hits: Column, gaps: Column) -> Column:
        ends = _running(F.zip_with(gaps, hits, lambda g, h: F.coalesce(F.length(g), F.lit(0)) + F.coalesce(F.length(h), F.lit(0))))
        return let(
            ends,
            lambda e: F.transform(
                _range(F.size(hits)),
                lambda k: F.struct(
                    _item(hits, k).alias("lexical_variant"),
                    (_item(e, k + 1) - F.length(_item(hits, k))).alias("text_start_char"),
                    _item(e, k + 1).alias("text_end_char"),
                ),
            ),
        )

    return _cut(text, pattern, spans)


def _ends_sentence(token: Column, following: Column, abbreviations: tuple[str, ...]) -> Column:
    """Whether a sentence ends with a token (with its trailing white space); see `snippets.ends_sentence`."""
    body, space = F.regexp_extract(token, r"^\S*", 0), F.regexp_extract(token, r"\s*$", 0)
    lines = F.length(space) - F.length(F.replace(space, F.lit("\n"), F.lit("")))
    new_line = (lines > 1) | ((lines == 1) & (following.rlike(r"^(?:\p{Lu}|[^\p{L}\p{N}])") | following.rlike(LIST_PATTERN)))
    stop = F.regexp_extract(body, STOP_PATTERN, 0)
    word = F.regexp_extract(body, rf"^[{re.escape(OPENING)}]*(.*?)\.$", 1)
    short = word.rlike(r"^\p{L}$") | F.lower(word).isin(*abbreviations)
    full = stop.rlike("[!?…]") | (~short & ~following.rlike(r"^\p{Ll}"))
    return following.isNotNull() & (new_line | ((stop != "") & (space != "") & full))


def sentences(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Array of (sentence, start_char, end_char), 0-based half-open; trailing white space belongs to a sentence."""

    def of_tokens(tokens: Column) -> Column:
        ends = F.transform(tokens, lambda t, i: F.when(_ends_sentence(t, F.get(tokens, i + 1), abbreviations) | (i == F.size(tokens) - 1), i + 1))
        places = F.filter(ends, lambda e: e.isNotNull())

        def of_places(p: Column) -> Column:
            parts = F.transform(p, lambda e, i: F.array_join(F.slice(tokens, F.coalesce(F.get(p, i - 1), F.lit(0)) + 1, e - F.coalesce(F.get(p, i - 1), F.lit(0))), ""))
            return let(parts, lambda x: let(_running(F.transform(x, lambda v: F.length(v))), lambda n: F.transform(x, lambda v, i: F.struct(v.alias("sentence"), (lead + F.get(n, i)).alias("start_char"), (lead + F.get(n, i + 1)).alias("end_char")))))

        return let(places, of_places)

    lead = F.length(F.regexp_extract(text, r"^\s*", 0))
    return let(F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0)), of_tokens)


def _period(text: Column, span: Column, following: Column) -> Column:
    """The span with the one that ends its period, if it begins one."""
    start = span["text_start_char"]
    ahead = F.substring(text, F.greatest(start - AHEAD, F.lit(0)) + 1, F.least(start, F.lit(AHEAD)))
    gap = F.substring(text, span["text_end_char"] + 1, following["text_start_char"] - span["text_end_char"])
    paired = F.coalesce(ahead.rlike(AHEAD_PATTERN) & gap.rlike(BETWEEN_PATTERN), F.lit(False))
    return F.struct(
        *[span[c].alias(c) for c in ("lexical_variant", "text_start_char", "text_end_char")],
        *[F.when(paired, following[c]).alias(name) for name, c in PERIOD_FIELDS.items()],
    )


#: Fields of a mention that begins a period, and those of the mention that ends it.
PERIOD_FIELDS = {"end_variant": "lexical_variant", "end_start_char": "text_start_char", "end_end_char": "text_end_char"}


def find_dates(text: Column, pattern: str = DATE_PATTERN) -> Column:
    """As `find_spans`, with the end of the period that a date begins (nulls otherwise)."""
    return let(find_spans(text, pattern), lambda spans: F.transform(spans, lambda x, k: _period(text, x, F.get(spans, k + 1))))


# fixed values: (first character counted from 1, length) of the parts of a pathology code
CODE_PARTS = {
    "sampling_mode": (1, 1),
    "technic": (2, 1),
    "organ": (3, 2),
    "pathology": (5, 4),
    "pathology_type": (5, 2),
    "behaviour_type": (6, 1),
}
#: Four letters, then four letters or digits with at least one digit; dots may separate the parts.
CODE_PATTERN = r"\b[A-Z]\.?[A-Z]\.?[A-Z]{2}\.?[A-Z0-9][0-9][A-Z0-9]{2}\b"


def find_codes(text: Column, pattern: str = CODE_PATTERN) -> Column:
    """Coded strings of a text, separators removed."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.transform(found, lambda c: F.replace(c, F.lit("."), F.lit("")))
