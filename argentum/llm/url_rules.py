"""URL filter: a list of host and path rules, and association rules mined from labelled URLs.

A URL is a set of tokens: host labels, path segments (runs of digits as one sign) and query
keys. Level-wise counts find the token sets that are frequent among labelled URLs together
with their label. A set that says its label with enough confidence, and more surely than any
part of it does, becomes a rule. Rules are matched by an inverted index: each stands under its
rarest token, and fires if a URL has its other tokens too. Listed rules go first.

Mining reads all labelled rows and drops no token and no rule: sets of one, two and then three
tokens (`MOST_TOKENS`, the form of a rule) are counted by shuffles, each level made from the sets
of the level before that a rule can still grow from. These are the sets that stand with one label
often enough (`PER_MILLE`), that have both labels, since a set that says its label surely has no
surer superset, and that stand in fewer rows than each of their parts, since others say what a
part says. The share of rows that a rule needs bounds the rules: a thousand times the sets of a
mean URL. Judging reads every token of every URL; models above `BROADCAST_ROWS` rules are joined.

Null URLs and those without `://` have an empty host and path and no token: no listed rule fits,
and the method's verdict is the default. Null keys have no label. A key with several labels is
blocked if one of them says so; repeated rows repeat. Without labels there are no mined rules.
Ties go to the larger support, then to the first token list in order. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.llm.words import map_blocks
from argentum.session import BROADCAST_ROWS, is_small, stage

# Listed rules of the corpus contract, (host and path, verdict).
LISTED = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

#: A rule's tokens stand with its label in so many labelled rows in a thousand, and in MIN_ROWS at least.
PER_MILLE = 1
MIN_ROWS = 5
#: Least share, in percent, of the labelled rows with a rule's tokens that have its label.
CONFIDENCE = 70
MOST_TOKENS = 3
#: Caps of the SQL beside the query, which mining has not.
PER_BASKET = 12
MOST_RULES = 20_000
DEFAULT = "allow"
VERDICTS = ("allow", "block")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    tokens: tuple[str, ...]
    verdict: str
    confidence: float
    support: int


def host_and_path(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query of a URL; empty without `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Distinct tokens: `h=` host labels, `p=` path segments, `q=` query keys."""

    def parts(text: Column, at: str, sign: str, make=lambda x: x) -> Column:
        found = F.filter(F.split(text, at, -1), lambda x: x != "")
        return F.transform(found, lambda x: F.concat(F.lit(sign), make(x)))

    segment = lambda x: F.regexp_replace(x, r"[0-9]+", "0")
    key = lambda x: F.regexp_extract(x, r"^[^=]*", 0)
    return F.array_distinct(F.concat(parts(host, r"\.", "h="), parts(path, "/", "p=", segment), parts(query, "&", "q=", key)))


def mined_rules(
    labelled: DataFrame,
    per_mille: int = PER_MILLE,
    min_rows: int = MIN_ROWS,
    confidence: int = CONFIDENCE,
    per_basket: int | None = None,
    most_tokens: int = MOST_TOKENS,
) -> DataFrame:
    """Rules (tokens, verdict, confidence, support) from rows of (`tokens` array<string>, `verdict` allow or block).

    With `per_basket`, only so many tokens of a URL count, its rarest frequent ones.
    """
    own = stage(labelled.where(F.size("tokens") > 0).select("tokens", "verdict"), "labelled")
    rows = max(min_rows, -(-own.count() * per_mille // 1000))
    token = own.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= rows)
    numbered = own.withColumn("at", F.monotonically_increasing_id())
    frequent = numbered.select("at", "verdict", F.explode("tokens").alias("token")).join(token, "token")
    found = F.array_sort(F.collect_list(F.struct("n", "token")))
    rarest = found if per_basket is None else F.slice(found, 1, per_basket)
    baskets = frequent.groupBy("at", "verdict").agg(F.array_sort(F.transform(rarest, lambda x: x["token"])).alias("basket"))
    baskets = baskets.groupBy("basket").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])
    baskets = stage(baskets.withColumn("at", F.monotonically_increasing_id()), "baskets")

    def says(verdict: str) -> Column:
        return (F.col(verdict) >= rows) & (100 * F.col(verdict) >= confidence * F.col("n"))

    def rules(sets: DataFrame, verdict: str) -> DataFrame:
        surer = F.col("sure")[verdict] > F.coalesce(F.col("parts")[verdict], F.lit(-1.0))
        return sets.where(says(verdict) & surer).select("items", F.lit(verdict).alias("verdict"), F.col("sure")[verdict].alias("confidence"), F.col(verdict).alias("support"))

    # where a set stands: the places of the first level, then of each level the sets that may grow
    places = baskets.select("at", *VERDICTS, F.explode("basket").alias("token")).select("at", *VERDICTS, F.array("token").alias("items"))
    out, known = [], None
    for size in range(1, most_tokens + 1):
        if known is not None:
            kept = places.join(known.select("items"), "items").select("at", *VERDICTS, F.slice("items", 1, size - 2).alias("start"), F.element_at("items", -1).alias("last"))
            other = kept.select("at", "start", F.col("last").alias("next"))
            pairs = kept.join(other, ["at", "start"]).where(F.col("last") < F.col("next"))
            places = pairs.select("at", *VERDICTS, F.concat("start", F.array("last", "next")).alias("items"))
        sets = places.groupBy("items").agg(*[F.sum(v).alias(v) for v in VERDICTS]).withColumn("n", reduce(Column.__add__, map(F.col, VERDICTS)))
        sets = sets.where(F.greatest(*VERDICTS) >= rows)
        nothing = F.struct(*[F.lit(None).cast("double").alias(v) for v in VERDICTS])
        sets = sets.withColumns({"parts": nothing, "least": F.lit(None).cast("long")})
        for gone in range(1, size + 1) if known is not None else ():
            part = known.select(F.col("items").alias("part"), F.col("n").alias("part_n"), "best")
            left = F.concat(F.slice("items", 1, gone - 1), F.slice("items", gone + 1, size))
            sets = sets.withColumn("part", left).join(part, "part")
            parts = F.struct(*[F.greatest(F.col("parts")[v], F.col("best")[v]).alias(v) for v in VERDICTS])
            sets = sets.withColumns({"parts": parts, "least": F.least("least", "part_n")}).drop("part", "part_n", "best")
        sure = F.struct(*[F.when(says(v), F.col(v) / F.col("n")).alias(v) for v in VERDICTS])
        sets = stage(sets.withColumn("sure", sure), "itemsets")
        out += [rules(sets, v) for v in VERDICTS]
        best = F.struct(*[F.greatest(F.col("parts")[v], F.col("sure")[v]).alias(v) for v in VERDICTS])
        known = sets.where((F.least(*VERDICTS) > 0) & (F.col("least").isNull() | (F.col("n") < F.col("least")))).withColumn("best", best)
    return reduce(DataFrame.unionAll, out).withColumnRenamed("items", "tokens")


def mine(labelled: DataFrame, **options: int | None) -> list[Rule]:
    """The rules of `mined_rules` as a list."""
    return [Rule(tuple(r["tokens"]), r["verdict"], r["confidence"], r["support"]) for r in mined_rules(labelled, **options).collect()]


class Index:
    """Listed rules by host, mined rules by their rarest token."""

    def __init__(self, listed: Sequence[tuple[str, str]], mined: Sequence[Rule]):
        self.hosts: dict[str, dict[str, str]] = {}
        for rule, verdict in listed:
            host, slash, path = rule.partition("/")
            self.hosts.setdefault(host, {})[slash + path] = verdict
        self.lengths = {host: sorted({len(p) for p in paths}, reverse=True) for host, paths in self.hosts.items()}
        # the order in which rules win
        self.mined = sorted(mined, key=lambda r: (-r.confidence, -r.support, r.tokens, r.verdict))
        spread: dict[str, int] = {}
        for rule in self.mined:
            for t in rule.tokens:
                spread[t] = spread.get(t, 0) + 1
        self.under: dict[str, list[int]] = {}
        for n, rule in enumerate(self.mined):
            self.under.setdefault(min(rule.tokens, key=lambda t: (spread[t], t)), []).append(n)

    def listed_rule(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest listed rule that fits; of equal lengths the longer host's."""
        found = None
        at = 0
        while True:
            name = host[at:]
            for size in self.lengths.get(name, ()):
                verdict = self.hosts[name].get(path[:size]) if len(path) >= size else None
                if verdict and (found is None or len(name) + size > len(found[0])):
                    found = name + path[:size], verdict
                if verdict:
                    break
            at = host.find(".", at) + 1
            if not at:
                return found

    def mined_rule(self, has: list[str]) -> Rule | None:
        """The first rule in order whose tokens are all there."""
        own = set(has)
        fired = [n for t in own for n in self.under.get(t, ()) if own.issuperset(self.mined[n].tokens)]
        return self.mined[min(fired)] if fired else None


def first_rules(rows: DataFrame, mined: DataFrame) -> DataFrame:
    """Rows of (`tokens`, ..) with `fires`, the mined rule that wins for these tokens, else null: as `Index.mined_rule`, by joins."""
    rule = mined.select(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.col("tokens").alias("t"), F.col("verdict").alias("v")).alias("rule"))
    each = rule.select("rule", F.explode("rule.t").alias("token"))
    spread = each.groupBy("token").agg(F.count("*").alias("spread"))
    under = each.join(spread, "token").groupBy("rule").agg(F.min(F.struct("spread", "token"))["token"].alias("token"))
    has = rows.select("tokens").distinct()
    fired = has.select("tokens", F.explode("tokens").alias("token")).join(under, "token").where(F.size(F.array_except("rule.t", "tokens")) == 0)
    first = fired.groupBy("tokens").agg(F.min("rule").alias("r"))
    fires = F.struct(F.col("r.t").alias("tokens"), F.col("r.v").alias("verdict"), (-F.col("r.c")).alias("confidence"), (-F.col("r.s")).alias("support"))
    return rows.join(first.select("tokens", fires.alias("fires")), "tokens", "left")


def judge(
    pages: DataFrame,
    listed: Sequence[tuple[str, str]] = LISTED,
    mined: Sequence[Rule] | DataFrame = (),
    key: str = "page_id",
    url: str = "url",
    max_broadcast: int = BROADCAST_ROWS,
) -> DataFrame:
    """Key, host, path, rule (the listed one, else null), verdict, mined_rule (tokens that fired, else null) and its confidence.

    Mined rules may be a table; one of more than `max_broadcast` rules is joined instead of sent to the tasks.
    """
    joined = isinstance(mined, DataFrame) and not is_small(mined, max_broadcast)
    if isinstance(mined, DataFrame) and not joined:
        mined = [Rule(tuple(r["tokens"]), r["verdict"], r["confidence"], r["support"]) for r in mined.collect()]
    index = pages.sparkSession.sparkContext.broadcast(Index(listed, () if joined else mined))
    kind = pages.schema[key].dataType.simpleString()
    host, path, query = host_and_path(F.col(url))
    parts = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"), query.alias("query"))
    rows = parts.select("key", "host", "path", tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"))
    if joined:
        rows = first_rules(rows, mined).select("key", "host", "path", "fires")

    def make(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks:
            rule, verdict, said, sure = [], [], [], []
            for h, p, has in zip(*(block.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                fits, fires = index.value.listed_rule(h, p), (has and Rule(**has)) if joined else index.value.mined_rule(has)
                rule.append(fits and fits[0])
                verdict.append(fits[1] if fits else fires.verdict if fires else DEFAULT)
                said.append(fires and " ".join(fires.tokens))
                sure.append(fires and fires.confidence)
            columns = [*block.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string()), pa.array(said, pa.string()), pa.array(sure, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "host", "path", "rule", "verdict", "mined_rule", "confidence"])

    schema = f"`{key}` {kind}, host string, path string, rule string, verdict string, mined_rule string, confidence double"
    return map_blocks(rows, make, schema, "path")


def labelled_urls(pages: DataFrame, labels: DataFrame, key: str = "page_id", label_key: str = "doc_id", url: str = "url") -> DataFrame:
    """Tokens and verdict of the pages that have a label: block if it says low quality or toxic."""
    bad = F.max((F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1))
    said = labels.where(F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("key")).agg(bad.alias("bad"))
    own = pages.select(F.col(key).alias("key"), *[c.alias(a) for c, a in zip(host_and_path(F.col(url)), ("host", "path", "query"), strict=True)])
    verdict = F.when(F.col("bad"), VERDICTS[1]).otherwise(VERDICTS[0])
    return own.join(said, "key").select(tokens(F.col("host"), F.col("path"), F.col("query")).alias("tokens"), verdict.alias("verdict"))
