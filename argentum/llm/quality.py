"""Quality rules kept as a ledger of failure bits.

Every rule is evaluated once per document. The ledger stores one bit per rule and the
measurements behind it; versioned policies are masks over the bits, so that a policy can
change, and its ablations be counted, without another look at a text. Only column
expressions are used, and nothing is shuffled but the ledger's distinct bit patterns.

Null and empty texts have no words; they fail `few_words` and nothing else. Rows are
independent: repeated rows give repeated rows, extra columns are carried along unless the
ledger writes a column of the same name, which it replaces.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argentum.llm.names import unused
from argentum.session import let

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"

#: Measurements of a document, in the order in which the ledger stores them.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


@dataclass(frozen=True)
class Rule:
    """`fails` is a condition over the measurements; `bit` never changes once it is in use."""

    bit: int
    name: str
    fails: Callable[[], Column]


RULES = (
    Rule(0, "few_words", lambda: F.col("n_words") < 50),
    Rule(1, "repeated_words", lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
    Rule(2, "symbols", lambda: 100 * F.col("n_symbols") > 10 * F.col("n_words")),
    Rule(3, "repeated_lines", lambda: (F.col("n_lines") >= 4) & (100 * F.col("n_dup_lines") > 50 * F.col("n_lines"))),
    Rule(4, "shouts", lambda: 100 * F.col("n_shouts") > 30 * F.col("n_words")),
    Rule(5, "word_length", lambda: (F.col("n_words") > 0) & ~F.col("word_chars").between(2 * F.col("n_words"), 20 * F.col("n_words"))),
    Rule(6, "very_long", lambda: F.col("n_words") > 1_000_000),
)


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of the named rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return mask_of(self.rules)


#: What the corpus contract demands of every policy.
BASE = Policy("base", 1, ("few_words", "repeated_words"))
DEFAULT = Policy("default", 1, ("few_words", "repeated_words", "symbols", "repeated_lines", "shouts", "word_length"))
POLICIES = (BASE, DEFAULT, Policy("default", 2, (*DEFAULT.rules, "very_long")))


def mask_of(names: Sequence[str]) -> int:
    """The bits of the named rules."""
    bits = {rule.name: 1 << rule.bit for rule in RULES}
    return sum(bits[name] for name in set(names))


def _flagged(hashes: Column) -> Column:
    """Sorted start positions of the windows whose hash occurs twice or more."""

    def neighbours(pairs: Column) -> Column:
        same = lambda pair, at: F.coalesce(F.get(pairs, at)["hash"] == pair["hash"], F.lit(False))
        twice = F.filter(pairs, lambda pair, at: same(pair, at - 1) | same(pair, at + 1))
        return F.sort_array(F.transform(twice, lambda pair: pair["at"]))

    pairs = F.sort_array(F.transform(hashes, lambda x, at: F.struct(x.alias("hash"), at.alias("at"))))
    return let(pairs, neighbours)


def _covered(starts: Column, width: int) -> Column:
    """Words inside the windows that begin at the sorted starts."""
    gaps = lambda at: F.transform(at, lambda x, i: F.when(i == 0, width).otherwise(F.least(F.lit(width), x - F.get(at, i - 1))))
    return F.aggregate(let(starts, gaps), F.lit(0), lambda total, x: total + x)


def repeated_words(words: Column, width: int = 3) -> Column:
    """Words inside `width`-word windows that a text holds twice or more.

    Windows are compared by a 64-bit hash; texts without a repeat, found by a hash set, are
    never sorted.
    """
    hashes = lambda w: F.slice(F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)])), 1, F.greatest(F.size(w) - (width - 1), F.lit(0)))
    count = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_covered(_flagged(h), width))
    return let(hashes(words), count)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the columns of `MEASURES` (long)."""
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda x: x != "")
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x: x.rlike(NOT_SPACE))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: x.rlike(r"^\P{Ll}*\p{Lu}\P{Ll}*[!?]+$"))).alias("n_shouts"),
        )

    of_lines = lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))
    symbols = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit("[#*$%&|<>]"))
    # one helper column, whatever the table's own columns are called
    helper = unused([*docs.columns, *MEASURES], "_measured")
    made = F.struct(let(words, of_words).alias("words"), let(lines, of_lines).alias("lines"), symbols.alias("n_symbols"))
    place = {"n_symbols": "n_symbols", "n_lines": "lines.n_lines", "n_dup_lines": "lines.n_dup_lines"}
    found = {name: F.col(f"{helper}.{place.get(name, f'words.{name}')}").cast("long") for name in MEASURES}
    return docs.withColumn(helper, made).withColumns(found).drop(helper)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """Documents with the measurements and `failed`, the bitmask (long) of the rules that each fails."""
    bits = [F.when(rule.fails(), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")) for rule in RULES]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask.bitwiseOR(bit)
    return measure(docs, text).withColumn("failed", mask)


def fails(policy: Policy) -> Column:
    """Whether the ledger row fails a rule of the policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def verdicts(ledger_rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Add base_failed and kept."""
    return ledger_rows.withColumns({"base_failed": fails(BASE), "kept": ~fails(BASE) & ~fails(policy)})


def keep(docs: DataFrame, policy: Policy = DEFAULT, text: str = "text") -> DataFrame:
    """The documents that pass the base rules and the policy, with their own columns only."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(text).alias("body"))
    return verdicts(ledger(rows, "body"), policy).where("kept").select("row.*")


def ablations(ledger_rows: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """Per rule of the policy: documents that fail it, fail it alone, and would be kept without it.

    The ledger is first counted by bit pattern (at most 2 ** rules rows, combined ahead of the
    shuffle); the rest reads those counts.
    """
    own = F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long"))
    patterns = ledger_rows.groupBy(own.alias("pattern")).count()
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in RULES if r.name in policy.rules]))
    rows = patterns.select("pattern", "count", each.alias("r")).select("pattern", "count", "r.*")
    hit, alone = F.col("pattern").bitwiseAND(F.col("bit")) != 0, F.col("pattern") == F.col("bit")
    of = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0))
    return rows.groupBy("rule").agg(of(hit).alias("n_failed"), of(alone).alias("n_alone"), (of(F.col("pattern") == 0) + of(alone)).alias("n_kept_without"))
