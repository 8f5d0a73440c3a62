"""Steps that a user puts into a job: DataFrame -> DataFrame functions with column contracts.

A job calls its steps in a fixed order and checks what goes in and comes out: columns and types
when the plan is built, cardinality inside the plan. No check runs a job of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from argentum.operators.joins import attach, keep_keys
from argentum.plans.events import earliest_procedures
from argentum.plans.splits import of_classes, without_persons


class ContractError(ValueError):
    """A step got or gave a table without the columns of its contract."""


@dataclass(frozen=True)
class Step:
    """A function of a DataFrame (and fixed options) between two column contracts, written as DDL.

    A contract names columns that must be there; other columns are free. `keeps` demands that
    all columns of the input come out again, with their types.
    """

    name: str
    function: Callable[..., DataFrame]
    needs: str = ""
    gives: str = ""
    keeps: bool = False

    def __call__(self, df: DataFrame, **options: object) -> DataFrame:
        self._check("needs", self.needs, df)
        out = self.function(df, **options)
        if not isinstance(out, DataFrame):
            raise ContractError(f"step {self.name} gives {type(out).__name__}, not a DataFrame")
        self._check("gives", self.gives, out)
        if self.keeps:
            self._match("keeps", df.schema, out)
        return out

    def _check(self, side: str, ddl: str, df: DataFrame) -> None:
        if ddl:
            self._match(side, StructType.fromDDL(ddl), df)

    def _match(self, side: str, wanted: StructType, df: DataFrame) -> None:
        there = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        lacking = [f"{f.name} {f.dataType.simpleString()}" for f in wanted.fields if there.get(f.name) != f.dataType.simpleString()]
        if lacking:
            raise ContractError(f"step {self.name} {side} {', '.join(lacking)}; the table has {', '.join(f'{k} {v}' for k, v in there.items())}")


PROCEDURE = "visit_occurrence_id string, person_id string, procedure_start_datetime timestamp, procedure_source_value string"
CODES = "Code string"
ASSIGNED = "person_id string, set string"
MENTIONED = "note_id string, text_start_char int, text_end_char int, label int"


def code_reader(function: Callable[..., DataFrame], name: str = "read_codes") -> Step:
    """A step from a site's code table to the listed codes."""
    return Step(name, function, gives=CODES)


def visit_filter(function: Callable[..., DataFrame], name: str = "filter_by_visit") -> Step:
    """A step that drops procedures, by their visit or otherwise, and keeps all columns."""
    return Step(name, function, needs=PROCEDURE, keeps=True)


def negative_rule(function: Callable[..., DataFrame], name: str = "negatives") -> Step:
    """A rule for `plans.align.align(negatives=...)`: (distinct mentions, aligned, n, seed, scale) -> rows to add."""
    return Step(name, function, needs=MENTIONED, gives=MENTIONED, keeps=True)


def splitter(function: Callable[..., DataFrame], name: str = "splitter") -> Step:
    """A step from texts to one row (person_id, set) for each person that is to be in a named set."""
    return Step(name, function, needs="person_id string", gives=ASSIGNED)


def procedure_dates(
    procedures: DataFrame,
    code_table: DataFrame,
    read_codes: Step,
    filter_by_visit: Step | None = None,
    zone: str = "Europe/Paris",
    **options: object,
) -> DataFrame:
    """Earliest listed procedure per (visit, person): the job of `earliest_procedures` around two steps.

    `options` go to `filter_by_visit`. Rows of a code list that repeat a code count once.
    """
    codes = read_codes(code_table).select("Code").distinct()
    if filter_by_visit is not None:
        procedures = filter_by_visit(procedures, **options)
    return earliest_procedures(procedures, codes, zone=zone)


def visits_of(procedures: DataFrame, visits: DataFrame) -> DataFrame:
    """Procedures of the given visits, as a function for `visit_filter`."""
    return keep_keys(procedures, visits, ["visit_occurrence_id"])


def split_by(
    texts: DataFrame,
    assign: Step,
    rest: str = "train",
    note_classes: Sequence[str] | None = None,
    existing: list[DataFrame] | None = None,
    **options: object,
) -> DataFrame:
    """Texts with a `set` column, from a user's splitter.

    Note classes and persons of existing datasets are dropped ahead of the splitter, so that it can't
    see them. Persons that it leaves out are in `rest`; null persons always are. A person that it puts into two sets, or
    names twice, raises when the result is written: sets are disjoint by person.
    """
    texts = without_persons(of_classes(texts, None if note_classes is None else list(note_classes)), existing)
    bare = texts.drop("set")
    assigned = assign(bare, **options).select("person_id", "set")
    tagged = attach(bare, assigned, ["person_id"], how="left", validate="many_to_one")
    return tagged.select(F.coalesce("set", F.lit(rest)).alias("set"), *bare.columns)
