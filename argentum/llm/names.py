"""Names for helper columns beside columns of any name."""

from __future__ import annotations

from collections.abc import Iterable


def unused(columns: Iterable[str], name: str) -> str:
    """`name`, with underscores behind it until no column is called so (in any case of letters)."""
    taken = {x.lower() for x in columns}
    while name.lower() in taken:
        name += "_"
    return name
