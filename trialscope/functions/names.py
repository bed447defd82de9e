"""Names of inner columns that clash with none of a caller's."""

from __future__ import annotations

from collections.abc import Iterable


def fresh(name: str, columns: Iterable[str]) -> str:
    """The name, with as many underscores after it as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
