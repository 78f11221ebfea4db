"""Names for helper columns that no input column has."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(columns: Iterable[str], stem: str) -> str:
    """``stem``, with underscores after it until no column's name begins so, in any case."""
    taken = [c.lower() for c in columns]
    while any(c.startswith(stem.lower()) for c in taken):
        stem += "_"
    return stem


def without(columns: Iterable[str], replaced: Iterable[str]) -> list[str]:
    """The columns but those whose names, in any case, are among ``replaced``."""
    gone = {c.lower() for c in replaced}
    return [c for c in columns if c.lower() not in gone]
