"""Column names that clash with none that is there."""

from __future__ import annotations


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it if a column of that name (in any case) is there."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name
