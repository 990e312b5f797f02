"""Column names that don't clash with those of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called like that in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(df: DataFrame) -> list[str]:
    """The names of all columns, as ``select`` takes them."""
    return [f"`{c.replace('`', '``')}`" for c in df.columns]
