"""Ordered rules: classification by the first condition that holds, and additive points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(rules: list[tuple[Column, str]], other: str) -> Column:
    """The name of the first rule that holds."""
    out = None
    for condition, name in rules:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out.otherwise(other) if out is not None else F.lit(other)


def points(indicators: list[tuple[Column, int]]) -> Column:
    """The points of all conditions that hold; a null condition gives none."""
    return sum((F.when(c, n).otherwise(0) for c, n in indicators), F.lit(0))


def within(time: Column, event: Column, horizon: float) -> Column:
    """1 for an event by the horizon, 0 for a row known to be free of it then, else null."""
    return F.when(event & (time <= horizon), 1).when(time >= horizon, 0)


def sign(x: Column) -> Column:
    """-1 below zero, else 1."""
    return F.when(x < 0, -1).otherwise(1)


def levels(x: Column, train_levels: list[str], prefix: str) -> list[Column]:
    """Indicator columns of the training levels but the first; a missing value is a level of its own, an unseen one has none."""
    known = F.coalesce(x.cast("string"), F.lit("missing"))
    return [F.when(known == level, 1).otherwise(0).alias(f"{prefix}_{level}") for level in sorted(train_levels)[1:]]
