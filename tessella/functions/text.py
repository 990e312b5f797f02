"""Column functions that clean identifiers and parse loosely written values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings that stand for a missing value.
MISSING = ("", "nan", "NA", "---")


def blank_to_null(x: Column) -> Column:
    """Null for the spellings of a missing value."""
    return F.when(F.trim(x).isin(*MISSING), None).otherwise(x)


def number(x: Column) -> Column:
    """A double, or null where the text is none."""
    return x.try_cast("double")


def without_suffix(x: Column) -> Column:
    """The text without a number after its last underscore."""
    return F.regexp_replace(x, "_[0-9]+$", "")


def bracketed(x: Column) -> Column:
    """What stands in the first square brackets, or else the text, trimmed."""
    return F.trim(F.coalesce(F.nullif(F.regexp_extract(x, r"\[([^\]]+)\]", 1), F.lit("")), x))


def normal_id(x: Column) -> Column:
    """Upper case without white space and brackets."""
    return F.upper(F.regexp_replace(x, r"[\s\[\]]", ""))


def first_number(x: Column) -> Column:
    """The first number without its leading zeros."""
    return F.regexp_replace(F.nullif(F.regexp_extract(x, "([0-9]+)", 1), F.lit("")), "^0+([0-9])", "$1")


def only_symbol(x: Column) -> Column:
    """The one distinct symbol of a list by ``///``, ``//``, ``;`` or ``,``; null where there are several or none."""
    parts = F.array_distinct(F.filter(F.transform(F.split(x, "///|//|;|,"), lambda p: F.trim(p)), lambda p: p != ""))
    return F.when((F.size(parts) == 1) & ~F.contains(parts[0], F.lit(" ")), parts[0])


def classify(x: Column, rules: list[tuple[str, str]], other: str) -> Column:
    """The name of the first rule whose pattern the lower-cased text holds."""
    low, out = F.lower(x), None
    for pattern, name in rules:
        found = low.rlike(pattern)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise(other)


def percent(x: Column) -> Column:
    """A percentage: ranges give their middle, fractions up to 1 without a sign are scaled, others must be from 0 to 100.

    A decimal comma is a point; ranges are written with a hyphen, an en dash or ``to``; a number below zero gives null.
    """
    plain = F.regexp_replace(F.regexp_replace(x, r"([0-9]),([0-9])", "$1.$2"), "\u2013", "-")
    numbers = F.regexp_extract_all(F.regexp_replace(F.lower(plain), r"([0-9%])\s*(?:-|to)\s*([0-9])", "$1 .. $2"), F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), 1)
    low, high = F.get(numbers, F.lit(0)).try_cast("double"), F.get(numbers, F.lit(1)).try_cast("double")
    value = F.when(high.isNotNull(), (low + high) / 2).otherwise(low)
    scaled = F.when((value <= 1) & ~F.contains(x, F.lit("%")), value * 100).otherwise(value)
    return F.when((scaled >= 0) & (scaled <= 100), scaled)


def last_number(x: Column) -> Column:
    """The last number without its leading zeros."""
    return F.regexp_replace(F.nullif(F.regexp_extract(x, "([0-9]+)[^0-9]*$", 1), F.lit("")), "^0+([0-9])", "$1")


def head(x: Column) -> Column:
    """The letters and digits that a text begins with, without leading zeros of its number."""
    return F.regexp_replace(F.nullif(F.regexp_extract(x, "^([A-Za-z]*[0-9]*)", 1), F.lit("")), "^([A-Za-z]*)0+([0-9])", "$1$2")


def identifier(x: Column) -> Column:
    """A struct of ``kind`` and ``id``: a stable id without its version, a symbol in upper case, or the text as it is."""
    stable = F.regexp_extract(x, r"^\s*(ENS[A-Z]*[GTP][0-9]+)(?:\.[0-9]+)?\s*$", 1)
    symbol = F.regexp_extract(x, r"^\s*([A-Za-z][A-Za-z0-9.-]*)\s*$", 1)
    return F.when(x.isNotNull(), F.when(stable != "", F.struct(F.lit("ensembl").alias("kind"), stable.alias("id"))).when(symbol != "", F.struct(F.lit("symbol").alias("kind"), F.upper(symbol).alias("id"))).otherwise(F.struct(F.lit("raw").alias("kind"), x.alias("id"))))


def time_and_event(x: Column) -> Column:
    """A struct of ``time`` and ``event`` from text like ``event: 1; time: 12.5``; null where either is missing."""
    at = F.regexp_extract(F.lower(x), r"time\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    happened = F.regexp_extract(F.lower(x), r"event\s*[:=]\s*([01])", 1).try_cast("int")
    return F.when(at.isNotNull() & happened.isNotNull(), F.struct(at.alias("time"), happened.alias("event")))


def is_placeholder(x: Column) -> Column:
    """Whether a symbol is a placeholder: it begins with LOC, ENS or CFA."""
    return x.rlike("^(?:LOC|ENS|CFA)")


def pairs(x: Column) -> Column:
    """A list ``id:value;id:value`` as a map of numbers; parts without an id or number are left out, the last of an id stays."""
    parts = F.transform(F.split(x, ";"), lambda p: F.struct(F.trim(F.split_part(p, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.split_part(p, F.lit(":"), F.lit(2))).try_cast("double").alias("v")))
    good = F.filter(parts, lambda p: (p["k"] != "") & p["v"].isNotNull())
    keys = F.array_distinct(F.transform(good, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(good, lambda p: p["k"] == k), -1)["v"])))


def first_filled(x: Column) -> Column:
    """The first of a list that isn't a spelling of a missing value."""
    return F.get(F.filter(x, lambda p: p.isNotNull() & ~F.trim(p).isin(*MISSING)), F.lit(0))


def largest_number(x: Column) -> Column:
    """The largest of a list that is a number."""
    return F.array_max(F.filter(F.transform(x, lambda p: p.try_cast("double")), lambda p: p.isNotNull() & ~F.isnan(p)))


def vital_endpoint(visits: Column, dead: str) -> tuple[Column, Column]:
    """``event`` and ``time`` of a list of visits (``vital``, ``days``): the first day of death, else the last day seen."""
    deaths = F.filter(visits, lambda v: v["vital"] == dead)
    event = F.when(F.size(visits) > 0, F.size(deaths) > 0)
    time = F.when(event, F.array_min(F.transform(deaths, lambda v: v["days"]))).otherwise(F.array_max(F.transform(visits, lambda v: v["days"])))
    return event.alias("event"), time.cast("long").alias("time")


def row_text(columns: list[Column], between: str = " | ") -> Column:
    """All columns as one text; a null is ``nan``."""
    return F.array_join(F.array(*[F.coalesce(c.cast("string"), F.lit("nan")) for c in columns]), between)


def yes_no(x: Column) -> Column:
    """1 or 0 for yes and no in their usual spellings, else null."""
    low = F.lower(F.trim(x))
    return F.when(low.isin("yes", "y", "true", "1"), 1).when(low.isin("no", "n", "false", "0"), 0)


def key_value(x: Column, key: str) -> Column:
    """The value after ``key:`` in a list by ``;``, split at its first colon."""
    return F.trim(F.nullif(F.regexp_extract(x, rf"(?:^|;)\s*{key}\s*:([^;]*)", 1), F.lit("")))


def snake(name: str) -> str:
    """A column name in lower case with single underscores."""
    import re

    return re.sub(r"[^0-9a-z]+", "_", name.strip().lower()).strip("_")


def p_text(p: Column) -> Column:
    """A p-value as text: below 0.001 in scientific form, else with three digits."""
    return F.when(p < 0.001, F.format_string("%.2e", p)).otherwise(F.format_string("%.3f", p))
