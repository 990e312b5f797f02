"""Ranks, quantile bins and multiplicity control.

Groups of at most ``GROUP`` rows, which one count tells, are ranked by a window each. Beyond that ranks come from counts by
distinct value: values are dealt into ranges of about equal size, running sums inside each range are added to the counts of
the ranges before it. So no window holds more than ``GROUP`` rows, a range, or one row a range, and both ways give the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.cuts import cut

#: Ranges of a whole-table ranking; a range holds about that share of the distinct values.
RANGES = 64
#: Rows of a group up to which a window holds it.
GROUP = 1 << 17


def bounded(df: DataFrame, by: list[str]) -> bool:
    """Whether no group has more than ``GROUP`` rows."""
    most = df.groupBy(*by).agg(F.count("*").alias("__n")).agg(F.max("__n")).first()[0] if by else df.count()
    return (most or 0) <= GROUP


def bucket(value: Column, bounds: list[float]) -> Column:
    """The number of bounds below a value, by halving nested conditions."""

    def halve(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(bounds[mid]), halve(lo, mid)).otherwise(halve(mid + 1, hi))

    return halve(0, len(bounds))


def range_bounds(df: DataFrame, order: str, ranges: int = RANGES, by: list[str] | None = None) -> list[float]:
    """Approximate quantiles of a column, which cut it into about ``ranges`` ranges of equal sizes; none where a window can hold each group."""
    if bounded(df, by or []):
        return []
    values = df.select(F.col(order).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    return sorted(set(values.approxQuantile("v", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) or []))


def running(df: DataFrame, by: list[str], order: str, amount: str, out: str, ranges: int = RANGES, pick=None, bounds: list[float] | None = None) -> DataFrame:
    """``df`` with the sum of ``amount`` over rows before each in ascending ``order``; ``order`` is distinct within ``by``.

    The order is cut at approximate quantiles of all rows, so that no window spans the table or a frequent ``by``: sums
    inside a range are added to those of the ranges before it. With ``pick`` (``F.min`` or ``F.max``) the extreme of the
    row and all after it is given instead. ``bounds`` of ranges that are known already save a job.
    """
    back = pick is not None
    how = pick or F.sum
    if bounds is None:
        df = cut(df)
        bounds = range_bounds(df, order, ranges, by)
    if not bounds:
        whole = Window.partitionBy(*by).orderBy(F.desc(order) if back else F.asc(order)).rowsBetween(Window.unboundedPreceding, 0 if back else -1)
        found = how(amount).over(whole)
        return df.withColumn(out, found if back else F.coalesce(found, F.lit(0)))
    dealt = df.withColumn("__range", bucket(F.col(order).cast("double"), bounds))
    place = lambda c: F.desc(c) if back else F.asc(c)
    window = lambda keys, c, last: Window.partitionBy(*keys).orderBy(place(c)).rowsBetween(Window.unboundedPreceding, last)
    of = [f"__of{i}" for i in range(len(by))]
    sums = dealt.groupBy(*[F.col(c).alias(o) for c, o in zip(by, of, strict=True)], F.col("__range").alias("__at")).agg(how(amount).alias("__sum"))
    sums = sums.withColumn("__start", how("__sum").over(window(of, "__at", -1))).drop("__sum")  # a row a range and key
    inside = dealt.withColumn("__inside", how(amount).over(window([*by, "__range"], order, 0 if back else -1)))
    same = F.col("__range") == F.col("__at")
    for c, o in zip(by, of, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(o))
    joined = inside.join(sums if by else F.broadcast(sums), same)  # a row a range, at most RANGES
    value = F.least("__start", "__inside") if pick is F.min else F.greatest("__start", "__inside") if back else F.coalesce("__start", F.lit(0)) + F.coalesce("__inside", F.lit(0))
    return joined.withColumn(out, value).drop("__range", "__at", "__start", "__inside", *of)


def exact_quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles by group, a column for each of ``at``, from counts by distinct value: nothing is buffered whole.

    Nulls don't count; a group of nulls alone has no row.
    """
    if bounded(df, by):
        whole = Window.partitionBy(*by)
        placed = df.where(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(whole.orderBy(value)) - 1).alias("below"), F.count("*").over(whole).alias("__total"), F.lit(1).alias("n"))
        return _at_places(placed, by, value, at)
    placed = value_ranks(df, by, value)
    sizes = placed.groupBy(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]).agg(F.sum("n").alias("__total"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return _at_places(placed.join(sizes, same) if by else placed.crossJoin(F.broadcast(sizes)), by, value, at)  # one row


def _at_places(joined: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Quantiles from values with the rows below them, their own, and those of the group."""
    v, found = F.col(value).cast("double"), []
    for q in at.values():
        place = F.lit(float(q)) * (F.col("__total") - 1)
        holds = lambda p: F.max(F.when((F.col("below") <= p) & (p < F.col("below") + F.col("n")), v))
        low, high = holds(F.floor(place)), holds(F.ceil(place))
        share = F.max(place - F.floor(place))
        found.append(F.when(share > 0, low + (high - low) * share).otherwise(low))
    return joined.groupBy(*by).agg(*[f.alias(name) for name, f in zip(at, found, strict=True)])


def value_counts(df: DataFrame, by: list[str], value: str) -> tuple[DataFrame, list[float]]:
    """Rows by distinct value, written once, and the bounds of ranges of them."""
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")))
    return counts, range_bounds(counts, value, by=by)


def value_ranks(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """A row for each distinct value: ``n`` rows, ``below`` rows with smaller values, and ``avg_rank`` of its rows."""
    counts, bounds = value_counts(df, by, value)
    ranked = running(counts, by, value, "n", "below", bounds=bounds)
    return ranked.withColumn("avg_rank", F.col("below") + (F.col("n") + 1) / 2)


def average_rank(df: DataFrame, by: list[str], value: str, out: str = "avg_rank") -> DataFrame:
    """``df`` with average ranks, ties shared; rows without a value get none.

    Rows of large groups meet their ranks by value, so a value must come out the same whenever it is worked out: a stored one, or
    one cut.
    """
    if bounded(df, by):
        return df.withColumn(out, window_rank(by, value))
    ranks = value_ranks(df, by, value)
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] + [F.col(f"l.{value}") == F.col(f"r.{value}")]
    condition = keys[0]
    for k in keys[1:]:
        condition = condition & k
    return df.alias("l").join(ranks.alias("r"), condition, "left").select("l.*", F.col("r.avg_rank").alias(out))


def window_rank(by: list[str], value: str) -> Column:
    """The average rank of a value within its group, by windows over groups of a bounded size."""
    known = F.when(F.col(value).isNotNull(), F.col(value))
    ties = Window.partitionBy(*by, value)
    return F.when(known.isNotNull(), F.rank().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last(value))) + (F.count("*").over(ties) - 1) / 2)


def bh_adjust(df: DataFrame, p: str, by: list[str] | None = None, out: str = "q_value", id_column: str | None = None) -> DataFrame:
    """Benjamini-Hochberg q-values within families; rows without p get none and don't count.

    Rows with one p have one q, from the last of their places, so q-values follow from counts by distinct p and a running
    minimum over ranges of them. ``id_column`` is kept for callers; ties need no order.
    """
    by = by or []
    df = cut(df)  # a p-value summed anew may differ in its last bit, and its rows meet by it
    some = df.where(F.col(p).isNotNull() & ~F.isnan(p))
    if bounded(some, by):
        has = F.col(p).isNotNull() & ~F.isnan(p)
        own, whole = F.when(has, F.col(p)), Window.partitionBy(*by)
        place = F.count(own).over(whole.orderBy(F.asc_nulls_last("__p")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        raw = df.withColumn("__p", own).withColumn("__raw", F.col("__p") * F.count("__p").over(whole) / place)
        lowest = F.min("__raw").over(whole.orderBy(F.desc_nulls_last("__p")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return raw.withColumn(out, F.when(F.col("__p").isNotNull(), F.least(F.lit(1.0), lowest))).drop("__p", "__raw")
    counts, bounds = value_counts(some, by, p)
    counts = running(counts, by, p, "n", "below", bounds=bounds)
    totals = counts.groupBy(*[F.col(c).alias(f"__of{i}") for i, c in enumerate(by)]).agg(F.sum("n").alias("__n"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__of{i}"))
    scaled = counts.join(totals, same) if by else counts.crossJoin(F.broadcast(totals))  # one row
    scaled = scaled.select(*by, p, (F.col(p) * F.col("__n") / (F.col("below") + F.col("n"))).alias("__raw"))
    lowest = running(scaled, by, p, "__raw", "__q", pick=F.min, bounds=bounds)
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] + [F.col(f"l.{p}") == F.col(f"r.{p}")]
    condition = keys[0]
    for k in keys[1:]:
        condition = condition & k
    return df.alias("l").join(lowest.alias("r"), condition, "left").select("l.*", F.when(F.col("r.__q").isNotNull(), F.least(F.lit(1.0), F.col("r.__q"))).alias(out))


def quantile_bounds(df: DataFrame, value: str, bins: int) -> list[float]:
    """Linear-interpolated inner quantiles of a column, duplicates dropped."""
    at = {f"q{i}": i / bins for i in range(1, bins)}
    row = exact_quantiles(df, [], value, at).first()
    return sorted({x for x in row if x is not None}) if row else []


def qcut(df: DataFrame, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Right-closed quantile bins from 0; equal bounds are merged, so there may be fewer bins."""
    bounds = quantile_bounds(df, value, bins)
    low = df.agg(F.min(value)).first()[0]
    bounds = [b for b in bounds if low is None or b > low] if bounds and low is not None and low in bounds else bounds
    return df.withColumn(out, F.when(F.col(value).isNotNull(), bucket(F.col(value), bounds)))
