"""Joins, de-duplication, set measures and profiles over generic tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Groups with one item that meet in one task.
MEETING = 1000


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in ``order``, which must end in a tie-breaker.

    Spark keeps the first of each key in every task before the shuffle, so a frequent key's rows don't meet.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(w)).where("__place = 1").drop("__place")


def keep_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once; keys that repeat are dropped whole."""
    once = df.groupBy(*keys).count().where("count = 1").drop("count")
    return df.join(once, keys, "left_semi")


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A one-to-one join; keys that repeat on either side, or are null, are an error. One job checks both sides."""
    null = F.lit(False)
    for c in on:
        null = null | F.col(c).isNull()
    keys = [df.select(*on).groupBy(*on).agg(F.count("*").alias("__n")).select(F.lit(side).alias("side"), F.when(null, "are null").when(F.col("__n") > 1, "repeat").alias("fault")) for side, df in (("left", left), ("right", right))]
    faults = keys[0].unionByName(keys[1]).where("fault IS NOT NULL").distinct().orderBy("side", "fault").collect()  # four at most
    if faults:
        raise ValueError("; ".join(f"keys {on} {r['fault']} on the {r['side']} side" for r in faults))
    return left.join(right, on, how)


def nearest_join(df: DataFrame, value: str, points: list[float], out: str = "nearest") -> DataFrame:
    """Each row with the nearest of a short list of points, the smaller one on ties; no join is needed for a list."""
    options = [F.struct(F.abs(F.col(value) - F.lit(p)).alias("d"), F.lit(p).alias("p")) for p in sorted(points)]
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.array_min(F.array(*options))["p"]))


def full_outer(left: DataFrame, right: DataFrame, key: str, left_prefix: str, right_prefix: str) -> DataFrame:
    """A full outer join whose other columns carry the prefix of their side."""
    a = left.select(F.col(key), *[F.col(c).alias(left_prefix + c) for c in left.columns if c != key])
    b = right.select(F.col(key), *[F.col(c).alias(right_prefix + c) for c in right.columns if c != key])
    return a.join(b, key, "full_outer")


def coverage(wanted: DataFrame, available: DataFrame, key: str, by: str) -> DataFrame:
    """Keys wanted by group, how many of them are available, and the share."""
    have = available.select(key).distinct().withColumn("__have", F.lit(1))
    joined = wanted.select(by, key).distinct().join(have, key, "left")
    requested, found = F.count("*"), F.count("__have")
    return joined.groupBy(by).agg(requested.alias("requested"), found.alias("available"), (found / requested).alias("fraction"))


def at_least(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of groups with ``n`` rows or more."""
    return df.join(df.groupBy(*keys).count().where(F.col("count") >= n).drop("count"), keys, "left_semi")


def top_with_forced(df: DataFrame, k: int, order: list[Column], forced: Column) -> DataFrame:
    """The first ``k`` rows, and all that are forced, marked by ``is_top`` and ``is_forced``; equal rows stay rows of their own.

    Rows are first told apart by a number, of which the top ones are few; the others only meet their forced mark.
    """
    marked = df.withColumn("is_forced", F.coalesce(forced, F.lit(False)))
    top = marked.orderBy(*order).limit(k)
    # The last of the top rows tells which of the others are beyond it; equal ones are counted, not merged.
    counts = top.groupBy(*marked.columns).agg(F.count("*").alias("__n"))
    same = F.lit(True)
    for c in marked.columns:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    first = marked.where("is_forced").groupBy(*marked.columns).agg(F.count("*").alias("__all"))
    rest = first.alias("l").join(F.broadcast(counts.alias("r")), same, "left")  # at most k rows
    rest = rest.select("l.*", (F.col("l.__all") - F.coalesce("r.__n", F.lit(0))).alias("__more")).where("__more > 0")
    rest = rest.withColumn("__each", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__more")))).drop("__all", "__more", "__each")
    return top.withColumn("is_top", F.lit(True)).unionByName(rest.withColumn("is_top", F.lit(False)))


def union_first(frames: list[DataFrame], keys: list[str], order: list[Column]) -> DataFrame:
    """A union where, of rows with one key, the one of the earliest frame stays; ``source_rank`` tells which."""
    tagged = [f.withColumn("source_rank", F.lit(i)) for i, f in enumerate(frames, 1)]
    both = tagged[0]
    for f in tagged[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    return keep_best(both, keys, [F.col("source_rank"), *order])


def set_scores(members: DataFrame, group: str, item: str) -> DataFrame:
    """Overlap, Jaccard index and F1 of all pairs of groups that share an item; counts meet by item, not by pairs of groups."""
    own = members.select(group, item).distinct()
    sizes = own.groupBy(group).agg(F.count("*").alias("size"))
    # An item of many groups meets in parts: one side's groups in one part each, the other side's in all.
    often = own.groupBy(F.col(item).alias("__item")).agg(F.ceil(F.count("*") / F.lit(MEETING)).cast("int").alias("__parts"))
    parted = own.join(often, F.col(item) == F.col("__item")).drop("__item")
    a = parted.select(F.col(group).alias("a"), item, F.pmod(F.xxhash64(group), F.col("__parts")).cast("int").alias("__part"))
    b = parted.select(F.col(group).alias("b"), item, F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__part"))
    shared = a.join(b, [item, "__part"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("overlap"))
    sized = shared.join(sizes.select(F.col(group).alias("a"), F.col("size").alias("size_a")), "a").join(sizes.select(F.col(group).alias("b"), F.col("size").alias("size_b")), "b")
    both = F.col("size_a") + F.col("size_b")
    return sized.withColumn("jaccard", F.col("overlap") / (both - F.col("overlap"))).withColumn("f1", 2 * F.col("overlap") / both)


def best_match(scores: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """For each ``by``, its best-scoring row."""
    return keep_best(scores, [by], order)


def overlap_at(left: DataFrame, right: DataFrame, key: str, ks: Iterable[int]) -> DataFrame:
    """How many keys are among the first k of both rankings (columns ``place``)."""
    ks = sorted(ks)
    a = left.where(F.col("place") <= ks[-1]).select(key, F.col("place").alias("pa"))
    b = right.where(F.col("place") <= ks[-1]).select(key, F.col("place").alias("pb"))
    worst = F.greatest("pa", "pb")
    one = a.join(b, key).agg(*[F.count_if(worst <= k).alias(f"k{k}") for k in ks])
    stack = ", ".join(f"{k}, k{k}" for k in ks)
    return one.selectExpr(f"stack({len(ks)}, {stack}) AS (k, overlap)").withColumn("fraction", F.col("overlap") / F.col("k"))


def cardinality(df: DataFrame, left: str, right: str) -> DataFrame:
    """How two columns relate: one to one, nested either way, or many to many."""
    pairs = df.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    by_left = pairs.groupBy(left).count().agg(F.max("count").alias("right_per_left"))
    by_right = pairs.groupBy(right).count().agg(F.max("count").alias("left_per_right"))
    kind = (
        F.when((F.col("right_per_left") == 1) & (F.col("left_per_right") == 1), "one_to_one")
        .when(F.col("right_per_left") == 1, "left_nested_in_right")
        .when(F.col("left_per_right") == 1, "right_nested_in_left")
        .otherwise("many_to_many")
    )
    return by_left.crossJoin(by_right).withColumn("relationship", kind)  # one row each


def profile(df: DataFrame) -> DataFrame:
    """A row a column: values, nulls and distinct values, in one pass over the table."""
    names = df.columns
    stats = []
    for i, c in enumerate(names):
        stats += [F.count(F.col(c)).alias(f"n{i}"), F.count_if(F.col(c).isNull()).alias(f"m{i}"), F.countDistinct(F.col(c)).alias(f"d{i}")]
    one = df.agg(*stats)
    stack = ", ".join(f"'{c}', n{i}, m{i}, d{i}" for i, c in enumerate(names))
    return one.selectExpr(f"stack({len(names)}, {stack}) AS (column_name, non_null, nulls, distinct_values)")


def upsert(base: DataFrame, news: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the columns' values from ``news`` where it has any."""
    new = news.select(key, *[F.col(c).alias(f"__new_{c}") for c in columns])
    joined = base.join(new, key, "left")
    kept = [F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns]
    return joined.select(*kept)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    return df


def collapse(df: DataFrame, keys: list[str], value: str, policy: str = "sum", order: list[str] | None = None) -> DataFrame:
    """One row a key by ``policy``: sum, mean, max, first in ``order``, or drop_all for keys that repeat."""
    if policy == "drop_all":
        return keep_unique(df, keys).select(*keys, value)
    if policy == "first":
        return df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(value))
    how = {"sum": F.sum, "mean": F.avg, "max": F.max}[policy]
    return df.groupBy(*keys).agg(how(value).alias(value))


def pivot_unique(df: DataFrame, key: str, column: str, value: str, columns: list) -> DataFrame:
    """A wide table with a column for each of ``columns``, null where a key lacks one; a key that has one twice is an error.

    Nulls in ``column`` and names that aren't asked for are ignored; a null key is a key. One job looks for repeats.
    """
    rows = df.where(F.col(column).isin(columns))
    twice = rows.groupBy(key, column).agg(F.count("*").alias("__n")).where("__n > 1")
    if not twice.isEmpty():
        raise ValueError(f"{key} and {column} aren't unique")
    return rows.groupBy(key).pivot(column, columns).agg(F.first(value))
