"""Building evidence tables: fallback pools, mappings with a status, reindexing, columns by name or contents, and picks by variance or detection."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ranking import value_ranks


def fallback_bins(targets: DataFrame, pool: DataFrame, bin: str, least: int) -> DataFrame:
    """For each bin of ``targets``, the nearest bin of ``pool`` with at least ``least`` rows (ties: the lower): ``bin, pool_bin, pool_size``.

    Bins are few, and only counts by bin meet; a bin without any large enough has nulls.
    """
    sizes = pool.where(F.col(bin).isNotNull()).groupBy(F.col(bin).alias("__pool")).agg(F.count("*").alias("__size")).where(F.col("__size") >= least)
    wanted = targets.select(F.col(bin).alias("bin")).where("bin IS NOT NULL").distinct()
    both = wanted.join(F.broadcast(sizes), F.lit(True), "left")  # bins by bins
    best = F.min_by(F.struct("__pool", "__size"), F.struct(F.abs(F.col("__pool") - F.col("bin")), F.col("__pool")))
    return both.groupBy("bin").agg(best.alias("__best")).select("bin", F.col("__best.__pool").alias("pool_bin"), F.col("__best.__size").alias("pool_size"))


def map_with_status(rows: DataFrame, mapping: DataFrame, key: str, to: str, missing: str = "not_found") -> DataFrame:
    """``rows`` once for each of their mappings, unmapped ones kept: ``to``, ``n_mapped`` and ``status`` (one_to_one, one_to_many or ``missing``)."""
    pairs = mapping.select(F.col(key).alias("__key"), to).distinct()
    counts = pairs.groupBy("__key").agg(F.count("*").alias("n_mapped")).withColumnRenamed("__key", "__counted")
    joined = rows.join(pairs, F.col(key) == F.col("__key"), "left").join(counts, F.col(key) == F.col("__counted"), "left").drop("__key", "__counted")
    status = F.when(F.col("n_mapped") == 1, "one_to_one").when(F.col("n_mapped") > 1, "one_to_many").otherwise(missing)
    return joined.withColumn("n_mapped", F.coalesce("n_mapped", F.lit(0)).cast("long")).withColumn("status", status)


def reindex(df: DataFrame, keys: DataFrame, key: str, fill: dict[str, object]) -> DataFrame:
    """A row for each key, with ``fill`` where ``df`` has none or a null."""
    return keys.select(key).distinct().join(df, key, "left").fillna(fill)


def concat_on_key(frames: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """One value column of several frames side by side, a full outer join of any number of frames in one shuffle."""
    tagged = [f.select(key, F.lit(name).alias("__frame"), F.col(value).alias("__value")) for name, f in frames.items()]
    both = reduce(DataFrame.unionByName, tagged)
    return both.groupBy(key).agg(*[F.max(F.when(F.col("__frame") == name, F.col("__value"))).alias(name) for name in frames])


def complete_cases(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null or NaN in any of the columns."""
    return df.dropna(subset=columns)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """``df`` with every column of ``defaults``: added where absent, filled where null."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def _plain(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "", name.lower())


def resolve_column(columns: list[str], candidates: list[str]) -> str | None:
    """The column that a list of candidate names means: an exact name, else one equal but for case and signs, else one that holds all words of a candidate."""
    for c in candidates:
        if c in columns:
            return c
    for c in candidates:
        for own in columns:
            if _plain(own) == _plain(c):
                return own
    for c in candidates:
        for own in columns:
            if all(w in own.lower() for w in re.findall(r"[0-9a-z]+", c.lower())):
                return own
    return None


def column_scores(df: DataFrame, columns: list[str], good: Column | None = None, known: list[str] | None = None) -> DataFrame:
    """How well columns' contents fit: ``column_name, n, score``, the share of values that are ``known``, best first; one pass over the table."""
    fits = [F.avg(F.col(c).cast("string").isin(known).cast("double")).alias(f"s{i}") for i, c in enumerate(columns)]
    one = df.agg(*fits, *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)])
    stack = ", ".join(f"'{c}', n{i}, coalesce(s{i}, 0D)" for i, c in enumerate(columns))
    return one.selectExpr(f"stack({len(columns)}, {stack}) AS (column_name, n, score)").orderBy(F.desc("score"), "column_name")


def roles(df: DataFrame, categories: int = 10) -> DataFrame:
    """A row a column: its least and greatest value as text, and whether it could be a key, a category or a number, in one pass."""
    names, stats = df.columns, []
    for i, c in enumerate(names):
        text = F.col(c).cast("string")
        stats += [F.count(c).alias(f"n{i}"), F.countDistinct(c).alias(f"d{i}"), F.min(text).alias(f"a{i}"), F.max(text).alias(f"z{i}"), F.count(text.try_cast("double")).alias(f"x{i}")]
    stack = ", ".join(f"'{c}', a{i}, z{i}, n{i} > 0 AND d{i} = n{i}, d{i} <= {categories}, n{i} > 0 AND x{i} = n{i}" for i, c in enumerate(names))
    return df.agg(*stats).selectExpr(f"stack({len(names)}, {stack}) AS (column_name, least, greatest, is_key, is_category, is_number)")


def duplicate_columns(long: DataFrame, key: str, feature: str, value: str) -> DataFrame:
    """Features whose values equal those of a smaller feature in every row: ``feature, same_as``; columns meet by sums of hashes, not pairwise."""
    a, b = (F.sum(F.xxhash64(F.lit(seed), F.col(key), F.col(value)).cast("decimal(38,0)")) for seed in (1, 2))
    prints = long.groupBy(feature).agg(a.alias("__a"), b.alias("__b"), F.count("*").alias("__n"))
    first = prints.groupBy("__a", "__b", "__n").agg(F.min(feature).alias("same_as"))
    return prints.join(first, ["__a", "__b", "__n"]).where(F.col(feature) > F.col("same_as")).select(feature, "same_as")


def pick(stats: DataFrame, group: str, item: str, by: list[Column]) -> DataFrame:
    """For each group its best item by ``by``, the smaller item on ties; groups meet as aggregates, not as windows."""
    order = F.struct(*by, F.col(item))
    return stats.groupBy(group).agg(F.min_by(F.struct(*[c for c in stats.columns if c != group]), order).alias("__best")).select(group, "__best.*")


def first_rank_bins(df: DataFrame, key: str, value: str, bins: int, out: str = "bin") -> DataFrame:
    """Bins ``least(floor(rank / n * bins), bins - 1)`` by the rank of a value, ties in the order of the key."""
    ranks = value_ranks(df, [], value).select(F.col(value).alias("__v"), "below")
    n = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("__n"))
    inside = df.withColumn("__place", F.row_number().over(Window.partitionBy(value).orderBy(key)))
    joined = inside.join(ranks, F.col(value) == F.col("__v"), "left").crossJoin(F.broadcast(n))  # one row
    rank = F.col("below") + F.col("__place")
    return joined.withColumn(out, F.least(F.floor(rank / F.col("__n") * bins), F.lit(bins - 1)).cast("int")).drop("__place", "__v", "below", "__n")


def automatic_log(df: DataFrame, value: str, out: str, median: float, least: float, most: float) -> DataFrame:
    """``log2(x + 1)`` where the whole column has no negative value and is large (greatest above 50 or median above 10), else the value."""
    due = least is not None and least >= 0 and (most > 50 or median > 10)
    return df.withColumn(out, F.log2(F.col(value) + 1) if due else F.col(value).cast("double"))
