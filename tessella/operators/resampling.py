"""Resampling seeded by md5 of a seed and row ids: the same draws in any partitioning, engine or rerun."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import fits
from tessella.operators.cuts import cut
from tessella.operators.ranking import average_rank

#: Low bits of draws that tell rows of one range apart: the high ones make 4096 ranges.
RANGE_BITS = 20
#: Cumulative probabilities of a Poisson variable of mean 1.
STEPS = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
#: Messages hashed in a step.
MESSAGES = 1 << 14


def draw(*parts: str | Column) -> Column:
    """A whole number below 2**32 from md5 of the parts."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, 8), 16, 10).cast("long")


def replicates(df: DataFrame, n: int, out: str = "rep") -> DataFrame:
    """Each row once for each replicate from 1 to ``n``; rows are dealt over tasks first, as a small table may be a file that one task reads."""
    spark = df.sparkSession
    dealt = df.repartition(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))
    return dealt.withColumn(out, F.explode(F.sequence(F.lit(1), F.lit(n))))


def poisson(*parts: str | Column) -> Column:
    """A Poisson count of mean 1 from md5 of the parts: how often a bootstrap takes a row."""
    u = (draw(*parts) + 0.5) / float(1 << 32)
    return sum(((u > F.lit(s)).cast("long") for s in STEPS), F.lit(0).cast("long"))


def md5_heads(prefix: bytes, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The first four bytes, as a number, of md5 of ``prefix`` and each text of ``data``: as ``draw`` has them.

    Messages of one block and of equal length are hashed at once; longer ones each by itself.
    """
    out = np.zeros(len(starts), np.uint32)
    for size in np.unique(sizes):
        own, length = np.flatnonzero(sizes == size), len(prefix) + int(size)
        if length > 55:
            raw = data.tobytes()
            out[own] = [int.from_bytes(hashlib.md5(prefix + raw[lo : lo + size]).digest()[:4], "big") for lo in starts[own]]
            continue
        for lo in range(0, len(own), MESSAGES):
            some = own[lo : lo + MESSAGES]
            block = np.zeros((len(some), 64), np.uint8)
            block[:, : len(prefix)] = np.frombuffer(prefix, np.uint8)
            block[:, len(prefix) : length] = data[starts[some][:, None] + np.arange(size)]
            block[:, length] = 0x80
            block[:, 56:] = np.frombuffer((8 * length).to_bytes(8, "little"), np.uint8)
            words = np.ascontiguousarray(block.view("<u4").T)
            # Words without a byte of the texts are the same for all.
            same = [4 * i + 4 <= len(prefix) or 4 * i >= length for i in range(16)]
            a, b, c, d = (np.full(len(some), v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
            f = np.empty_like(a)
            for i in range(64):
                if i < 16:
                    at = i
                    np.bitwise_xor(c, d, out=f)
                    f &= b
                    f ^= d
                elif i < 32:
                    at = (5 * i + 1) % 16
                    np.bitwise_xor(b, c, out=f)
                    f &= d
                    f ^= c
                elif i < 48:
                    at = (3 * i + 5) % 16
                    np.bitwise_xor(b, c, out=f)
                    f ^= d
                else:
                    at = 7 * i % 16
                    np.invert(d, out=f)
                    f |= b
                    f ^= c
                # What is added up in place of ``a`` becomes the next ``b``.
                a += f
                a += np.uint32((_SINES[i] + (int(words[at, 0]) if same[at] else 0)) & 0xFFFFFFFF)
                if not same[at]:
                    a += words[at]
                turn = _TURNS[i // 16][i % 4]
                np.left_shift(a, np.uint32(turn), out=f)
                a >>= np.uint32(32 - turn)
                a |= f
                a += b
                a, b, c, d = d, a, b, c
            out[some] = (a + np.uint32(0x67452301)).byteswap()
    return out


_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))


def poisson_counts(df: DataFrame, key: str, reps: int, seed: str, out: str = "w") -> DataFrame:
    """``df`` with bytes in place of its ``key``: a 1 and then ``poisson(seed, rep, key)`` of replicates 1 to ``reps``; keys aren't null."""
    # The least draws whose place in the unit interval is beyond each step.
    least = [next(u for u in range(max(0, int(s * 2**32) - 2), 2**32) if (u + 0.5) / 2**32 > s) for s in STEPS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).cast(pa.large_string())
            n = len(texts)
            ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            found = np.ones((n, 1 + reps), np.uint8)
            for r in range(1, reps + 1):
                u = md5_heads(f"{seed}|{r}|".encode(), data, ends[:-1], np.diff(ends))
                found[:, r] = sum((u >= np.uint32(s)).view(np.uint8) for s in least)
            at = np.arange(n + 1, dtype=np.int32) * (1 + reps)
            w = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(found)])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], w], names=names)

    others = df.drop(key)
    names = [*others.columns, out]
    kind = others.select("*", F.lit(b"").alias(out)).schema
    return df.select(*others.columns, F.col(key).cast("string").alias("__key")).mapInArrow(run, kind)


def folds(df: DataFrame, key: str, label: str, k: int, seed: str, out: str = "fold", ties: str | None = None) -> DataFrame:
    """Stratified folds from 0: rows of a label are dealt in turn, in the order of their draws, those of one draw by ``ties``, else by key.

    Places are counted inside ranges of draws and after the ranges before, so that no window holds a label.
    """
    rows = df.withColumn("__u", draw(seed, F.col(key))).withColumn("__cell", F.shiftright("__u", RANGE_BITS))
    before = Window.partitionBy("__label").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = rows.groupBy(F.col(label).alias("__label"), F.col("__cell").alias("__of")).agg(F.count("*").alias("__n")).withColumnRenamed("__of", "__cell")
    starts = starts.select("__label", F.col("__cell").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = rows.withColumn("__place", F.row_number().over(Window.partitionBy(label, "__cell").orderBy("__u", ties or key)))
    joined = inside.join(starts, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__cell") == F.col("__of")))
    return joined.withColumn(out, (F.col("__start") + F.col("__place") - 1) % k).select(*df.columns, out)


def repeated_folds(df: DataFrame, key: str, label: str, k: int, reps: int, seed: str) -> DataFrame:
    """Stratified folds of every repeat ``rep`` from 1, each by its own draws; a null label is a stratum of its own."""
    rows = replicates(df, reps).withColumn("__id", F.concat_ws("|", "rep", key)).withColumn("__stratum", F.concat_ws("|", F.col("rep").cast("string"), F.coalesce(F.to_json(F.struct(label)), F.lit(""))))
    # Rows of one draw go by the key itself: as text 10 comes before 9.
    return folds(rows, "__id", "__stratum", k, seed, ties=key).drop("__id", "__stratum")


def permutation_auc(df: DataFrame, key: str, label: str, value: str, reps: int, seed: str) -> DataFrame:
    """Observed AUC of a value for 0/1 labels, and the share of label permutations at least as far from one half.

    A permutation gives label 1 to as many rows as have it, those with the smallest draws. Ranks are computed once. Ranges
    of draws are summed whole; only the range of a replicate in which label 1 ends has its rows put in order.
    """
    rows = fits.cut(average_rank(df.where(F.col(label).isNotNull() & F.col(value).isNotNull()).select(key, label, value), [], value))
    n1, n0 = F.sum(F.col(label).cast("long")), F.sum(1 - F.col(label).cast("long"))
    observed = rows.agg(n1.alias("n1"), n0.alias("n0"), F.sum(F.col("avg_rank") * F.col(label)).alias("r"))
    drawn = replicates(rows, reps).withColumn("__u", draw(seed, F.col("rep"), F.col(key))).withColumn("__cell", F.shiftright("__u", RANGE_BITS))
    before = Window.partitionBy("rep").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    cells = drawn.groupBy("rep", "__cell").agg(F.count("*").alias("n"), F.sum("avg_rank").alias("s")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cells = fits.cut(cells.crossJoin(F.broadcast(observed.select("n1", "n0"))))  # one row
    whole = cells.groupBy("rep").agg(F.first("n1").alias("n1"), F.first("n0").alias("n0"), F.sum(F.when(F.col("before") + F.col("n") <= F.col("n1"), F.col("s")).otherwise(0.0)).alias("whole"))
    edge = cells.where("before < n1 AND before + n > n1").select("rep", "__cell", (F.col("n1") - F.col("before")).alias("__need"))
    place = Window.partitionBy("rep", "__cell").orderBy("__u", key)
    last = drawn.join(F.broadcast(edge), ["rep", "__cell"]).withColumn("place", F.row_number().over(place))  # a row a replicate
    last = last.where(F.col("place") <= F.col("__need")).groupBy("rep").agg(F.sum("avg_rank").alias("rest"))
    sums = whole.join(last, "rep", "left").withColumn("r", F.col("whole") + F.coalesce("rest", F.lit(0.0)))
    auc = F.round((F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * F.col("n0")), 9)
    null = sums.select("rep", auc.alias("null_auc"))
    one = observed.select("n1", "n0", auc.alias("auc"))
    joined = null.crossJoin(F.broadcast(one))  # one row
    extreme = F.count_if(F.abs(F.col("null_auc") - 0.5) >= F.abs(F.col("auc") - 0.5))
    return joined.groupBy("n1", "n0", "auc").agg(((extreme + 1) / (F.count("*") + 1)).alias("p_value"), F.avg("null_auc").alias("null_mean"))


def bootstrap_mean(df: DataFrame, by: list[str], key: str, value: str, reps: int, seed: str) -> DataFrame:
    """Percentile interval of the mean by group.

    A row's weight in a replicate is Poisson of mean 1, from its draw: no row is looked up by position, so nothing is
    shuffled but sums by group and replicate.
    """
    u = (draw(seed, F.col("rep"), F.col(key)) + 0.5) / float(1 << 32)
    # Cumulative probabilities of a Poisson variable of mean 1.
    steps = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)
    weight = sum(((u > F.lit(s)).cast("int") for s in steps), F.lit(0))
    rows = replicates(df.where(F.col(value).isNotNull()).select(*by, key, value), reps).withColumn("w", weight)
    means = rows.groupBy(*by, "rep").agg(F.try_divide(F.sum(F.col("w") * F.col(value)), F.sum("w")).alias("mean"))
    q = lambda at: F.percentile("mean", F.lit(at))
    return means.groupBy(*by).agg(F.count("mean").alias("reps"), q(0.025).alias("low"), q(0.5).alias("mid"), q(0.975).alias("high"))


def random_panels(df: DataFrame, by: list[str], key: str, size: int | str, reps: int, seed: str) -> DataFrame:
    """For each replicate, the ``size`` rows of each group with the smallest draws; ``size`` may be a column of ``df``.

    Ranges of draws are counted first; rows of ranges beyond a panel's last one go unsorted, and places are counted inside
    ranges, so that no window holds a group.
    """
    most = F.lit(size) if isinstance(size, int) else F.col(size)
    rows = replicates(df, reps).withColumn("__u", draw(seed, F.col("rep"), F.col(key))).withColumn("__cell", F.shiftright("__u", RANGE_BITS))
    of = [f"__of{i}" for i in range(len(by))]
    cells = rows.groupBy(*[F.col(c).alias(o) for c, o in zip(by, of, strict=True)], F.col("rep").alias("__rep"), F.col("__cell").alias("__at")).agg(F.count("*").alias("__n"), F.max(most).alias("__most"))
    before = Window.partitionBy(*of, "__rep").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    # Written, so that their size is known and few ranges go to the rows instead of all rows to the ranges.
    cells = cut(cells.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).where("__start < __most").drop("__n", "__most"))
    same = (F.col("rep") == F.col("__rep")) & (F.col("__cell") == F.col("__at"))
    for c, o in zip(by, of, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(o))
    inside = Window.partitionBy(*by, "rep", "__cell").orderBy("__u", key)
    placed = rows.join(cells, same).withColumn("__place", F.col("__start") + F.row_number().over(inside))
    return placed.where(F.col("__place") <= most).select(*df.columns, "rep")


def leave_one_out(df: DataFrame, unit: str, value: str) -> DataFrame:
    """The mean without each unit, from sums: nothing is recomputed."""
    sums = df.where(F.col(value).isNotNull()).groupBy(unit).agg(F.sum(value).alias("s"), F.count("*").alias("n"))
    whole = sums.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    return sums.crossJoin(F.broadcast(whole)).select(unit, F.try_divide(F.col("all_s") - F.col("s"), F.col("all_n") - F.col("n")).alias("mean_without"))  # one row


def sign_flips(df: DataFrame, by: list[str], key: str, value: str, most: int = 20, draws: int = 100_000, seed: str = "flip") -> DataFrame:
    """Two-sided sign-flip p-values of the mean of paired differences, for every group.

    All sign patterns of groups of up to ``most`` differences are enumerated. Larger groups get ``draws`` patterns of bits
    from md5 of the seed and ``key``, whose sums are added up over tasks; with the observed pattern they give the p-value.
    """
    rows = df.where(F.col(value).isNotNull()).withColumn("__gid", F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))
    sizes = rows.groupBy("__gid").agg(*[F.first(c).alias(c) for c in by], F.count("*").alias("n"), F.avg(value).alias("mean"))
    few = rows.join(sizes.where(F.col("n") <= most).select("__gid"), "__gid", "left_semi")
    order = Window.partitionBy("__gid").orderBy(key)
    few = few.withColumn("bit", F.row_number().over(order) - 1)
    sized = few.groupBy("__gid").agg(F.sort_array(F.collect_list(F.struct("bit", value))).alias("d"), F.count("*").alias("n"))
    flips = sized.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("shiftleft(1L, cast(n AS int)) - 1"))))
    signed = F.aggregate("d", F.lit(0.0), lambda s, x: s + F.when(F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), x["bit"].cast("int"))) != 0, -x[value]).otherwise(x[value]))
    plain = F.aggregate("d", F.lit(0.0), lambda s, x: s + x[value])
    exact = flips.select("__gid", (F.abs(signed) >= F.abs(plain) - 1e-9).cast("int").alias("hit")).groupBy("__gid").agg(F.avg("hit").alias("p_value"))

    def sums(batches):
        for b in batches:
            for gid, own in b.groupby("gid"):
                total = np.zeros(-(-draws // 128) * 128)
                for k, v in zip(own["key"], own["v"], strict=True):
                    bits = np.frombuffer(b"".join(hashlib.md5(f"{seed}|{i}|{k}".encode()).digest() for i in range(len(total) // 128)), np.uint8)
                    total += np.where(np.unpackbits(bits) == 1, -v, v)
                yield pd.DataFrame({"gid": gid, "draw": np.arange(-1, draws), "s": np.concatenate([[own["v"].sum()], total[:draws]])})

    many = rows.join(sizes.where(F.col("n") > most).select("__gid"), "__gid", "left_semi")
    drawn = many.select(F.col("__gid").alias("gid"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("v")).mapInPandas(sums, "gid string, draw long, s double").groupBy("gid", "draw").agg(F.sum("s").alias("s"))
    seen = drawn.where("draw < 0").select(F.col("gid").alias("__gid"), F.col("s").alias("__seen"))
    hits = drawn.where("draw >= 0").join(seen, F.col("gid") == F.col("__gid")).groupBy("__gid").agg(((F.count_if(F.abs("s") >= F.abs("__seen") - 1e-9) + 1) / (F.count("*") + 1)).alias("p_value"))
    return sizes.join(exact.unionByName(hits), "__gid").select(*by, "n", "mean", "p_value")
