"""Mixing sources to target weights, in DataFrame functions only.

Each document gets a hash-random key. Within a source the keys are dealt into equal ranges of about ``range_rows``
documents; sums of sizes by range, then running sums of those, then running sums inside each range give every document
the words before it in its source's random order, and no window holds more than a range or a table of range sums. A
source's budget is cut exactly there: as many whole epochs as fit, then documents up to the cut, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import store
from tessella.llm.names import free, quoted

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 where it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], most_epochs: float) -> DataFrame:
    """Targets of sources (``source``, ``source_size``): all sizes shared by weight, none above ``most_epochs`` times its size.

    Weights repeat over the sources by code point, null last. What is above the bound is shared again by weight among the
    others until none is above: sources sorted by bound over weight are capped one after another, so that the result
    comes from running sums. The table has a row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    everything = Window.partitionBy()
    before = ratio.rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    spread = (
        sources.withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most_epochs)))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("fits", (F.col("total") - F.col("capped")) * F.col("weight") <= F.col("cap") * F.col("open"))
    )
    # The first source in this order that fits sets what the rest share.
    first = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), "place", "capped", "open"))).over(everything)
    shared = (F.col("total") - F.col("first.capped")) * F.col("weight") / F.col("first.open")
    target = F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), shared))
    return spread.withColumn("first", first).select("source", "source_size", "docs", "weight", target.alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most_epochs: float = 3.0, seed: str = "mix-1", key: str = "doc_id", source: str = "source", text: str = "text", range_rows: int = 4096) -> DataFrame:
    """How many words of each document the mix takes.

    Returns ``doc_id, source, tie, size, source_size, target, taken`` with a row for each row of ``docs``. ``taken`` is
    ``size`` times the whole epochs of its source, plus once more before the cut, plus a part at the cut; the sum over a
    source is its target's floor. Null texts have size 0, a null source is a source, repeated rows are rows of their own,
    and rows that agree in key, source and text are interchangeable. An empty table gives an empty result.
    """
    word = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    sized = docs.select(
        F.col(key).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("tie"), word_count(F.col(text)).alias("size"),
        F.conv(F.substring(word, 1, 13), 16, 10).cast("long").alias("random"),
    )
    sized = store.materialize(sized, "mix-sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    targets = source_targets(sources, weights, most_epochs)
    ranges = F.ceil(F.col("docs") / F.lit(range_rows)).cast("long")
    budget = F.floor("target").cast("long")
    targets = targets.select(
        F.col("source").alias("of"), "source_size", "target", ranges.alias("ranges"),
        F.expr("CASE WHEN source_size > 0 THEN floor(target) DIV source_size ELSE 0 END").alias("epochs"), budget.alias("budget"),
    )
    targets = store.materialize(targets, "mix-targets")
    # 13 hex digits are 52 bits, which a double holds exactly.
    dealt = sized.join(targets, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("range", F.floor(F.col("random") / F.lit(float(1 << 52)) * F.col("ranges")).cast("long"))
    sums = dealt.groupBy("of", "range").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("of").alias("sum_of"), F.col("range").alias("sum_range"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("of", "range").orderBy("random", "doc_id", "tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(sums, F.col("of").eqNullSafe(F.col("sum_of")) & (F.col("range") == F.col("sum_range")), "left")
    rest = F.col("budget") - F.col("epochs") * F.col("source_size") - F.col("range_start") - F.col("inside")
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return placed.select("doc_id", "source", "tie", "size", "source_size", "target", taken.cast("long").alias("taken"))


def apply_mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it whole, and the one at a source's cut once more in part.

    A document cut in part keeps its first words, joined by single spaces. Documents that the mix doesn't take go; those
    without words stay once. Columns are those of ``docs``.
    """
    doc, of, same, taken, rows, size, piece = (free(docs, n) for n in ("mix_doc", "mix_source", "mix_tie", "mix_taken", "mix_rows", "mix_size", "mix_piece"))
    share = plan.groupBy(F.col("doc_id").alias(doc), F.col("source").alias(of), F.col("tie").alias(same)).agg(F.sum("taken").alias(taken), F.count("*").alias(rows), F.max("size").alias(size))
    on = F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("source").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(same))
    # Equal rows share what was taken of them: each takes an equal part, whole copies first.
    each = F.expr(f"{taken} DIV {rows}")
    copies = F.when(F.col(size) == 0, F.lit(1)).otherwise(F.expr(f"({taken} DIV {rows}) DIV {size}")).cast("int")
    left = F.when(F.col(size) == 0, F.lit(0)).otherwise(each - copies * F.col(size)).cast("int")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    pieces = F.concat(F.array_repeat(F.col("text"), copies), F.when(left > 0, F.array(F.array_join(F.slice(words, 1, left), " "))).otherwise(F.array().cast("array<string>")))
    # A row without text is kept once: its only piece is null.
    mixed = docs.join(share, on).withColumn(piece, F.explode(pieces))
    return mixed.select(*[F.col(piece).alias(n) if n == "text" else F.col(q) for n, q in zip(docs.columns, quoted(docs))])
