"""Line dedup by site-relative frequency, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import store
from tessella.llm.names import free, quoted

#: Share of a host's pages above which a line is boilerplate.
RATIO = 0.1
#: Hosts with more than this share of all pages, fewer than its inverse, are joined apart from the rest.
HOT = 0.001


def _hashes(text: str) -> Column:
    """Hashes of a text's lines that aren't blank."""
    return F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), lambda x: F.xxhash64(x))


def boilerplate(pages: DataFrame, ratio: float = RATIO, host: str = "source", text: str = "text") -> DataFrame:
    """Hashes of boilerplate lines by host: ``host, lines, share``, a row a host that has any, with its share of all pages.

    A line counts once a page; its pages are divided by all pages of the host, those without text too, and a line that
    exceeds ``ratio`` is boilerplate if it repeats, on two pages at least: what one page alone holds is its own text. A
    host's array holds at most (distinct lines a page, on average) / ``ratio`` entries. Blank lines never count; a null
    host is a host of its own; an empty table gives an empty result.
    """
    own = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = own.groupBy("host").agg(F.count("*").alias("pages")).select(F.col("host").alias("of"), "pages")
    every = totals.agg(F.sum("pages").alias("every"))
    each = own.select("host", F.explode(F.array_distinct(_hashes("text"))).alias("line"))
    counted = each.groupBy("host", "line").agg(F.count("*").alias("on_pages")).where("on_pages > 1")
    often = counted.join(totals, F.col("host").eqNullSafe(F.col("of"))).where(F.col("on_pages") > F.lit(float(ratio)) * F.col("pages"))
    found = often.groupBy("host").agg(F.collect_set("line").alias("lines"), F.max("pages").alias("pages"))
    return found.crossJoin(F.broadcast(every)).select("host", "lines", (F.col("pages") / F.col("every")).alias("share"))


def drop_boilerplate(docs: DataFrame, ratio: float = RATIO, host: str = "source", text: str = "text", hot: float = HOT) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text, and ``n_lines`` and ``n_dropped`` added.

    Other lines, blank ones too, stay in order. A null text stays null with 0 lines; an empty one has one blank line; a
    null host is a host of its own; repeated rows are pages of their own; a text may lose all its lines and is then empty.
    Columns called ``n_lines`` or ``n_dropped`` are replaced. An empty table gives an empty result.

    Texts of hosts with a share of more than ``hot`` of all pages stay where they are: those hosts' lines, at most (lines a
    page, on average over all pages) / (``hot`` * ``ratio``) hashes, are broadcast. The others meet their lines by host, and
    none of them has more pages than that share.
    """
    of, own_lines, page, left = (free(docs, n) for n in ("host", "lines", "page", "left_lines"))
    found = store.materialize(boilerplate(docs, ratio, host, text), "boilerplate")
    often, rare = (found.where(x).select(F.col("host").alias(of), F.col("lines").alias(own_lines)) for x in (F.col("share") > hot, F.col("share") <= hot))
    same = F.col(host).eqNullSafe(F.col(of))
    joined = docs.join(F.broadcast(often), same).unionByName(docs.join(F.broadcast(often), same, "left_anti").join(rare, same, "left"))
    # The page's own boilerplate lines are found by hashing, so that each line is looked up among these few. An exploded
    # array of one keeps what was worked out for a page from being worked out again for each of its lines.
    once = lambda df, name, value: df.withColumn(name, F.explode(F.array(value)))
    own = F.array_intersect(_hashes(text), F.coalesce(own_lines, F.array().cast("array<bigint>")))
    joined = once(joined, page, F.struct(F.split(text, "\n").alias("all"), own.alias("own")))
    every, own = F.col(page)["all"], F.col(page)["own"]
    rest = F.filter(every, lambda x: (F.trim(x) == "") | ~F.array_contains(own, F.xxhash64(x)))
    joined = once(joined, left, F.when(F.size(own) > 0, rest).otherwise(every))
    size = lambda x: F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(x)).cast("long")
    names = [(c, q) for c, q in zip(docs.columns, quoted(docs)) if c.lower() not in ("n_lines", "n_dropped")]
    n, cleaned = size(every), F.array_join(left, "\n")
    return joined.select(*[cleaned.alias(c) if c == text else F.col(q) for c, q in names], n.alias("n_lines"), (n - size(left)).alias("n_dropped"))
