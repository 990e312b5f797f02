"""Readers and writers of tables, text and manifests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessella.operators.cuts import cut

#: Levels of a tree that are kept apart before they become one table.
VISITS = 8


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can read anything at a path or pattern."""
    from pyspark.errors import AnalysisException

    try:
        return bool(spark.read.format("binaryFile").load(path).select("path").limit(1).count())
    except AnalysisException:
        return False


def read_csv(spark: SparkSession, path: str, schema: StructType | str, optional: bool = False, **options) -> DataFrame:
    """A CSV with a header and a given schema; compressed files by their suffix. A missing optional one is empty."""
    if optional and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", **options).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: StructType | str, **options) -> DataFrame:
    """A TSV whose lines after ``#`` are comments."""
    return spark.read.schema(schema).options(header=True, sep="\t", comment="#", **options).csv(path)


def read_first(spark: SparkSession, patterns: list[str], schema: StructType | str) -> DataFrame:
    """The files of the first pattern that matches any."""
    for pattern in patterns:
        if exists(spark, pattern):
            return read_csv(spark, pattern, schema)
    raise FileNotFoundError(f"nothing matches {patterns}")


def read_samples(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Many single-sample files as one long table, with ``sample`` from the file name."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1)
    return spark.read.schema(schema).options(header=True).csv(path).withColumn("sample", name)


#: Columns that name a gene, and those of values with their units, the first present one of each; files without
#: one of these values have counts in their first numeric column.
SYMBOLS, VALUES, LABELS = ("gene_name", "gene_symbol", "symbol"), (("tpm_unstranded", "TPM"), ("unstranded", "counts")), ("gene_id", "gene_type")


def read_counts(spark: SparkSession, path: str, symbols: tuple[str, ...] = SYMBOLS, values: tuple[tuple[str, str], ...] = VALUES, mixed: bool = False) -> DataFrame:
    """Single-sample TSV files with ``#`` comments, each by its own columns: ``sample, symbol, value, unit``.

    The sample is the file's name up to its first dot. Symbols are trimmed and upper-cased; those that are empty or begin with
    ``N_``, and values that aren't numbers, are left out; repeated symbols are added up. A file without a symbol column or a
    usable value column fails, and so does, unless ``mixed``, a folder whose files differ in unit. A file is one row while it
    is split, so it must fit in a task.
    """
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^([^.]+)", 1).alias("sample"), F.split("value", "\r?\n").alias("lines"))
    lines = F.filter("lines", lambda x: ~x.startswith("#") & (F.trim(x) != ""))
    cells = files.select("sample", F.split(F.get(lines, F.lit(0)), "\t").alias("header"), F.transform(F.slice(lines, 2, 1 << 30), lambda x: F.split(x, "\t")).alias("rows"))
    place = lambda names: F.coalesce(*[F.nullif(F.array_position("header", n), F.lit(0).cast("long")) for n in names])
    known = F.coalesce(*[F.when(F.array_contains("header", n), F.struct(F.array_position("header", n).alias("at"), F.lit(unit).alias("unit"))) for n, unit in values])
    number = lambda row, i: F.get(row, (i - 1).cast("int")).try_cast("double")
    numeric = lambda i: F.forall("rows", lambda r: number(r, i).isNotNull() | (F.coalesce(F.get(r, (i - 1).cast("int")), F.lit("")) == "")) & F.exists("rows", lambda r: number(r, i).isNotNull())
    free = F.filter(F.sequence(F.lit(1), F.size("header")), lambda i: ~F.array_contains(F.array(*map(F.lit, (*LABELS, *symbols))), F.get("header", i - 1)) & numeric(i))
    first = F.when(F.size(free) > 0, F.struct(F.get(free, F.lit(0)).cast("long").alias("at"), F.lit("counts").alias("unit")))
    told = cells.withColumn("symbol_at", place(symbols)).withColumn("value_at", F.coalesce(known, first))
    lost = F.when(F.col("symbol_at").isNull(), F.raise_error(F.concat(F.lit("no symbol column in "), "sample"))).when(F.col("value_at").isNull(), F.raise_error(F.concat(F.lit("no usable value column in "), "sample")))
    told = told.where(F.coalesce(lost.cast("string"), F.lit("")) == "")
    if not mixed and told.select("value_at.unit").distinct().count() > 1:
        raise ValueError(f"files of different units at {path}")
    each = told.select("sample", "symbol_at", "value_at", F.explode("rows").alias("row"))
    each = each.select("sample", F.upper(F.trim(F.get("row", (F.col("symbol_at") - 1).cast("int")))).alias("symbol"), number(F.col("row"), F.col("value_at.at")).alias("value"), "value_at.unit")
    good = each.where((F.col("symbol") != "") & ~F.col("symbol").startswith("N_") & F.col("value").isNotNull() & ~F.isnan("value"))
    return good.groupBy("sample", "symbol", "unit").agg(F.sum("value").alias("value")).select("sample", "symbol", "value", "unit")


def read_rows(spark: SparkSession, path: str, wanted: DataFrame, sep: str = "\t") -> DataFrame:
    """The wanted rows of a wide text table: ``feature, sample, value, rows``; lines are told by their first field before they are split.

    ``wanted`` has the features in its first column; they and the lines' first fields are compared trimmed and upper-cased. A wanted
    line with another number of values than the header fails. Rows that share a feature are averaged, null values aside, and
    ``rows`` says how many there were. Values that aren't numbers are null. Files of several parts must share one header.
    """
    lines = spark.read.text(path)
    header = lines.first()
    if header is None:
        return spark.createDataFrame([], "feature string, sample string, value double, rows long")
    names = header["value"].split(sep)[1:]
    clean = lambda c: F.upper(F.trim(c))
    asked = wanted.select(clean(F.col(wanted.columns[0])).alias("asked")).where("asked <> ''").distinct()
    own = lines.where((F.trim("value") != "") & (F.col("value") != header["value"])).withColumn("feature", clean(F.substring_index("value", sep, 1)))
    split = own.join(asked, F.col("feature") == F.col("asked"), "left_semi").select("feature", F.slice(F.split("value", sep), 2, 1 << 30).alias("values"))
    wrong = F.raise_error(F.concat(F.lit("feature "), "feature", F.lit(" has "), F.size("values").cast("string"), F.lit(f" values; expected {len(names)}")))
    checked = split.select("feature", F.when(F.size("values") == len(names), F.col("values")).otherwise(wrong.cast("array<string>")).alias("values"))
    # The outer form, as Spark would test the arrays of unwanted lines too for the inner one.
    each = checked.select("feature", F.posexplode_outer("values").alias("at", "v")).groupBy("feature", "at").agg(F.avg(F.col("v").try_cast("double")).alias("value"), F.count("*").alias("rows"))
    return each.where("at IS NOT NULL").select("feature", F.get(F.array(*map(F.lit, names)), "at").alias("sample"), "value", "rows")


def read_soft(spark: SparkSession, path: str) -> DataFrame:
    """The sections of a SOFT text: ``kind, name, attributes, columns, rows``.

    Each ``^KIND = name`` begins a record of its own, so a plain file is read in parallel; ``attributes`` has the lines ``!key = value``
    by key, repeated ones in order; ``columns`` and ``rows`` are the table between its begin and end lines, split by tabs. A
    section is one row and must fit in a task.
    """
    records = spark.read.option("lineSep", "\n^").text(path).select(F.split(F.regexp_replace("value", r"^\^", ""), "\r?\n").alias("lines")).where("lines[0] LIKE '%=%'")
    head = F.get("lines", F.lit(0))
    key = lambda x: F.trim(F.substring_index(F.substring(x, 2, 1 << 30), "=", 1))
    marks = F.filter("lines", lambda x: x.startswith("!") & (F.locate("=", x) > 0))
    pairs = F.transform(marks, lambda x: F.struct(key(x).alias("k"), F.trim(F.regexp_extract(x, r"^[^=]*=(.*)$", 1)).alias("v")))
    attributes = F.map_from_entries(F.transform(F.array_distinct(F.transform("pairs", lambda p: p["k"])), lambda k: F.struct(k, F.transform(F.filter("pairs", lambda p: p["k"] == k), lambda p: p["v"]))))
    found = lambda word: F.array_position(F.transform("lines", lambda x: x.rlike(rf"^!\w+_table_{word}\s*$")), True)
    begin, end = found("begin"), found("end")
    table = F.when(begin > 0, F.slice("lines", begin.cast("int") + 1, (F.when(end > begin, end).otherwise(F.size("lines") + 1) - begin - 1).cast("int"))).otherwise(F.array().cast("array<string>"))
    cells = F.transform(F.filter(table, lambda x: F.trim(x) != ""), lambda x: F.split(x, "\t"))
    out = records.withColumn("pairs", pairs).withColumn("table", cells)
    return out.select(
        F.trim(F.substring_index(head, "=", 1)).alias("kind"), F.trim(F.regexp_extract(head, r"^[^=]*=(.*)$", 1)).alias("name"), attributes.alias("attributes"),
        F.coalesce(F.get("table", F.lit(0)), F.array().cast("array<string>")).alias("columns"), F.slice("table", 2, 1 << 30).alias("rows"),
    )


def soft_table(sections: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """The named columns of all tables of a kind of section, with the section's name: ``name`` and the columns, null where a table lacks one."""
    each = sections.where(F.upper("kind") == kind.upper()).select("name", "columns", F.explode("rows").alias("row"))
    at = lambda c: F.array_position("columns", c).cast("int")
    return each.select("name", *[F.when(at(c) > 0, F.get("row", at(c) - 1)).alias(c) for c in columns])


def soft_phenotype(sections: DataFrame) -> DataFrame:
    """Attributes of the samples in long form: ``name, attribute, value``.

    A characteristic ``label: value`` is the attribute ``label``; other attributes lose the prefix ``Sample_``; repeated ones are
    joined by ``; ``.
    """
    each = sections.where(F.upper("kind") == "SAMPLE").select("name", F.explode("attributes").alias("k", "vs")).select("name", "k", F.posexplode("vs").alias("at", "v"))
    own = F.col("k").rlike("(?i)characteristics") & (F.locate(":", F.col("v")) > 0)
    label = F.when(own, F.trim(F.substring_index("v", ":", 1))).otherwise(F.regexp_replace("k", "^Sample_", ""))
    value = F.when(own, F.trim(F.regexp_extract("v", r"^[^:]*:(.*)$", 1))).otherwise(F.col("v"))
    told = each.select("name", label.alias("attribute"), "k", "at", value.alias("v"))
    joined = told.groupBy("name", "attribute").agg(F.sort_array(F.collect_list(F.struct("k", "at", "v"))).alias("all"))  # a sample's values of one attribute
    return joined.select("name", "attribute", F.array_join(F.transform("all", lambda x: x["v"]), "; ").alias("value"))


def leaves(listing: DataFrame, root: str, name: str = "name", children: str = "children", label: str = "label") -> DataFrame:
    """The leaves of a tree of listed datasets from ``root``: ``name, label, depth``.

    ``listing`` has a row a dataset with its name, label and array of children's names; slashes at the ends of names don't count. A
    dataset is visited once, however many list it and though it leads back to itself, at its least depth; its label is its
    own, else that of its first parent by name, else its name. Children that aren't listed are leaves without rows and left out.
    A level asks the listing and what was visited for its children's names; where these are few they go to both, and neither moves.
    """
    strip = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    known = listing.select(strip(F.col(name)).alias("name"), F.nullif(F.trim(F.col(label)), F.lit("")).alias("label"), F.transform(F.coalesce(F.col(children), F.array().cast("array<string>")), strip).alias("children"))
    known = cut(known.groupBy("name").agg(F.min("label").alias("label"), F.flatten(F.collect_list("children")).alias("children")).withColumn("children", F.array_distinct(F.filter("children", lambda c: c.isNotNull() & (c != "")))))
    level = known.where(F.col("name") == root.strip("/")).select("name", F.coalesce("label", "name").alias("label"), "children", F.lit(0).alias("depth"))
    visited, depth = [level := cut(level)], 0
    while not level.isEmpty():
        depth += 1
        asked = level.select(F.explode("children").alias("child"), F.struct(F.col("name").alias("parent"), F.col("label").alias("inherited")).alias("by"))
        asked = cut(asked.groupBy("child").agg(F.min("by").alias("by")))
        seen = cut(reduce(DataFrame.unionByName, [v.select(F.col("name").alias("seen")) for v in visited]).join(asked, F.col("seen") == F.col("child"), "left_semi"))
        found = known.join(asked.join(seen, F.col("child") == F.col("seen"), "left_anti"), F.col("name") == F.col("child"))
        level = cut(found.select("name", F.coalesce("label", "by.inherited", "name").alias("label"), "children", F.lit(depth).alias("depth")))
        visited.append(level)
        if len(visited) > VISITS:
            visited = [cut(reduce(DataFrame.unionByName, visited))]
    return reduce(DataFrame.unionByName, visited).where(F.size("children") == 0).select("name", "label", "depth")


def read_header(spark: SparkSession, path: str, sep: str = "\t") -> list[str]:
    """The column names of a wide text table, from its first line alone."""
    return spark.read.text(path).first()["value"].split(sep)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A manifest or configuration in JSON."""
    return spark.read.option("multiLine", True).json(path)


def melt(df: DataFrame, keys: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    """A wide table in long form; values become doubles."""
    own = [c for c in df.columns if c not in keys]
    return df.select(*keys, *[F.col(c).cast("double") for c in own]).unpivot(keys, own, name, value)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV folder with headers."""
    df.write.option("header", True).csv(path)


def write_sets(members: DataFrame, path: str, name: str = "module", item: str = "feature") -> None:
    """Gene-set text: a line a set with its name, a description and its items in order."""
    sets = members.groupBy(name).agg(F.array_sort(F.collect_set(item)).alias("items"))
    sets.select(F.concat_ws("\t", F.col(name), F.lit("na"), F.concat_ws("\t", "items")).alias("value")).write.text(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, length and sha256 of each file at a path."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


def verify(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Each expected file with its status: ok, changed or missing."""
    own = found.select("name", F.col("sha256").alias("__sha"))
    status = F.when(F.col("__sha").isNull(), "missing").when(F.col("__sha") != F.col("sha256"), "changed").otherwise("ok")
    return expected.join(own, "name", "left").select("name", status.alias("status"))
