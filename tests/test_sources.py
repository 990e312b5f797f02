"""Readers on made files: counts by their own columns, wanted rows of wide tables, SOFT sections, trees of datasets."""

import gzip

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import evidence
from tessella.sources import tables


def test_counts(spark, tmp_path):
    (tmp_path / "s1.counts.tsv").write_text("# model: x\ngene_id\tgene_name\tgene_type\tunstranded\ttpm_unstranded\nE1\t tp53 \tp\t5\t1.5\nE2\tTP53\tp\t1\t2.5\nE3\tN_unmapped\tp\t9\t9\nE4\tMYC\tp\t1\tNA\nE5\t\tp\t1\t1\n")
    with gzip.open(tmp_path / "s2.tsv.gz", "wt") as out:
        out.write("gene_name\ttpm_unstranded\nMYC\t4\n")
    rows = {(r["sample"], r["symbol"]): (r["value"], r["unit"]) for r in tables.read_counts(spark, str(tmp_path)).collect()}
    assert rows == {("s1", "TP53"): (4.0, "TPM"), ("s2", "MYC"): (4.0, "TPM")}
    (tmp_path / "s3.tsv").write_text("symbol\tnote\tother\tmore\nMYC\tx\t7\t1\nTP53\ty\t\t1\n")
    with pytest.raises(ValueError):
        tables.read_counts(spark, str(tmp_path))
    third = tables.read_counts(spark, str(tmp_path), mixed=True).where("sample = 's3'").collect()
    assert [(r["symbol"], r["value"], r["unit"]) for r in third] == [("MYC", 7.0, "counts")]
    other = tmp_path / "odd"
    other.mkdir()
    (other / "s4.tsv").write_text("symbol\tnote\nMYC\tx\n")
    with pytest.raises(PySparkException):
        tables.read_counts(spark, str(other)).collect()


def test_wanted_rows(spark, tmp_path):
    path = str(tmp_path / "wide.tsv.gz")
    with gzip.open(path, "wt") as out:
        out.write("gene\tc1\tc2\tc3\n tp53\t1\t2\t3\nMYC\t1\t1\t1\n\nTP53\t3\t4\tx\nbad\t1\t2\n")
    wanted = spark.createDataFrame([("Tp53 ",), ("absent",), (None,)], "g string")
    rows = {(r["feature"], r["sample"]): (r["value"], r["rows"]) for r in tables.read_rows(spark, path, wanted).collect()}
    assert rows == {("TP53", "c1"): (2.0, 2), ("TP53", "c2"): (3.0, 2), ("TP53", "c3"): (3.0, 2)}
    with pytest.raises(PySparkException, match="expected 3"):
        tables.read_rows(spark, path, spark.createDataFrame([("BAD",)], "g string")).collect()
    empty = tmp_path / "empty.tsv"
    empty.write_text("")
    assert tables.read_rows(spark, str(empty), wanted).count() == 0


SOFT = """^DATABASE = GeoMiame
!Database_name = Omnibus
^SERIES = GSE1
!Series_title = A = B
^PLATFORM = GPL1
!Platform_title = chip
#ID = probe
!platform_table_begin
ID\tGene Symbol
p1\tTP53
p2\tMYC /// X
!platform_table_end
^SAMPLE = GSM1
!Sample_title = first
!Sample_characteristics_ch1 = age: 12 months
!Sample_characteristics_ch1 = group: good
!Sample_channel = a
!Sample_channel = b
!sample_table_begin
ID_REF\tVALUE
p1\t1.5
p2\t2
!sample_table_end
^SAMPLE = GSM2
!Sample_title = second
!sample_table_begin
VALUE\tID_REF
3\tp1
!sample_table_end
"""


@pytest.mark.parametrize("suffix", ["soft", "soft.gz"])
def test_soft(spark, tmp_path, suffix):
    path = tmp_path / f"family.{suffix}"
    (gzip.open(path, "wt") if suffix.endswith("gz") else open(path, "w")).write(SOFT)
    import gc

    gc.collect()
    sections = tables.read_soft(spark, str(path))
    assert [(r["kind"], r["name"]) for r in sections.orderBy("kind", "name").collect()] == [("DATABASE", "GeoMiame"), ("PLATFORM", "GPL1"), ("SAMPLE", "GSM1"), ("SAMPLE", "GSM2"), ("SERIES", "GSE1")]
    assert sections.where("kind = 'SERIES'").first()["attributes"] == {"Series_title": ["A = B"]}
    values = tables.soft_table(sections, "sample", ["ID_REF", "VALUE", "absent"])
    assert sorted(map(tuple, values.collect())) == [("GSM1", "p1", "1.5", None), ("GSM1", "p2", "2", None), ("GSM2", "p1", "3", None)]
    assert sorted(map(tuple, tables.soft_table(sections, "PLATFORM", ["ID", "Gene Symbol"]).collect())) == [("GPL1", "p1", "TP53"), ("GPL1", "p2", "MYC /// X")]
    told = {(r["name"], r["attribute"]): r["value"] for r in tables.soft_phenotype(sections).collect()}
    assert told == {("GSM1", "title"): "first", ("GSM1", "age"): "12 months", ("GSM1", "group"): "good", ("GSM1", "channel"): "a; b", ("GSM2", "title"): "second"}


def test_leaves(spark):
    rows = [("root/", "R", ["/a", "b", "gone"]), ("a", None, ["c", "root"]), ("b", "B", ["c", "d", ""]), ("c", None, []), ("d", " ", None), ("alone", "x", []), ("e", None, ["e"])]
    listing = spark.createDataFrame(rows, "name string, label string, children array<string>")
    assert sorted(map(tuple, tables.leaves(listing, "root").collect())) == [("c", "R", 2), ("d", "B", 2)]
    assert tables.leaves(listing, "e").count() == 0 and tables.leaves(listing, "nowhere").count() == 0


def test_small_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,2\n")
    (tmp_path / "b.csv").write_text("id,v\n3,4\n")
    (tmp_path / "t.tsv").write_text("# note\nid\tv\n1\t2\n")
    (tmp_path / "m.json").write_text('{"a": [1, 2]}')
    schema = "id int, v int"
    assert tables.read_first(spark, [str(tmp_path / "x*.csv"), str(tmp_path / "a.csv")], schema).collect() == [(1, 2)]
    with pytest.raises(FileNotFoundError):
        tables.read_first(spark, [str(tmp_path / "x*.csv")], schema)
    assert sorted(map(tuple, tables.read_samples(spark, str(tmp_path / "*.csv"), schema).collect())) == [(1, 2, "a"), (3, 4, "b")]
    assert tables.read_tsv(spark, str(tmp_path / "t.tsv"), schema).collect() == [(1, 2)]
    assert tables.read_header(spark, str(tmp_path / "a.csv"), ",") == ["id", "v"] and tables.read_json(spark, str(tmp_path / "m.json")).first()["a"] == [1, 2]
    assert tables.read_csv(spark, str(tmp_path / "none.csv"), schema, optional=True).count() == 0
    sets = spark.createDataFrame([("m", "b"), ("m", "a"), ("n", "c")], "module string, feature string")
    tables.write_sets(sets, str(tmp_path / "sets"))
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "sets")).collect()) == ["m\tna\ta\tb", "n\tna\tc"]
    words = spark.createDataFrame([(" Yes",), ("n",), ("maybe",), (None,), ("1",)], "x string")
    assert [r[0] for r in words.select(text.yes_no(F.col("x"))).collect()] == [1, 0, None, None, 1]
    long = spark.createDataFrame([(i, f, v) for i in range(3) for f, v in (("a", i), ("b", i), ("c", 2 * i))], "id int, f string, v int")
    assert evidence.duplicate_columns(long, "id", "f", "v").collect() == [("b", "a")]
