from tessella.operators import models


def test_permuted_outcomes_write_no_replicates(spark, monkeypatch):
    written = []

    def counted(df):
        out = cut(df)
        written.append("time" in out.columns and "rep" in out.columns)
        return out

    cut = models.cut
    monkeypatch.setattr(models, "cut", counted)
    rows = spark.createDataFrame([(i, i * 10) for i in range(40)], "id long, time long")
    found = models.permute_outcomes(rows, "id", ["time"], 3, "s").collect()
    assert not any(written)
    for rep in (1, 2, 3):
        own = [r for r in found if r["rep"] == rep]
        assert sorted(r["id"] for r in own) == list(range(40)) and sorted(r["time"] for r in own) == list(range(0, 400, 10))
