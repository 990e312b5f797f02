from tessella.sources import tables


def test_levels_of_a_tree_are_written_once(spark, monkeypatch):
    n, written = 12, []

    def counted(df):
        out = cut(df)
        written.append(out.count())
        return out

    cut = tables.cut
    monkeypatch.setattr(tables, "cut", counted)
    listing = spark.createDataFrame([(str(i), None, [str(i + 1)] if i < n else []) for i in range(n + 1)], "name string, label string, children array<string>")
    assert [tuple(r) for r in tables.leaves(listing, "0").collect()] == [(str(n), "0", n)]
    assert sum(written) < 5 * n
