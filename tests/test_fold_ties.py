from tessella.operators import resampling


def test_rows_of_one_draw_go_by_number_in_repeats(spark):
    # Both have the draw 067f0941 of md5 of "s|1|id", and as text the larger one comes first.
    rows = spark.createDataFrame([(127740, 1), (46598, 1)], "id long, y int")
    found = {r["id"]: r["fold"] for r in resampling.repeated_folds(rows, "id", "y", 2, 1, "s").collect()}
    assert found == {46598: 0, 127740: 1}
