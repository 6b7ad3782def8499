"""Ties and nulls that once were left to chance or failed a job."""

from chronotext.operators import folds, intervals


def test_rows_at_the_same_time_are_chosen_by_their_values(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 1.0), (2, 9.0)], "k int, at double")
    right = spark.createDataFrame([(1, 3.0, "a"), (1, 3.0, "c"), (1, 3.0, "b"), (2, 9.0, None), (2, 9.0, "z")], "k int, at double, v string")
    got = {(r["k"], r["at"]): r["v"] for r in intervals.asof_last(left, right.repartition(5), ["k"], "at", ["v"]).collect()}
    assert got == {(1, 5.0): "c", (1, 1.0): None, (2, 9.0): "z"}


def test_null_vectors_are_left_out(spark):
    rows = [(1, 0, [1.0, 0.0], 3.0), (1, 1, None, 3.0), (1, 2, [1.0, 0.1], 3.0), (2, 0, None, 3.0)]
    frame = spark.createDataFrame(rows, "e int, seq int, v array<double>, seconds double")
    assert [(r["seq"], r["voice"]) for r in folds.online_voices(frame, "e").orderBy("seq").collect()] == [(0, 0), (2, 0)]
    assert [(r["seq"], r["cluster"]) for r in folds.clusters(frame.drop("seconds"), "e").orderBy("seq").collect()] == [(0, 0), (2, 0)]
