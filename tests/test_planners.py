"""Pruning and refreshing by hand: what goes with a copy, a guard for an empty library, feeds never read."""

from chronotext.plans import planners

A, B, C = "a" * 16, "b" * 16, "c" * 16


def names(rows):
    return sorted(r["name"] for r in rows.collect())


def test_what_goes_with_copies_and_leftovers(spark):
    library = spark.createDataFrame([(A, f"x/{A}.mp3"), (B, f"{B}.m4a")], "id string, audio string")
    listed = [f"{A}.mp3", f"{A}.quiet.json", f"{A}.shape.json", f"{B}.m4a", f"{B}.quiet.json", f"{C}.mp3", f"{C}.quiet.json", f"{C}.shape.json", f"{B}.mp3.part"]
    files = spark.createDataFrame([(n, k) for k, n in enumerate(listed)], "name string, size long")
    copies = spark.createDataFrame([(A,), (A,)], "id string")
    leftovers = spark.createDataFrame([(f"{C}.mp3",), (f"{B}.mp3.part",)], "name string")
    assert names(planners.pruned_files(library, files, copies, leftovers)) == sorted([listed[0], listed[1], listed[2], listed[5], listed[6], listed[8]])
    assert names(planners.pruned_files(library.limit(0), files, copies, leftovers)) == []
    after = {r["id"]: r["audio"] for r in planners.pruned_library(library, copies).collect()}
    assert after == {A: None, B: f"{B}.m4a"}


def test_feeds_to_read_and_to_drop(spark):
    shows = spark.createDataFrame([(1,), (2,), (3,), (3,), (5,)], "id long")
    feeds = spark.createDataFrame([(1, 99_500), (2, 10_000), (4, 99_999), (5, None)], "id long, fetched_at long")
    got = sorted((r["id"], r["action"]) for r in planners.refresh_plan(shows, feeds, 100_000, 60).collect())
    assert got == [(2, "read"), (3, "read"), (4, "drop"), (5, "read")]
