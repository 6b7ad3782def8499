"""Title matching: words, numbers and the clear winner."""

from pyspark.sql import functions as F

from chronotext.functions import text as tx
from chronotext.operators import titles

EPISODES = [(1, "The fall of the harbour town"), (2, "Harbour lights and other songs"), (3, "Ep. 12: Winter at sea"), (4, "Folge 13 - Winter at sea"), (5, None), (6, "Été à la mer")]


def best(spark, title, show="Harbour Report"):
    asked = spark.createDataFrame([("f", 100, title, show)], "feed string, id int, title string, show string")
    held = spark.createDataFrame([("f", k, t) for k, t in EPISODES] + [("g", 9, title)], "feed string, other int, title string")
    rows = titles.matched_titles(asked, held, "feed").orderBy("rank").collect()
    return [r["other"] for r in rows], [r["other"] for r in rows if r["best"]]


def test_words_numbers_and_winners(spark):
    assert best(spark, "The fall of the town (official video) #podcast") == ([1], [1])
    assert best(spark, "Winter at sea") == ([3, 4], [])
    assert best(spark, "#12 Something else") == ([3], [3])
    assert best(spark, "Winter at sea, episode 14") == ([], [])
    assert best(spark, "Ete a la mer") == ([6], [6])
    assert best(spark, "Harbour Report") == ([], [])
    assert best(spark, None) == ([], [])


def test_numbers_and_words_of_titles(spark):
    cases = {"Puntata 6": 6, "#502 x": 502, "Ep 12345": None, "step 4": None, "Épisode 4": 4, "Avsnitt. 9": 9, None: None}
    frame = spark.createDataFrame([(k,) for k in cases], "t string").select("t", tx.episode_number(F.col("t")).alias("n"))
    assert {r["t"]: r["n"] for r in frame.collect()} == cases
    (row,) = spark.createDataFrame([("Sea Sea @me.no #tag The Åre 7 ab", "Åre")], "t string, s string").select(tx.key_words(F.col("t"), F.col("s")).alias("w")).collect()
    assert row["w"] == ["sea", "sea", "7"]
