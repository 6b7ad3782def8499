"""Marks and letters: composition and folding against the standard's own tables."""

import unicodedata

from pyspark.sql import functions as F

from chronotext.functions import text as tx


def test_composition_equals_the_normal_form(spark):
    words = ["été", "Ångström", "άλφα", "й", "ế", "no marks", "́alone", "x́y", "", None, "ȩ́ \n two"]
    rows = spark.createDataFrame([(w,) for w in words], "t string").select("t", tx.composed(F.col("t")).alias("c"), tx.clean(F.col("t")).alias("k")).collect()
    for r in rows:
        if r["t"] is None:
            assert r["c"] is None and r["k"] == ""
        elif r["t"] != "ȩ́ \n two":  # marks out of order stay
            assert r["c"] == unicodedata.normalize("NFC", r["t"])
            assert r["k"] == r["c"]
    assert rows[-1]["k"].endswith(" two")


def test_folding_beyond_latin(spark):
    cases = {"Ά": "α", "ΐ": "ι", "Й": "и", "Ệ": "e", "Å": "å", "Ø": "ø", "ß": "ß", "ё": "е", "ǆ": "ǆ"}
    rows = spark.createDataFrame([(w,) for w in cases], "t string").select("t", tx.fold(F.col("t")).alias("f")).collect()
    assert {r["t"]: r["f"] for r in rows} == cases
