"""Names, show ids and glossaries on literal cases and against plain Python."""

from pyspark.sql import functions as F

from chronotext.operators import names


def plain_id(url):
    a, b = names.SEED_A, names.SEED_B
    for c in map(ord, url):
        a = (a ^ c) * names.STEP_A & names.MASK
        b = ((b ^ c) * names.STEP_B & names.MASK) ^ (b >> 13)
    return f"{a:08x}{b:08x}"[:12]


def test_show_id(spark):
    urls = ["https://a.example/feed", "https://b.example/x?y=1", "https://long.example/" + "z" * 200]
    frame = spark.createDataFrame([(u,) for u in [*urls, "http://a.example/feed/#top"]], "u string")
    assert [r[0] for r in frame.select(names.show_id(F.col("u"))).collect()] == [plain_id(u) for u in [*urls, urls[0]]]


def test_hosts_and_glossary(spark):
    titles = ["The Ezra Klein Show", "Plain English with Derek Thompson", "The Daily Show", "News", None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in titles], "t string").select(names.host_from_show(F.col("t"))).collect()] == ["Ezra Klein", "Derek Thompson", None, None, None]
    lines = spark.createDataFrame([("Tidewater; Sayosh = Sayash\n box -> Box",)], "t string").select(names.glossary_lines(F.col("t"))).first()[0]
    assert [(x["wrong"], x["right"]) for x in lines] == [(None, "Tidewater"), ("Sayosh", "Sayash"), ("box", "Box")]


def test_variants(spark):
    terms = [("e", "Sayash", 9), ("e", "Sayosh", 3), ("e", "Sayyash", 1), ("e", "Berlin", 5), ("e", "Berliner", 2), ("e", "Arvind", 4)]
    rows = names.name_groups(spark.createDataFrame(terms, "k string, term string, n int"), "k").collect()
    assert {(r["term"], r["best"]) for r in rows} == {("Sayash", "Sayash"), ("Sayosh", "Sayash"), ("Sayyash", "Sayash")}


def test_correction(spark):
    texts = ["I asked Sayosh Kapoor, twice.", "tide water flows", "nothing here", None, ""]
    out = names.corrected(spark.createDataFrame([(t,) for t in texts], "t string"), "t", ["Sayash Kapoor", "Tidewater"], {"twice": "again"}, "c").collect()
    assert [r["c"] for r in out] == ["I asked Sayash Kapoor, again.", "Tidewater flows", "nothing here", None, ""]
