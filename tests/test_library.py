"""Feeds with all their fields, cues of sponsor reads, glossary correction, library rules and token parts on literal cases."""

import random

from pyspark.sql import functions as F

from chronotext.functions import text as tx
from chronotext.operators import folds, library, names, speech
from chronotext.sources import feeds

FEED = """<rss><channel><image><url>https://img/old.jpg</url><title>Image</title></image><title>Abels t&#229;rn</title><language>nb-NO</language>
<description><![CDATA[Sp&oslash;rsm&aring;l om <b>vitenskap</b>.]]></description><itunes:author>NRK</itunes:author><itunes:image href="https://img/show.jpg"/>
<item><title>Hvorfor er himmelen bl&#xe5;?</title><guid>n-1</guid><pubDate>Fri, 06 Nov 2026 05:00:00 GMT</pubDate><enclosure url="https://cdn/1.mp3?a=1&amp;b=2" type="audio/mpeg"/>
<description>&lt;p&gt;Kort&lt;/p&gt;</description><content:encoded><![CDATA[<p>Tre forskere svarer. <a href="https://n.no/a">Les mer</a></p>]]></content:encoded><itunes:season>4</itunes:season>
<podcast:chapters url="https://cdn/1.json"/><psc:chapter start="00:01" title="En"/></item>
<item><guid>n-0</guid><pubDate>Fri, 06 Nov 2026 05:00:00 GMT</pubDate><enclosure url='https://cdn/0.mp3' type='audio/mpeg'/><itunes:image href="https://img/show.jpg"/></item>
<item><title>None</title><guid>n-x</guid><enclosure url="https://cdn/x.pdf" type="application/pdf"/></item>
<item><title>Nyeste</title><guid>n-2</guid><pubDate>Sat, 07 Nov 2026 05:00:00 GMT</pubDate><enclosure url="https://cdn/2.m4a"/><itunes:image href="https://img/2.jpg"/></item></channel></rss>"""


def test_a_feed_gives_its_show_and_its_episodes(spark):
    df = spark.createDataFrame([(1, FEED), (2, None), (3, "")], "k int, xml string")
    show = feeds.shows(df, "k").filter("k = 1").first()
    assert (show.title, show.art, show.author, show.description, show.language) == ("Abels tårn", "https://img/show.jpg", "NRK", "Spørsmål om vitenskap.", "nb-NO")
    rows = feeds.newest_first(feeds.episodes(df, "k"), "k").orderBy("k", "place").collect()
    assert [r.guid for r in rows] == ["n-2", "n-1", "n-0"]
    assert [r.art for r in rows] == ["https://img/2.jpg", None, None]
    assert [r.title for r in rows] == ["Nyeste", "Hvorfor er himmelen blå?", "Untitled episode"]
    assert (rows[1].url, rows[1].season, rows[1].chapters, rows[1].summary) == ("https://cdn/1.mp3?a=1&b=2", 4, "https://cdn/1.json", "Tre forskere svarer. Les mer")
    assert [tuple(c) for c in rows[1].psc] == [("00:01", "En")]


def test_character_references(spark):
    cases = {"a &amp;lt; b": "a &lt; b", "&#229;&#xE5;&#X1F600;": "åå😀", "&bogus; &#0; &#1114112; &#xD800; & &amp": "&bogus; &#0; &#1114112; &#xD800; & &amp", "&eacute;&Aring;&trade;": "éÅ™", "": ""}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select(tx.decode_entities(F.col("t")))
    assert [r[0] for r in rows.collect()] == list(cases.values())


def test_cues(spark):
    cases = {
        "This show is sponsored by Tidewater. Their app is fine.": (2, 0, True), "A bill sponsored by two senators.": (0, 0, False), "State-sponsored by nobody": (0, 0, True),
        "Go to tidewater dot com slash steel for 10 percent off": (0, 3, False), "terms and conditions apply": (1, 0, False), "": (0, 0, False), None: (0, 0, False), "...": (0, 0, False),
    }
    t = F.col("t")
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select(tx.strong_cues(t), tx.weak_cues(t), tx.opens_ad(t)).collect()
    assert [tuple(r) for r in rows] == list(cases.values())


def test_correction_by_sound_surname_and_everyday_words(spark):
    texts = ["We use hugging phase here.", "the open air was cold", "At the Open Air office", "Tommy Petorn said so", None, "", " two  spaces "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in names.corrected(df, "t", ["Hugging Face", "OpenAI", "Tommy Vietor"], {}, "c").select("c").collect()]
    assert got[0] == "We use Hugging Face here."
    assert got[1] == "the open air was cold"
    assert got[2] == "At the OpenAI office"
    assert got[3:] == ["Tommy Vietor said so", None, "", " two  spaces "]


def plain_loops(words, longest=8):
    """The shortest unit that is said three times or more from a place on is cut to two copies, place by place."""
    out, i = [], 0
    while i < len(words):
        units = [(n, next(k for k in range(1, len(words) + 2) if words[i + k * n : i + k * n + n] != words[i : i + n])) for n in range(1, longest + 1) if i + n <= len(words)]
        n, times = next(((n, k) for n, k in units if k > 2), (1, 1))
        out += words[i : i + min(times, 2) * n]
        i += times * n
    return out


def test_loops_against_plain_python():
    draw = random.Random(5)
    for _ in range(400):
        words = [draw.choice("ab c"[: draw.randint(1, 4)].split()[0]) for _ in range(draw.randint(0, 30))]
        words = [w if draw.random() < 0.8 else "x" for w in words] * draw.randint(1, 3)
        assert folds.loops_out(" ".join(words)).split() == plain_loops(words)


def test_token_parts_and_echo(spark):
    rows = [("w", i, t) for i, t in enumerate([1000, 5, 6, 1100, 1150, 7, 1140, 8, None])]
    got = speech.token_parts(spark.createDataFrame(rows, "k string, pos int, token int"), ["k"], 1000, 30.0).orderBy("start", "part").collect()
    assert [(round(r.start, 2), round(r.end, 2), list(r.tokens), r.open) for r in got] == [(0.0, 2.0, [5, 6], False), (2.8, 30.0, [8], True), (3.0, 3.0, [7], False)]
    t = spark.createDataFrame([("Later, Kapoor said", "later kapoor said it"), ("short", "short"), ("go on go on go on go on go on", ""), ("", "x"), (None, None)], "t string, p string")
    assert [r[0] for r in t.select(speech.echoed(F.col("t"), F.col("p"))).collect()] == [True, False, True, False, False]


def test_library_rules(spark):
    held = spark.createDataFrame([(1, "a", "A", False, 10), (2, "b", "B", True, 20)], "id int, feed_url string, title string, gone boolean, added_at long")
    asked = spark.createDataFrame([(1, "a2", None), (2, None, None), (3, "c", "C"), (3, "c", "C")], "id int, feed_url string, title string")
    got = {r.id: (r.feed_url, r.title, r.added_at) for r in library.follow(held, asked, 99).collect()}
    assert got == {1: ("a2", "A", 10), 2: ("b", "B", 99), 3: ("c", "C", 99)}
    assert [r.id for r in library.unfollow(held, asked, 99).orderBy("id").collect()] == [1, 2]
    names_of = spark.createDataFrame([("Later Sayosh Kapoor",), ("So well",), ("Nora",), (None,)], "t string").select(tx.trim_starters(F.col("t")))
    assert [r[0] for r in names_of.collect()] == ["Sayosh Kapoor", "well", "Nora", None]
