"""Audio and episodes of pages: the steps in their order, structured data of any depth, links."""

import json

from pyspark.sql import functions as F

from chronotext.operators import pages


def ld(value):
    return f'<script type="application/ld+json">{json.dumps(value)}</script>'


EPISODE = {"@type": "PodcastEpisode", "name": "The Boat", "partOfSeries": {"@type": "PodcastSeries", "name": "Harbour"}, "associatedMedia": {"@type": "MediaObject", "contentUrl": "https://a.no/1.mp3"}}
CASES = {
    1: ("<meta property='og:audio' content='/x.mp3'><title>One &amp; two</title>", ("audio", "https://p.no/x.mp3", "One & two", None)),
    2: ('<meta content="Named" property="og:title"><audio controls src="b.m4a?a=1&amp;b=2"></audio>', ("audio", "https://p.no/dir/b.m4a?a=1&b=2", "Named", None)),
    3: ("<audio><source type='x' src='//c.no/d.ogg'></audio>", ("audio", "https://c.no/d.ogg", "", None)),
    4: (ld(EPISODE), ("audio", "https://a.no/1.mp3", "The Boat", "Harbour")),
    5: (ld({"@graph": [{"@type": "WebPage"}, {"deep": [[{"er": {**EPISODE, "@type": ["Thing", "RadioEpisode"]}}]]}]}), ("audio", "https://a.no/1.mp3", "The Boat", "Harbour")),
    6: (ld({"@type": "AudioObject", "url": "https://a.no/own.wav", "headline": "Own"}) + "<title>T</title>", ("audio", "https://a.no/own.wav", "Own", None)),
    7: ('<p>https:\\/\\/e.no\\/f.mp3?x=1\\u0026y=2" and https://e.no/f.mp3?x=1&y=2 ', ("audio", "https://e.no/f.mp3?x=1&y=2", "", None)),
    8: ("<a href='https://e.no/1.mp3'></a><a href='https://e.no/2.mp3'></a><link rel=x type='application/rss+xml' href='/feed'>", ("feed", "https://p.no/feed", "", None)),
    9: (ld({**EPISODE, "associatedMedia": {"contentUrl": "https://a.no/page.html"}}), None),
    10: ("<script type='application/ld+json'>{broken</script>", None),
    11: (ld([1, "x", None, {"@type": "Episode", "audio": ["ftp://no", "https://a.no/2.mp3"], "name": {"name": "Inner"}}]), ("audio", "https://a.no/2.mp3", "Inner", None)),
    12: (None, None),
    13: ("", None),
}


def test_page_audio(spark):
    frame = spark.createDataFrame([(k, "https://p.no/dir/page?q=1", h) for k, (h, _) in CASES.items()], "id int, url string, html string")
    got = {r["id"]: tuple(r)[1:] for r in pages.page_audio(frame, "id").collect()}
    assert got == {k: want for k, (_, want) in CASES.items() if want}
    assert pages.page_audio(frame.limit(0), "id").count() == 0


def test_structured_episodes(spark):
    frame = spark.createDataFrame([(k, h) for k, (h, _) in CASES.items()], "id int, html string")
    got = {r["id"]: tuple(r)[1:] for r in pages.structured_episodes(frame, "id").collect()}
    assert got[9] == (None, "The Boat", "Harbour") and got[4] == ("https://a.no/1.mp3", "The Boat", "Harbour")
    assert set(got) == {4, 5, 6, 9, 11}

    def walk(x):
        if isinstance(x, dict):
            yield x
        for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
            yield from walk(y)

    value = {"b": [{"c": 1}, [{"d": {"e": {}}}]], "a": {"f": 2}}
    found = pages.json_objects(spark.createDataFrame([(1, ld(value))], "id int, html string"), "id").collect()
    assert len(found) == len(list(walk(value))) == len({tuple(r["place"]) for r in found})


def test_links_and_feeds(spark):
    raw = {"see https://a.no/b). ": "https://a.no/b", "podcasts.apple.com/x": "https://podcasts.apple.com/x", "<https://a.no>": "https://a.no", "not a link": "", "3.14": "", None: "", "localhost:80/x": ""}
    frame = spark.createDataFrame([(k,) for k in raw], "t string").select("t", pages.repaired_link(F.col("t")).alias("link"))
    assert {r["t"]: r["link"] for r in frame.collect()} == raw
    feeds = {"<rss version='2'><channel><item>": True, "<feed xmlns='x'><entry>": True, "<rss><channel>": False, "x" * 2001 + "<rss><item>": False, None: False}
    frame = spark.createDataFrame([(k,) for k in feeds], "t string").select("t", pages.looks_like_feed(F.col("t")).alias("f"))
    assert {r["t"]: r["f"] for r in frame.collect()} == feeds
