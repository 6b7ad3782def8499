"""Operators against literal cases, plain Python, and SQL over the smallest tables."""

import glob
import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronotext.functions import text as tx
from chronotext.functions import times as tm
from chronotext.functions import web
from chronotext.operators import folds, intervals, records, sequence
from chronotext.plans import planners
from chronotext.plans import search as plan
from chronotext.queries import reference_oracles, reference_queries
from chronotext.queries.views import segments
from chronotext.sources import feeds


def plain(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(plain, value))
    if pd.isna(value):
        return None
    if isinstance(value, (float, np.floating)):
        return int(value) if float(value).is_integer() else round(float(value), 6)
    return int(value) if isinstance(value, np.integer) else value


@pytest.mark.parametrize("name", sorted(reference_oracles()))
def test_query_equals_its_sql(spark, small, name):
    got = reference_queries()[name](spark, small).toPandas()
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(reference_oracles()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    rows = [sorted((tuple(str(plain(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))) for df in (got, want)]
    assert rows[0] == rows[1]


@pytest.mark.parametrize("name", sorted(set(reference_queries()) - set(reference_oracles())))
def test_query_without_sql_runs_alike_on_other_partitions(spark, small, name):
    first = sorted(map(str, reference_queries()[name](spark, small).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = sorted(map(str, reference_queries()[name](spark, small).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert first == again


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


def test_fold_and_clean(spark):
    assert one(spark, tx.fold, "Café CRÈME naïve Ångström") == "cafe creme naive ångstrom"
    assert one(spark, tx.fold, "Ærø, Øresund, BÅT") == "ærø, øresund, båt"
    assert one(spark, tx.fold, "“It’s” here—now") == '"it\'s" here now'
    assert one(spark, tx.clean, "  a \n b\t") == "a b"
    assert plan.fold_query("Café BÅT “x”") == 'cafe båt "x"'


def test_query_terms():
    assert [t.text for t in plan.parse_query('Box  "Steel box" tidewater.example ""')] == ["box", "steel box", "tidewater example"]
    assert [t.exact for t in plan.parse_query('Box "Steel box" ab')] == [False, True, True]
    assert plan.parse_query("") == []


def test_search_runs(spark):
    lines = [("e1", 0, "The steel"), ("e1", 1, "box was here"), ("e1", 2, "nothing"), ("e1", 3, "a boxer"), ("e1", 9, "Steel, box; steel box"), ("e2", 0, "steel only"), ("e3", 0, "box x"), ("e3", 1, "y"), ("e3", 2, "z"), ("e3", 3, "steel")]
    frame = spark.createDataFrame(lines, "episode_id string, seq int, text string")
    rows = lambda q: [(r["episode_id"], r["runs"], r["from_seq"], r["to_seq"], [(m["a"], m["b"]) for m in r["marks"]]) for r in plan.search(frame, q).orderBy("episode_id", "hit").collect()]
    assert rows('"steel box"') == [("e1", 2, 0, 1, [(4, 13)]), ("e1", 2, 9, 9, [(0, 10), (12, 21)])]
    assert rows("steel box") == [("e1", 2, 0, 1, [(4, 9), (10, 13)]), ("e1", 2, 9, 9, [(0, 5), (7, 10), (12, 17), (18, 21)])]
    assert rows("absent") == [] and rows("") == []


def test_clocks(spark):
    assert [one(spark, tm.clock, x, "double") for x in (0.0, 59.6, 3662.0, -5.0)] == ["0:00", "1:00", "1:01:02", "0:00"]
    assert one(spark, tm.stamp, 3661.5, "double") == "01:01:01,500"
    assert [one(spark, tm.parse_clock, x) for x in ("12", "1:02", "1:02:03", "1:75", "x")] == [12.0, 62.0, 3723.0, None, None]
    assert [one(spark, tm.length_text, x, "double") for x in (0.0, 58.0, 4320.0, 7200.0)] == ["", "1 min", "1 h 12 min", "2 h"]
    assert [one(spark, tm.next_speed, x, "double") for x in (1.0, 3.0)] == [1.2, 0.8]
    assert [one(spark, tm.cell_seconds, x, "double") for x in (100.0, 3600.0, 200000.0)] == [15, 120, 4200]
    assert [one(spark, tm.backoff, x, "int") for x in (0, 1, 3, 20)] == [0.0, 60000.0, 240000.0, 7200000.0]


def test_text_functions(spark):
    assert one(spark, tx.collapse_stutter, "the the cat and And I I sat, die die") == "the cat and I sat, die die"
    assert one(spark, tx.norm_title, "Xi’s Just—Not Épisode!") == "xi s just not episode"
    assert one(spark, tx.escape_markdown, "# a *b* [c]") == "\\# a \\*b\\* \\[c\\]"
    assert one(spark, tx.decode_entities, "a &lt;b&gt; &amp;amp; &#39;c&#39;") == "a <b> &amp; 'c'"
    assert one(spark, tx.strip_tags, "<p>a<b>b</b>c</p><script>var t='</p>';</script><p>d") == "abc d"
    assert one(spark, tx.summary, "<p>" + "word " * 60) == ("word " * 56).strip() + "…"
    assert one(spark, tx.note_lines, "<p>one<br>two</p><div></div>three") == ["one", "two", "three"]
    assert one(spark, tx.is_credit, "Subtitles by the Amara.org community") is True
    assert one(spark, tx.is_credit, "Subtitles by hand are rare. I make them myself every day of the year.") is False
    assert one(spark, tx.is_ad, "Use promo code HARBOUR") and one(spark, tx.is_ad, "a free trial and free shipping") and not one(spark, tx.is_ad, "a free trial")
    assert one(spark, tx.sound_key, "Phillips") == "filips"
    assert folds.loops_out("we go we go we go we go home") == "we go we go home"
    assert folds.loops_out("no no no no") == "no no"


def test_web(spark):
    assert one(spark, web.youtube_id, "https://youtu.be/abcdefghijk?t=1") == "abcdefghijk"
    assert one(spark, web.canonical_feed, " http://a.example/feed/#x") == "https://a.example/feed"
    assert [one(spark, web.is_private, h) for h in ("10.0.0.1", "localhost", "172.20.1.1", "a.example")] == [True, True, True, False]
    assert one(spark, web.audio_in_page, '<audio src="https://a.example/x.mp3">') == "https://a.example/x.mp3"
    assert one(spark, web.slug_hints, "https://a.example/show/the-best_episode.html") == ["the", "best", "episode"]


def test_frame_turns(spark):
    classes = [1] * 10 + [4, 4, 2, 0, 0] + [2] * 10
    rows = [("e", i, {1: 0, 2: 1}.get(c, -1)) for i, c in enumerate(classes)]
    got = sequence.frame_turns(spark.createDataFrame(rows, "e string, frame int, spk int"), ["e"], 0.1).orderBy("start").collect()
    assert [(r["spk"], round(r["start"], 2), round(r["end"], 2)) for r in got] == [(0, 0.0, 1.0), (1, 1.5, 2.5)]


def test_voices(spark):
    rows = [("e", 0, [1.0, 0.1, 0.0, 0.0], 5.0), ("e", 1, [0.95, 0.15, 0.05, 0.0], 5.0), ("e", 2, [0.0, 0.0, 1.0, 0.2], 5.0), ("e", 3, [0.0, 1.0, 0.0, 0.0], 1.0)]
    got = folds.online_voices(spark.createDataFrame(rows, "e string, seq int, v array<double>, seconds double"), "e").orderBy("seq").collect()
    assert [r["voice"] for r in got] == [0, 0, 1, None]


def test_stream_voices_equal_the_batch_fold(spark, small):
    q = reference_queries()
    batch, stream = (sorted((r["episode_id"], r["seq"], r["voice"]) for r in q[n](spark, small).collect()) for n in ("online_voices", "stream_voices"))
    assert [b[:2] for b in batch] == [s[:2] for s in stream]
    assert np.mean([b == s for b, s in zip(batch, stream, strict=True)]) > 0.99


def test_paragraphs_against_a_loop(spark, small):
    frame = segments(spark, small).withColumns({"speaker": F.when(F.col("seq") % 5 == 3, None).otherwise(F.col("speaker") % 2)})
    want, by = {}, {}
    for r in frame.orderBy("episode_id", "seq").collect():
        by.setdefault(r["episode_id"], []).append(r)
    for e, rows in by.items():
        k, count, last = -1, 0, None
        for r in rows:
            t = (r["text"] or "").strip()
            if not t:
                continue
            fresh = last is None
            if last is not None:
                voice = last["speaker"] is not None and r["speaker"] is not None and last["speaker"] != r["speaker"]
                carries = bool(re.match(r"[\"'“‘«„¿¡(\[]*[^\W\d_A-ZÀ-ÞŒ]", t)) or not re.search(r"[.!?…][\"'”’»)\]]*$", last["text"].strip())
                same = r["w"] == last["w"]
                fresh = voice or ((not carries or not same or count >= 225) if count >= 150 else (not same and not carries))
            if fresh:
                k, count = k + 1, 0
            count += len(re.split(r"[ \t\n\r\f\v]+", t))
            want[(e, r["seq"])] = k
            last = r
    assert {(r["episode_id"], r["seq"]): r["paragraph"] for r in folds.paragraphs(frame, "episode_id").collect()} == want


def test_merge_and_overlap(spark):
    spans = spark.createDataFrame([("a", 0.0, 5.0), ("a", 4.0, 6.0), ("a", 7.5, 8.0), ("b", 0.0, 1.0)], "k string, start double, end double")
    assert sorted(map(tuple, intervals.merge_spans(spans, ["k"], touch=1.0).collect())) == [("a", 0.0, 6.0, 2), ("a", 7.5, 8.0, 1), ("b", 0.0, 1.0, 1)]
    draw = np.random.default_rng(4)
    make = lambda n: [(int(k), float(s), float(s + w)) for k, s, w in zip(draw.integers(0, 3, n), draw.uniform(0, 100, n).round(2), draw.uniform(0.1, 40, n).round(2), strict=True)]
    a, b = make(60), make(60)
    got = intervals.overlap_join(spark.createDataFrame(a, "k int, start double, end double"), spark.createDataFrame(b, "k int, r_start double, r_end double"), ["k"], 7.0).collect()
    want = sorted((x, (y[1], y[2])) for x in a for y in b if x[0] == y[0] and x[1] < y[2] and y[1] < x[2])
    assert sorted(((r["k"], r["start"], r["end"]), (r["r_start"], r["r_end"])) for r in got) == want


def test_records(spark):
    log = spark.createDataFrame([("ep1", 1000, 1, "phone"), ("ep1", 2000, 2, "laptop"), ("queue", 1000, 3, "phone"), ("queue", 1000, 4, "laptop")], "key string, at long, rev long, who string")
    assert {(r["key"], r["who"]) for r in records.latest(log, ["key"], "at", "rev").collect()} == {("ep1", "laptop"), ("queue", "phone")}
    held = records.latest(log, ["key"], "at", "rev").drop("rev")
    assert not any(r["changed"] for r in records.apply_changes(held, held, ["key"], "at").collect())
    q = spark.createDataFrame([(["a", "b", "c"],)], "q array<string>")
    edits = q.select(*[records.edit_queue(F.col("q"), F.lit(x), p, F.lit("b")).alias(n) for n, x, p in (("last", "a", "last"), ("next", "c", "next"), ("after", "a", "after"), ("gone", "b", "remove"))]).first()
    assert list(edits) == [["b", "c", "a"], ["c", "a", "b"], ["b", "a", "c"], ["a", "c"]]


def test_admission_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("q", 1, 50.0), ("q", 2, 90.0), ("q", 3, 40.0)], "g string, n int, need double")
    assert sorted(r["n"] for r in planners.admit(rows, "g", "n", "need", 100.0).collect()) == [1, 3]


def test_order_statistics(spark):
    rows = spark.createDataFrame([(float(x),) for x in range(1, 11)], "v double")
    assert rows.agg(sequence.order_statistic(F.col("v"), 0.95), sequence.order_statistic(F.col("v"), 0.95, last=True)).first()[:] == (10.0, 9.0)


def test_feed(spark):
    xml = """<rss><channel><title>A &amp; B</title><language>nb-NO</language>
      <item><title><![CDATA[One & only]]></title><guid>g1</guid><enclosure url="https://a.example/1.mp3" type="audio/mpeg"/><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><itunes:duration>58:12</itunes:duration></item>
      <item><title>No audio</title><enclosure url="https://a.example/1.pdf" type="application/pdf"/></item>
      <item><title>Never closed</title><enclosure url="https://a.example/2.mp3" type="audio/mpeg"/>
      <item><title>Media</title><media:content url="https://a.example/3.mp4" type="video/mp4"/></item></channel></rss>"""
    rows = feeds.episodes(spark.createDataFrame([("s", xml)], "show string, xml string"), "show").orderBy("pos").collect()
    assert [(r["title"], r["guid"], r["published"], r["seconds"]) for r in rows] == [("One & only", "g1", 1704189600000, 3492.0), ("Never closed", "https://a.example/2.mp3", 0, None), ("Media", "https://a.example/3.mp4", 0, None)]
    chapters = '{"chapters":[{"startTime":0,"title":"A"},{"startTime":0.5,"title":"B"},{"startTime":60,"title":"C"},{"startTime":90,"title":"D","toc":false}]}'
    assert [(c["start"], c["title"]) for c in one(spark, feeds.json_chapters, chapters)] == [(0.0, "A"), (60.0, "C")]
    assert one(spark, feeds.note_chapters, "<p>0:00 Start</p><p>(1:30) Middle</p><p>5:00 - End</p>")[1]["title"] == "Middle"
    assert one(spark, feeds.note_chapters, "<p>0:00 Start</p><p>9:00 Middle</p><p>5:00 - End</p>") == []
