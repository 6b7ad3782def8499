"""Queries over file formats: feeds, OPML and chapters are written from tables and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.functions import fixed
from chronotext.functions import text as tx
from chronotext.queries.registry import query
from chronotext.session import table
from chronotext.sources import feeds, mpeg


@query("""SELECT c_custkey AS id, c_name AS title, 'https://feeds.example/' || c_custkey AS url FROM customer""")
def opml_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as OPML files of fifty subscriptions, some of them twice, and the entries read back."""
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 50).alias("file"), F.col("c_name").alias("title"), F.concat(F.lit("https://feeds.example/"), "c_custkey").alias("url"))
    twice = rows.filter("title LIKE '%7'").withColumn("title", F.concat("title", F.lit(" again")))
    found = feeds.read_opml(feeds.write_opml(rows.unionByName(twice), "file"), "file")
    return found.select(F.element_at(F.split("url", "/"), -1).cast("long").alias("id"), "title", "url")


def part_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as podcast feeds: for each brand one of the parts of twenty thousand keys."""
    part = table(spark, sf_dir, "part").withColumn("show", F.concat_ws("-", "p_brand", F.floor(F.col("p_partkey") / 20_000).cast("string")))
    k = F.col("p_partkey")
    day = F.date_format(F.date_add(F.lit("2026-01-01").cast("date"), (k % 90).cast("int")), "d MMM yyyy")
    image = F.when(k % 3 == 0, '<itunes:image href="https://img.example/show.jpg"/>').when(k % 3 == 1, F.concat(F.lit('<itunes:image href="https://img.example/'), k, F.lit('.jpg"/>'))).otherwise("")
    psc = F.when(k % 4 == 0, '<psc:chapters><psc:chapter start="0" title="Start"/><psc:chapter start="00:05:00" title="Q &amp; A"/></psc:chapters>').otherwise("")
    item = F.concat(
        F.lit("<item><title>"), tx.escape_xml(F.concat("p_name", F.lit(" & co"))), F.lit("</title><guid>g"), k, F.lit('</guid><enclosure type="Audio/MPEG" url="https://cdn.example/'), k, F.lit('.mp3"/><itunes:duration>'), F.col("p_size"),
        F.lit(":00</itunes:duration><pubDate>Thu, "), day, F.lit(" 05:00:00 GMT</pubDate><itunes:season>"), k % 5, F.lit("</itunes:season><itunes:episodeType>Full</itunes:episodeType><description>&lt;p&gt;Short&lt;/p&gt;</description>"),
        F.lit("<content:encoded><![CDATA[<p>About "), F.col("p_type"), F.lit(" &amp; more</p>]]></content:encoded>"), image, psc, F.lit("</item>"),
    )
    other = '<item><title>No sound</title><enclosure url="https://cdn.example/x.pdf" type="application/pdf"/></item>'
    head = F.concat(F.lit("<rss><channel><image><title>Image</title><url>https://img.example/old.jpg</url></image><title>Show &#38; "), "show", F.lit('</title><language>nb-NO</language><itunes:author>A</itunes:author><itunes:image href="https://img.example/show.jpg"/>'), F.lit(other))
    body = F.array_join(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("i")))).getField("i"), "")
    return part.groupBy("show").agg(body.alias("_b")).select("show", F.concat(head, "_b", F.lit("</channel></rss>")).alias("xml"))


@query("""SELECT p_brand || '-' || p_partkey // 20000 AS show, 'g' || p_partkey AS guid, p_name || ' & co' AS title, 'https://cdn.example/' || p_partkey || '.mp3' AS url, CAST(p_size AS DOUBLE) * 60 AS seconds, 'audio/mpeg' AS type, 'nb-NO' AS language, 'About ' || p_type || ' & more' AS summary,
  CASE WHEN p_partkey % 3 = 1 THEN 'https://img.example/' || p_partkey || '.jpg' END AS art, CAST(p_partkey % 5 AS INTEGER) AS season, 'full' AS kind, CASE WHEN p_partkey % 4 = 0 THEN 'Start|Q & A' ELSE '' END AS psc,
  CAST(row_number() OVER (PARTITION BY p_brand, p_partkey // 20000 ORDER BY p_partkey % 90 DESC, p_partkey) - 1 AS INTEGER) AS place FROM part""")
def feed_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds parsed back into episodes, newest first."""
    found = feeds.newest_first(feeds.episodes(part_feeds(spark, sf_dir), "show"), "show")
    return found.select("show", "guid", "title", "url", "seconds", "type", "language", "summary", "art", "season", "kind", F.array_join(F.col("psc.title"), "|").alias("psc"), "place")


@query("""SELECT DISTINCT p_brand || '-' || p_partkey // 20000 AS show, 'Show & ' || p_brand || '-' || p_partkey // 20000 AS title, 'https://img.example/show.jpg' AS art, 'nb-NO' AS language, 'A' AS author FROM part""")
def feed_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What feeds say of their shows."""
    return feeds.shows(part_feeds(spark, sf_dir), "show").select("show", "title", "art", "language", "author")


@query("""SELECT o_custkey AS episode, count(*) AS n, CAST(min(s) AS DOUBLE) AS first FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 90 - 90 AS s FROM orders) GROUP BY o_custkey HAVING count(*) >= 3""")
def chapters_from_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters from lines of notes: at least three, rising, the first within five minutes."""
    from pyspark.sql.window import Window

    from chronotext.functions.times import clock

    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    lines = table(spark, sf_dir, "orders").select("o_custkey", (k * 90 - 90).alias("s")).withColumn("line", F.concat(F.lit("<p>"), clock(F.col("s")), F.lit(" - Part</p>")))
    notes = lines.groupBy(F.col("o_custkey").alias("episode")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("s", "line"))).getField("line"), "").alias("html"))
    found = notes.withColumn("chapters", feeds.note_chapters(F.col("html"))).filter(F.size("chapters") > 0)
    return found.select("episode", F.size("chapters").cast("long").alias("n"), F.col("chapters")[0]["start"].alias("first"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, 5 + event_id % 8 AS i, event_id % 2 AS pad FROM events),
l AS (SELECT *, 144000 * ([32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320])[i] // 44100 + pad AS n, CASE WHEN k % 10 = 7 THEN 3 ELSE 0 END AS junk FROM e),
p AS (SELECT *, sum(n + junk) OVER (PARTITION BY user_id ORDER BY k) - n - junk AS place, count(*) OVER (PARTITION BY user_id) AS frames FROM l)
SELECT CAST(user_id AS VARCHAR) AS path, k AS frame, CAST(place AS BIGINT) AS place, 1152 AS samples, 44100 AS rate FROM p WHERE frames >= 50""")
def mpeg_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of a file for each user, whose events are frames of their own bit rates, some with junk behind."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    e = table(spark, sf_dir, "events").select("user_id", k.alias("k"), (5 + F.col("event_id") % 8).cast("int").alias("i"), (F.col("event_id") % 2).alias("pad"))
    kbps = F.element_at(F.array(*map(F.lit, fixed.MPEG_KBPS[1, 3])), F.col("i") + 1)
    size = F.floor(144_000 * kbps / 44_100) + F.col("pad")
    head = F.concat(F.lit("FFFB"), F.lpad(F.hex(F.shiftleft("i", 4) + F.shiftleft(F.col("pad").cast("int"), 1)), 2, "0"), F.lit("00"))
    frame = F.concat(head, F.repeat(F.lit("00"), (size - 4 + F.when(F.col("k") % 10 == 7, 3).otherwise(0)).cast("int")))
    whole = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("k", frame.alias("hex")))).alias("f"))
    content = F.unhex(F.array_join("f.hex", ""))
    return mpeg.frame_index(mpeg.cut_windows(whole.select(F.col("user_id").cast("string").alias("path"), content.alias("content"))))
