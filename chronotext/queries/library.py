"""Queries over the rules of a personal library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.operators import library as lib
from chronotext.queries.registry import query
from chronotext.session import table

NOW = 1_706_659_200_000
HELD = "held AS (SELECT c_custkey AS id, c_name AS title, 'https://feeds.example/' || c_custkey AS feed_url, c_custkey % 3 = 0 AS gone, c_custkey * 10 AS added_at FROM customer WHERE c_custkey % 5 <> 4)"


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as shows that were followed once; a third of them were given up."""
    rows = table(spark, sf_dir, "customer").filter("c_custkey % 5 <> 4")
    return rows.select(F.col("c_custkey").alias("id"), F.concat(F.lit("https://feeds.example/"), F.col("c_custkey")).alias("feed_url"), F.col("c_name").alias("title"), (F.col("c_custkey") % 3 == 0).alias("gone"), (F.col("c_custkey") * 10).alias("added_at"))


@query(f"""WITH {HELD}, asked AS (SELECT o_custkey AS id, min('https://new.example/' || o_custkey) AS feed_url FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
SELECT a.id, a.feed_url, h.title, false AS gone, CAST(CASE WHEN h.id IS NULL OR h.gone THEN {NOW} ELSE h.added_at END AS BIGINT) AS added_at, CAST({NOW} AS BIGINT) AS "at" FROM asked a LEFT JOIN held h ON h.id = a.id""")
def followed_shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: shows followed anew keep the time they were added unless they had been given up."""
    asked = table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.concat(F.lit("https://new.example/"), F.col("o_custkey")).alias("feed_url"), F.lit(None).cast("string").alias("title"))
    return lib.follow(held(spark, sf_dir), asked, NOW)


@query(f"""WITH {HELD} SELECT id, feed_url, title, true AS gone, CAST({NOW} AS BIGINT) AS "at" FROM held WHERE id IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)""")
def unfollowed_shows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: the marks that giving up leaves."""
    return lib.unfollow(held(spark, sf_dir), table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 1").select(F.col("o_custkey").alias("id")), NOW)


@query(f"""WITH n AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_totalprice AS DOUBLE) - 90000 END AS p, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey / 7 END AS d, CASE WHEN o_orderkey % 5 = 0 THEN true END AS done FROM orders),
h AS (SELECT l_orderkey AS id, max(CAST(l_quantity AS DOUBLE)) AS p, max(CAST(l_extendedprice AS DOUBLE)) AS d, bool_or(l_returnflag = 'R') AS done FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY 1)
SELECT n.id, greatest(0, floor(coalesce(n.p, h.p, 0) * 10 + 0.5) / 10) AS p, CAST(floor(coalesce(n.d, h.d, 0) + 0.5) AS BIGINT) AS d, coalesce(n.done, h.done, false) AS done, CAST({NOW} AS BIGINT) AS "at" FROM n LEFT JOIN h ON h.id = n.id""")
def positions_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3: positions written over held ones, field by field."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    news = o.select(k.alias("id"), F.when(k % 4 != 0, F.col("o_totalprice").cast("double") - 90000).alias("p"), F.when(k % 3 == 0, k / 7).alias("d"), F.when(k % 5 == 0, True).alias("done"))
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 2 = 0").groupBy(F.col("l_orderkey").alias("id"))
    had = lines.agg(F.max(F.col("l_quantity").cast("double")).alias("p"), F.max(F.col("l_extendedprice").cast("double")).alias("d"), F.bool_or(F.col("l_returnflag") == "R").alias("done"))
    return lib.set_progress(had, news, "id", NOW)


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'english' END AS language, CASE WHEN c_custkey % 6 = 0 THEN '2' ELSE '1' END AS speed, CASE WHEN c_custkey % 2 = 0 THEN 'yes' END AS own FROM customer""")
def settings_overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings read from JSON over the defaults; broken JSON and nulls leave the defaults."""
    k = F.col("c_custkey")
    text = F.when(k % 6 == 0, F.concat(F.lit('{"language":"'), F.col("c_mktsegment"), F.lit('","speed":"2","own":"yes"}'))).when(k % 2 == 0, F.concat(F.lit('{"language":"'), F.col("c_mktsegment"), F.lit('","speed":null,"own":"yes"}'))).when(k % 3 == 0, "{broken")
    merged = table(spark, sf_dir, "customer").select("c_custkey", lib.settings(F.from_json(text, "map<string,string>"), {"language": "english", "speed": "1"}).alias("s"))
    return merged.select("c_custkey", *(F.try_element_at("s", F.lit(c)).alias(c) for c in ("language", "speed", "own")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_custkey = 0 THEN true ELSE o_custkey * 1000000 - o_custkey % 3 - (CASE WHEN o_orderkey % 3 = 0 THEN 80000000 ELSE o_orderkey % 5000 * 16000 END) >= greatest(500000000, o_custkey * 1000000 * 0.1) END AS room FROM orders""")
def room_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an episode fits beside the reserve."""
    k = F.col("o_orderkey")
    size = F.when(k % 3 == 0, lib.size_of(F.lit(0))).otherwise(k % 5000 * 16000)
    return table(spark, sf_dir, "orders").select("o_orderkey", lib.room_for(F.when(k % 7 != 0, F.col("o_custkey") * 1_000_000), F.col("o_custkey") % 3, size).alias("room"))


@query("""SELECT p_partkey, p_name FROM part ORDER BY lower(p_name), p_partkey LIMIT 200""")
def shows_by_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O1: the first 200 titles of a list; every other one is in capitals, which does not move it."""
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("t"))
    return lib.by_title(rows, "t", "p_partkey").select("p_partkey", "p_name").limit(200)


@query("""SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 6000""")
def newest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 6000 positions stay."""
    return lib.newest_kept(table(spark, sf_dir, "events"), 6000, "ts", "event_id").select("event_id")
