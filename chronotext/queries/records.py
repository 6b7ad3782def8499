"""Queries over replicated records, libraries and planners."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.functions import times as tm
from chronotext.operators import records as rec
from chronotext.plans import planners
from chronotext.queries.registry import query
from chronotext.queries.views import CHANGES, changes
from chronotext.session import table

NOW = 1_706_659_200_000  # 2024-01-31, the end of the events


@query(f"""WITH {CHANGES} SELECT key, "at", rev, p, done FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at" DESC, rev) AS k FROM changes) WHERE k = 1""")
def current_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last writer wins; equal times keep the first to arrive."""
    return rec.latest(changes(spark, sf_dir).drop("user_id"), ["key"], "at", "rev")


@query(f"""WITH {CHANGES} SELECT key, max(rev) AS rev FROM changes WHERE rev > 5000 GROUP BY key""")
def changed_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, D7: what a client at revision 5000 lacks."""
    return rec.since(changes(spark, sf_dir), ["key"], "rev", 5000)


@query(f"""WITH {CHANGES}, held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at" DESC, rev) AS k FROM changes WHERE rev % 2 = 0) WHERE k = 1),
sent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at" DESC, rev) AS k FROM changes WHERE rev % 2 = 1) WHERE k = 1)
SELECT coalesce(s.key, h.key) AS key, CASE WHEN h.key IS NULL OR s.at > h.at THEN s.at ELSE h.at END AS "at", coalesce(h.key IS NULL OR s.at > h.at, false) AS changed FROM held h FULL JOIN sent s ON h.key = s.key""")
def applied_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One device's records applied to another's; which keys changed."""
    log = changes(spark, sf_dir).drop("user_id")
    held = rec.latest(log.filter("rev % 2 = 0"), ["key"], "at", "rev")
    sent = rec.latest(log.filter("rev % 2 = 1"), ["key"], "at", "rev")
    return rec.apply_changes(held, sent, ["key"], "at").select("key", "at", "changed")


@query(f"""WITH {CHANGES} SELECT key, split_part(key, '/', 1) AS map, split_part(key, '/', 2) AS id, count(*) AS n FROM changes WHERE regexp_full_match(key, '(subs|eps|progress|wants)/[\\w-]{{1,40}}') AND "at" IS NOT NULL GROUP BY key""")
def valid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose key is well formed, by map and id."""
    log = changes(spark, sf_dir).filter(F.col("key").rlike(r"^(subs|eps|progress|wants)/[\w-]{1,40}$") & F.col("at").isNotNull())
    return log.groupBy("key").agg(F.count(F.lit(1)).alias("n")).select("key", F.split_part("key", F.lit("/"), F.lit(1)).alias("map"), F.split_part("key", F.lit("/"), F.lit(2)).alias("id"), "n")


@query(f"""WITH {CHANGES}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at" DESC, rev) AS k FROM changes) WHERE k = 1)
SELECT key, CASE WHEN done THEN 'done' WHEN p > 5 THEN 'started' ELSE 'new' END AS status, CASE WHEN done THEN 1.0 ELSE round(least(1.0, greatest(0.0, p / 100)), 4) END AS fraction FROM c""")
def playback_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, started or done, and how much of it."""
    c = current_records(spark, sf_dir)
    return c.select("key", tm.status(F.col("done"), F.col("p")).alias("status"), F.round(tm.fraction(F.col("done"), F.col("p"), F.lit(0.0), F.lit(100.0)), 4).alias("fraction"))


@query(f"""WITH {CHANGES}, c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY "at" DESC, rev) AS k FROM changes) WHERE k = 1) SELECT key, "at" FROM c WHERE NOT done AND p > 5 ORDER BY "at" DESC, key LIMIT 12""")
def started_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was begun, the last touched first."""
    return current_records(spark, sf_dir).filter(~F.col("done") & (F.col("p") > 5)).orderBy(F.desc("at"), "key").limit(12).select("key", "at")


@query("""SELECT o_orderkey, o_custkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 3 OR o_orderdate >= TIMESTAMP '1998-06-01'""")
def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is recent, or among a show's newest three."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w))
    return rows.filter((F.col("k") <= 3) | (F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp"))).select("o_orderkey", "o_custkey", "o_orderdate")


@query("""SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 300""")
def inbox_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O3: the newest three hundred."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(300).select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) ORDER BY c_custkey LIMIT 30""")
def open_wants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wishes without an answer, the oldest thirty."""
    return rec.missing_from(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).orderBy("c_custkey").limit(30)


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 2""")
def newest_per_show(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two of each key."""
    return rec.top_per(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem) WHERE k = 1""")
def first_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct by key, the first stays."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return rec.first_per(rows, ["l_partkey"], "pos").select("l_partkey", "l_orderkey", "l_linenumber")


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS "show", epoch_ms(o_orderdate) AS published, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS pos FROM orders),
lib AS (SELECT id, "show", published AS created FROM f WHERE id % 5 = 0), firsts AS (SELECT "show", min(created) AS first FROM lib GROUP BY "show"),
fresh AS (SELECT f.*, first, row_number() OVER (PARTITION BY f.show ORDER BY pos) AS n FROM f LEFT JOIN firsts ON f.show = firsts.show WHERE published > 896659200000 - CAST(90 AS BIGINT) * 86400000),
every AS (SELECT id, "show", published, 0 AS rank FROM fresh WHERE CASE WHEN first IS NULL THEN n = 1 ELSE published >= first END UNION ALL SELECT id, "show", published, 1 FROM f WHERE id % 11 = 3 UNION ALL SELECT id, "show", published, 2 FROM f WHERE pos < 1),
q AS (SELECT id, any_value("show") AS "show", min(rank) AS rank, any_value(published) AS published FROM every WHERE id NOT IN (SELECT id FROM lib) GROUP BY id)
SELECT id, "show", rank, CASE WHEN rank = 2 THEN -published ELSE published END AS place FROM q""")
def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do next: new, asked for, going back."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    feeds = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("show"), F.unix_millis("o_orderdate").alias("published"), (F.row_number().over(w) - 1).alias("pos"), F.lit(1).alias("backfill"), F.lit(True).alias("fresh"))
    library = feeds.filter("id % 5 = 0").select("id", "show", F.col("published").alias("created"))
    return planners.work_queue(feeds, library, feeds.filter("id % 11 = 3").select("id"), 896_659_200_000, 90).select("id", "show", "rank", "place")


@query("""WITH lib AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN left(sha1(CAST(o_orderkey AS VARCHAR)), 16) || '.mp3' END AS audio, epoch_ms(o_orderdate) AS "at" FROM orders),
held AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderkey % 5 = 1 AND o_totalprice % 100 > 5)), files AS (SELECT audio AS name, "at" + CAST(id % 400 AS BIGINT) * 86400000 AS mtime FROM lib WHERE audio IS NOT NULL AND id % 13 > 0)
SELECT lib.id FROM lib LEFT JOIN files ON audio = name WHERE audio IS NOT NULL AND 896659200000 - "at" > CASE WHEN lib.id IN (SELECT id FROM held) THEN 3 ELSE 1 END * CAST(200 AS BIGINT) * 86400000 AND NOT coalesce(896659200000 - mtime < CAST(2 AS BIGINT) * 86400000, false)""")
def stale_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies old enough to go; queued and started ones stay three times as long."""
    orders = table(spark, sf_dir, "orders")
    library = orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.left(F.sha1(F.col("o_orderkey").cast("string")), F.lit(16)), F.lit(".mp3"))).alias("audio"), F.unix_millis("o_orderdate").alias("at"))
    queued = orders.filter("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("id"))
    progress = orders.filter("o_orderkey % 5 = 1").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice") % 100).alias("p"), F.lit(False).alias("done"))
    files = library.filter("audio IS NOT NULL AND id % 13 > 0").select(F.col("audio").alias("name"), (F.col("at") + F.col("id") % 400 * 86_400_000).alias("mtime"))
    return planners.stale_copies(library, queued, progress, files, 896_659_200_000, 200)


@query("""SELECT left(sha1(CAST(o_orderkey AS VARCHAR)), 16) || CASE WHEN o_orderkey % 10 = 0 THEN '.mp3.part' ELSE '.mp3' END AS name FROM orders WHERE (o_orderkey % 10 = 0 OR o_orderkey % 4 = 1) AND 896659200000 - epoch_ms(o_orderdate) >= CAST(2 AS BIGINT) * 86400000""")
def leftover_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that no entry lists."""
    orders = table(spark, sf_dir, "orders")
    stem = F.left(F.sha1(F.col("o_orderkey").cast("string")), F.lit(16))
    files = orders.select(F.concat(stem, F.when(F.col("o_orderkey") % 10 == 0, ".mp3.part").otherwise(".mp3")).alias("name"), F.unix_millis("o_orderdate").alias("mtime"))
    library = orders.filter("o_orderkey % 4 <> 1").select(F.concat(stem, F.lit(".mp3")).alias("audio"))
    return planners.leftover_files(files, library, 896_659_200_000)


PRUNED = """o AS (SELECT left(sha1(CAST(o_orderkey AS VARCHAR)), 16) AS id, o_orderkey AS k, 896659200000 - epoch_ms(o_orderdate) AS age FROM orders),
library AS (SELECT id, k % 3 > 0 AS audio, k % 3 > 0 AND age > CAST(200 AS BIGINT) * 86400000 AS copy FROM o WHERE k % 5 > 0),
files AS (SELECT *, id || kind AS name, k % 1000 + length(kind) AS size FROM o, (SELECT unnest(['.mp3', '.quiet.json', '.shape.json']) AS kind))"""


def _prunable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Library, files, copies and leftovers made of orders."""
    o = table(spark, sf_dir, "orders").select(F.left(F.sha1(F.col("o_orderkey").cast("string")), F.lit(16)).alias("id"), F.col("o_orderkey").alias("k"), F.unix_millis("o_orderdate").alias("at"))
    mp3, quiet, shape = (F.concat("id", F.lit(kind)) for kind in (".mp3", ".quiet.json", ".shape.json"))
    library = o.filter("k % 5 > 0").select("id", F.when(F.col("k") % 3 > 0, F.concat(F.lit("audio/"), mp3)).alias("audio"), (F.col("k") % 7).alias("quiet"), (F.col("k") % 11).alias("shape"), "at")
    files = o.select("k", F.col("at").alias("mtime"), F.explode(F.array(mp3, quiet, shape)).alias("name"))
    files = files.select("name", "mtime", (F.col("k") % 1000 + F.length("name") - 16).alias("size"))
    none = library.limit(0)
    listed = library.withColumn("audio", F.element_at(F.split("audio", "/"), -1))
    copies = planners.stale_copies(listed, none.select("id"), none.select("id", F.lit(0.0).alias("p"), F.lit(False).alias("done")), files, 896_659_200_000, 200)
    return library, files, copies, planners.leftover_files(files, listed, 896_659_200_000)


@query(f"""WITH {PRUNED}
SELECT f.name, f.size FROM files f LEFT JOIN library l ON f.id = l.id
WHERE coalesce(l.copy, false) OR (kind = '.mp3' AND NOT coalesce(l.audio, false) AND f.age >= CAST(2 AS BIGINT) * 86400000)
  OR (kind = '.quiet.json' AND l.id IS NULL AND f.age >= CAST(2 AS BIGINT) * 86400000)""")
def pruned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files that go with pruned copies and leftovers."""
    return planners.pruned_files(*_prunable(spark, sf_dir))


@query(f"""WITH {PRUNED}
SELECT l.id, CASE WHEN l.audio AND NOT copy THEN 'audio/' || l.id || '.mp3' END AS audio, CASE WHEN NOT copy THEN k % 7 END AS quiet, CASE WHEN NOT copy THEN k % 11 END AS shape
FROM library l JOIN o ON l.id = o.id""")
def pruned_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the library says after pruning."""
    library, _, copies, _ = _prunable(spark, sf_dir)
    return planners.pruned_library(library, copies).select("id", "audio", "quiet", "shape")


@query("""WITH shows AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 > 0), feeds AS (SELECT o_custkey AS id, max(epoch_ms(o_orderdate)) AS read_at FROM orders GROUP BY 1)
SELECT id, 'drop' AS action FROM feeds WHERE id NOT IN (SELECT id FROM shows)
UNION ALL SELECT s.id, 'read' FROM shows s LEFT JOIN feeds f ON s.id = f.id WHERE f.id IS NULL OR 896659200000 - read_at > CAST(90 AS BIGINT) * 86400000""")
def refresh_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feeds to read again and feeds to drop."""
    shows = table(spark, sf_dir, "customer").filter("c_custkey % 4 > 0").select(F.col("c_custkey").alias("id"))
    feeds = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.unix_millis("o_orderdate").alias("fetched_at"))
    return planners.refresh_plan(shows, feeds, 896_659_200_000, 90 * 86_400)


@query("""WITH ep AS (SELECT o_orderkey AS id, o_custkey AS "show", epoch_ms(o_orderdate) AS published FROM orders), done AS (SELECT id FROM ep WHERE id % 4 = 0), started AS (SELECT id FROM ep WHERE id % 9 = 1 AND id % 4 <> 0),
shows AS (SELECT c_custkey AS "show", c_custkey % 3 AS keep FROM customer), saved AS (SELECT id, "show", id % 2 = 0 AS auto FROM ep WHERE id % 6 < 2),
newest AS (SELECT *, row_number() OVER (PARTITION BY "show" ORDER BY published DESC, id) AS k FROM ep WHERE id NOT IN (SELECT id FROM done) AND id % 17 <> 5),
want AS (SELECT n.id, n.show FROM newest n JOIN shows s ON n.show = s.show WHERE k <= keep)
SELECT id, 'fetch' AS action FROM want WHERE id NOT IN (SELECT id FROM saved)
UNION ALL SELECT v.id, 'drop' FROM saved v LEFT JOIN shows s ON v.show = s.show WHERE auto AND v.id NOT IN (SELECT id FROM started) AND v.id % 19 <> 3
  AND CASE WHEN v.id IN (SELECT id FROM done) THEN true ELSE coalesce(keep, 0) = 0 OR v.id NOT IN (SELECT id FROM want) END""")
def download_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to fetch and what to drop."""
    ep = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("show"), F.unix_millis("o_orderdate").alias("published"), F.lit("u").alias("url"))
    progress = ep.filter("id % 4 = 0 OR id % 9 = 1").select("id", F.lit(30.0).alias("p"), (F.col("id") % 4 == 0).alias("done"))
    shows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("show"), (F.col("c_custkey") % 3).alias("keep"))
    saved = ep.filter("id % 6 < 2").select("id", "show", (F.col("id") % 2 == 0).alias("auto"))
    return planners.downloads(shows, ep, progress, ep.filter("id % 19 = 3").select("id"), saved, ep.filter("id % 17 = 5").select("id"))


@query("""WITH b AS (SELECT o_custkey AS "show", o_orderkey AS id FROM orders WHERE o_orderkey % 3 > 0), a AS (SELECT o_custkey AS "show", o_orderkey AS id, epoch_ms(o_orderdate) AS published FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY "show" ORDER BY published DESC, id) AS k FROM a WHERE "show" IN (SELECT "show" FROM b) AND id NOT IN (SELECT id FROM b) AND published > 896659200000 - CAST(400 AS BIGINT) * 86400000) SELECT "show", id, published FROM n WHERE k <= 2""")
def new_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7, ST7, O5: two readings of a feed compared."""
    after = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("show"), F.col("o_orderkey").alias("id"), F.unix_millis("o_orderdate").alias("published"))
    return planners.new_episodes(after.filter("id % 3 > 0"), after, 896_659_200_000, 2, 400)


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE event_type WHEN 'signup' THEN 'subs' WHEN 'click' THEN 'eps' WHEN 'purchase' THEN 'wants' ELSE 'progress' END AS kind, 1706659200000 - epoch_ms(ts) AS age, value > 50 AS flag FROM events)
WHERE CASE kind WHEN 'subs' THEN flag AND age > CAST(90 AS BIGINT) * 86400000 WHEN 'eps' THEN flag AND age > CAST(30 AS BIGINT) * 86400000 - 86400000 WHEN 'wants' THEN age > CAST(21 AS BIGINT) * 86400000 ELSE false END AND kind <> 'eps' GROUP BY kind""")
def forgotten_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records that are old enough to go, by kind."""
    kind = F.when(F.col("event_type") == "signup", "subs").when(F.col("event_type") == "click", "eps").when(F.col("event_type") == "purchase", "wants").otherwise("progress")
    e = table(spark, sf_dir, "events").select(kind.alias("kind"), F.unix_millis("ts").alias("at"), (F.col("value") > 50).alias("flag"))
    return e.filter(planners.forgotten(F.col("kind"), F.col("at"), F.col("flag"), F.col("flag"), NOW)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS running FROM orders) SELECT o_custkey, o_orderkey, CAST(running AS BIGINT) AS running FROM r WHERE running <= 100000000""")
def kept_within_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest first, as long as the sum fits."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    return rec.keep_within(rows, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")], "cents", 100_000_000).select("o_custkey", "o_orderkey", "running")


@query("""SELECT p_partkey, p_name, CASE WHEN p_partkey % 4 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 9 = 2""")
def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are new or differ in a column."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    after = part.withColumn("p_retailprice", F.when(F.col("p_partkey") % 4 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")))
    return rec.changed_rows(part.filter("p_partkey % 9 <> 2"), after, ["p_partkey"], ["p_name", "p_retailprice"])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'new' ELSE p_name END AS p_name FROM part UNION ALL SELECT CAST(-1 AS BIGINT), 'new'""")
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: rows replace those of the same key and join the others."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    rows = part.filter("p_partkey % 5 = 0").select("p_partkey", F.lit("new").alias("p_name")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("p_partkey"), F.lit("new").alias("p_name")))
    return rec.upsert(part, rows, ["p_partkey"])


@query("""SELECT count(*) AS queued, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(DISTINCT o_custkey) AS shows FROM orders WHERE o_orderstatus = 'O'""")
def library_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and sums of a library."""
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").agg(F.count(F.lit(1)).alias("queued"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"), F.count_distinct("o_custkey").alias("shows"))


@query("""SELECT user_id, CASE WHEN state = 'queued' AND age > 24 THEN 'failed' WHEN state = 'working' AND age > 7 THEN 'failed' ELSE state END AS status, age < 10 AS fresh FROM (
  SELECT user_id, CASE WHEN arg_max(event_type, (ts, event_id)) IN ('click', 'view') THEN 'queued' WHEN arg_max(event_type, (ts, event_id)) = 'error' THEN 'working' ELSE 'done' END AS state, CAST(floor((1706659200 - epoch(max(ts))) / 3600) AS BIGINT) AS age FROM events GROUP BY user_id)""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST9, ST10, P15: the last row of each job; those silent for too long have failed."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("t"), F.floor((F.lit(NOW // 1000) - F.unix_micros(F.max("ts")) / 1e6) / 3600).alias("age"))
    state = F.when(F.col("t").isin("click", "view"), "queued").when(F.col("t") == "error", "working").otherwise("done")
    late = ((F.col("s") == "queued") & (F.col("age") > 24)) | ((F.col("s") == "working") & (F.col("age") > 7))
    return last.withColumn("s", state).select("user_id", F.when(late, "failed").otherwise(F.col("s")).alias("status"), (F.col("age") < 10).alias("fresh"))


@query("""WITH q AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey)
SELECT o_custkey, list_concat(list_filter(ids, lambda x: x <> ids[1]), [ids[1]]) AS to_end, list_concat([ids[len(ids)]], list_filter(ids, lambda x: x <> ids[len(ids)])) AS to_front, list_filter(ids, lambda x: x <> ids[1]) AS removed FROM q""")
def queue_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue with an id moved to its end, to its front, or taken out."""
    q = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("ids"))
    first, last = F.element_at("ids", 1), F.element_at("ids", -1)
    return q.select("o_custkey", rec.edit_queue(F.col("ids"), first, "last").alias("to_end"), rec.edit_queue(F.col("ids"), last, "next").alias("to_front"), rec.edit_queue(F.col("ids"), first, "remove").alias("removed"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 10 = 0 THEN 'Named ' || c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN 'Guess ' || c_custkey END, CASE WHEN c_acctbal < 0 THEN 'Other voice' END, 'Speaker ' || (c_custkey + 1)) AS name FROM customer""")
def merged_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names set by hand, then guessed ones, then the folded voices, else a number."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    by_hand = c.filter("c_custkey % 10 = 0").select("c_custkey", F.concat(F.lit("Named "), "c_custkey").alias("set"))
    guessed = c.filter("c_custkey % 3 = 0").select("c_custkey", F.concat(F.lit("Guess "), "c_custkey").alias("guess"))
    joined = c.join(by_hand, "c_custkey", "left").join(guessed, "c_custkey", "left")
    return joined.select("c_custkey", F.coalesce("set", "guess", F.when(F.col("c_acctbal") < 0, "Other voice"), F.concat(F.lit("Speaker "), F.col("c_custkey") + 1)).alias("name"))


@query("""WITH RECURSIVE q AS (SELECT o_custkey, o_orderkey, CAST(20 + o_orderkey % 83 AS DOUBLE) AS need, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders),
s AS (SELECT o_custkey, o_orderkey, k, 120 - need AS remains, true AS taken FROM q WHERE k = 1 UNION ALL
  SELECT q.o_custkey, q.o_orderkey, q.k, CASE WHEN need <= remains THEN remains - need ELSE remains END, need <= remains FROM s JOIN q ON q.o_custkey = s.o_custkey AND q.k = s.k + 1)
SELECT o_custkey, o_orderkey FROM s WHERE taken""")
def admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: what fits into the time left, in order, passing over what does not."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (20 + F.col("o_orderkey") % 83).cast("double").alias("need"))
    return planners.admit(rows, "o_custkey", "o_orderkey", "need", 120.0)


@query("""SELECT n_nationkey, min_by(s_suppkey, (CASE WHEN s_suppkey % 7 = 0 THEN 0 WHEN s_acctbal > 5000 THEN 1 ELSE 2 END, s_suppkey)) AS chosen FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey""")
def feed_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact match first, then a partial one, else the first."""
    joined = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    rank = F.when(F.col("s_suppkey") % 7 == 0, 0).when(F.col("s_acctbal") > 5000, 1).otherwise(2)
    return joined.groupBy("n_nationkey").agg(F.min_by("s_suppkey", F.struct(rank, "s_suppkey")).alias("chosen"))
