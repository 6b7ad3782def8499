"""Streaming queries: each runs over its table as a stream and must give what the batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.queries.registry import query
from chronotext.streaming import runs


@query("""SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS at, CAST(least(255, greatest(1, floor(sqrt(avg(value * value)) * 1.024 + 0.5))) AS INTEGER) AS level FROM events GROUP BY 1, 2""")
def stream_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3: levels by windows of event time."""
    return runs.levels(spark, sf_dir)


@query("""SELECT user_id, event_type, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id, event_type""")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, U1: the state after all changes, merged batch by batch."""
    return runs.latest(spark, sf_dir)


@query("""SELECT DISTINCT user_id, event_type FROM events""")
def stream_told_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST8: each message told once within the watermark."""
    return runs.told_once(spark, sf_dir)


@query("""WITH f AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < CAST(6 AS BIGINT) * 3600000000 THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM f)
SELECT user_id, min(ts) AS first, count(*) AS n FROM g GROUP BY user_id, island""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1's windows of activity: sessions by gaps of six hours."""
    return runs.sessions(spark, sf_dir)


@query()
def stream_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: online voices with per-recording state; tests hold it against the batch fold."""
    return runs.voices(spark, sf_dir)


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k, value / 100 AS x FROM events),
f AS (SELECT user_id, k // 2 AS frame, 10 * log10(sum(x * x) / 2 + 1e-10) AS db FROM e GROUP BY 1, 2 HAVING count(*) = 2),
v AS (SELECT user_id, max(n) AS n, max(db) FILTER (k = least(n - 1, floor(0.95::DOUBLE * n))) AS hi, max(db) FILTER (k = least(n - 1, floor(0.05::DOUBLE * n))) AS lo
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY db) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM f) GROUP BY 1),
q AS (SELECT f.user_id, frame, db < least(hi - 18, greatest(lo + 6, hi - 35)) AS quiet FROM f JOIN v ON f.user_id = v.user_id WHERE hi - lo >= 20 AND v.n >= 20),
i AS (SELECT *, sum(CASE WHEN quiet IS NOT DISTINCT FROM was THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY frame) AS island FROM (SELECT *, lag(quiet) OVER (PARTITION BY user_id ORDER BY frame) AS was FROM q))
SELECT user_id, min(frame) * 0.25::DOUBLE AS start, (max(frame) + 1) * 0.25::DOUBLE AS "end" FROM i WHERE quiet GROUP BY user_id, island""")
def stream_quiet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST2: frames found while samples come in, quiet stretches from all of them."""
    return runs.quiet(spark, sf_dir)


@query()
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1: windows for a recogniser, cut while frames come in; users' events are frames of 0.8 seconds, every third user's
    recording is begun anew. Tests hold the cuts against the batch fold."""
    e = runs.stream(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), "value")
    frames = e.select("user_id", F.when((F.col("user_id") % 3 == 0) & (F.col("id") % 2 == 0), 1).otherwise(0).cast("long").alias("job"), (F.col("id") / 200).alias("at"), F.col("value").alias("e"), F.lit(False).alias("last"))
    # Windows without frames stay together until the stream has ended: most are such.
    found = runs.recognition_stretches(frames, "user_id", frame=0.8).filter((F.col("user_id") % 3 > 0) | (F.col("job") == 1))
    return runs.stretched(runs.run(spark, found, "windows"))
