"""How the driver's tables stand for segments, turns, records and signals; each view has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.functions.text import word_count
from chronotext.functions.times import half_up
from chronotext.session import table

#: Words said in a second.
PACE = 2.7


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as timed segments: episode_id, seq, speaker, text, n_words, start, end, w."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("episode_id"), F.col("turn").alias("seq"), F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2).alias("speaker"), "text")
    rows = rows.withColumn("n_words", word_count(F.col("text")).cast("long"))
    before = F.coalesce(F.sum("n_words").over(Window.partitionBy("episode_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumns({"start": half_up(before / PACE, 3), "end": half_up((before + F.col("n_words")) / PACE, 3)}).withColumn("w", F.floor(F.col("start") / 30) * 30)


SEGMENTS = r"""
said AS (
  SELECT conv_id AS episode_id, turn AS seq, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS speaker, text,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')) AS BIGINT) AS n_words
  FROM conversations
), placed AS (
  SELECT *, CAST(coalesce(sum(n_words) OVER (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM said
), segments AS (
  SELECT episode_id, seq, speaker, text, n_words, floor(before / 2.7::DOUBLE * 1000 + 0.5) / 1000 AS start,
    floor((before + n_words) / 2.7::DOUBLE * 1000 + 0.5) / 1000 AS "end"
  FROM placed
)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as spans: user_id, start (whole seconds), end = start + 60 * value, event_type, event_id."""
    start = F.unix_seconds("ts").cast("double")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", start.alias("start"), (start + F.floor(F.col("value") * 60)).alias("end"))


SPANS = """
spans AS (
  SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS DOUBLE) AS start, floor(epoch(ts)) + floor(value * 60) AS "end" FROM events
)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a change log: key, at (ms), rev (arrival), p (a position), done."""
    return table(spark, sf_dir, "events").select(
        F.concat_ws("/", F.lit("progress"), F.concat(F.col("user_id"), F.lit("-"), F.col("event_type"))).alias("key"), (F.floor(F.unix_millis("ts") / 3_600_000) * 3_600_000).alias("at"),
        F.col("event_id").alias("rev"), F.col("value").alias("p"), (F.col("event_type") == "purchase").alias("done"), "user_id",
    )


CHANGES = """
changes AS (
  SELECT 'progress/' || user_id || '-' || event_type AS key, CAST(floor(epoch_ms(ts) / 3600000.0) * 3600000 AS BIGINT) AS "at", event_id AS rev, value AS p,
    event_type = 'purchase' AS done, user_id
  FROM events
)"""
