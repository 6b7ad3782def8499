"""Search queries: the flagship."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.plans import search as plan
from chronotext.queries.registry import query
from chronotext.queries.views import segments
from chronotext.session import table


@query()
def search_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two words said close together; tests hold it against a plain scan."""
    return plan.search(segments(spark, sf_dir), "the and")


@query()
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1-Q6 with a quoted phrase over document lines."""
    lines = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("episode_id"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    return plan.search(lines, '"of the" that')


@query(r"""WITH found AS (
  SELECT conv_id AS episode_id, turn AS seq FROM conversations WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])there[\p{L}\p{N}]*')
), ranked AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seq) - 1 AS hit, count(*) OVER (PARTITION BY episode_id) AS runs FROM found)
SELECT episode_id, seq, CAST(hit AS INTEGER) AS hit, runs FROM ranked WHERE hit < 5""")
def search_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q1-Q5, O9 for one word, without Python."""
    return plan.word_hits(segments(spark, sf_dir), "there").select("episode_id", "seq", "hit", "runs")


@query(r"""WITH found AS (
  SELECT conv_id, turn FROM conversations WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])there[\p{L}\p{N}]*')
), newest AS (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM found) ORDER BY conv_id DESC LIMIT 30)
SELECT conv_id AS episode_id, turn AS seq FROM found WHERE conv_id IN (SELECT conv_id FROM newest)""")
def search_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the newest thirty episodes (a larger id is newer)."""
    s = segments(spark, sf_dir)
    found = s.filter(plan.fold(plan.clean(F.col("text"))).rlike(plan.parse_query("there")[0].pattern)).select("episode_id", "seq")
    newest = s.select("episode_id", F.col("episode_id").alias("created_at")).distinct()
    return plan.listed(found, newest).select("episode_id", "seq")


@query(r"""SELECT count(DISTINCT conv_id) AS episodes, greatest(count(DISTINCT conv_id) - 30, 0) AS rest FROM conversations WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])there[\p{L}\p{N}]*')""")
def search_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many episodes have hits beyond those that are listed."""
    return plan.rest_count(plan.word_hits(segments(spark, sf_dir), "there"))
