"""Queries over reads for sponsors: the turns of the tables with reads put into some of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions import fixed
from chronotext.operators import breaks
from chronotext.queries.registry import query
from chronotext.queries.views import SEGMENTS, segments

BRANDS = ["Boxwise", "Nappen", "Fjordtel", "Penga", "Larmtek"]


def read_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, of which every sixth ends with a read, the next in even episodes names the brand again, and one of every
    eleventh episode names it long before."""
    brand = F.element_at(F.array(*map(F.lit, BRANDS)), (F.col("episode_id") % 5 + 1).cast("int"))
    read = F.concat(F.lit(" This show is brought to you by "), brand, F.lit(". "), brand, F.lit(" is here. Go to "), F.lower(brand), F.lit(".com/show for 20% off."))
    again = F.concat(F.lit(" And "), brand, F.lit(" it is."))
    added = F.when(F.col("seq") % 6 == 3, read).when((F.col("seq") % 6 == 4) & (F.col("episode_id") % 2 == 0), again).when((F.col("seq") == 0) & (F.col("episode_id") % 11 == 0), again).otherwise("")
    return segments(spark, sf_dir).withColumn("text", F.concat(F.coalesce("text", F.lit("")), added))


READS = f"""brands AS (SELECT *, ({BRANDS!r})[episode_id % 5 + 1] AS brand FROM segments),
read_segments AS (SELECT episode_id, seq, speaker, start, "end", w, coalesce(text, '') || CASE WHEN seq % 6 = 3 THEN ' This show is brought to you by ' || brand || '. ' || brand || ' is here. Go to ' || lower(brand) || '.com/show for 20% off.'
  WHEN seq % 6 = 4 AND episode_id % 2 = 0 OR seq = 0 AND episode_id % 11 = 0 THEN ' And ' || brand || ' it is.' ELSE '' END AS text FROM (SELECT *, floor(start / 30) * 30 AS w FROM brands))"""
NOT_SOLD = ", ".join(f"'{w}'" for w in fixed.NOT_SOLD)


@query()
def ad_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks in full, grown over paragraphs, with begins and ends inside them; tests hold the rules by cases."""
    return breaks.ad_breaks(read_segments(spark, sf_dir), "episode_id")


@query(rf"""WITH {SEGMENTS}, {READS}, sentences AS (
  SELECT episode_id, start, "end", unnest(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))) AS sentence FROM read_segments
), names AS (
  SELECT episode_id, start, "end", unnest(regexp_extract_all(sentence, '(?:^|[^\p{{L}}\d])(\p{{Lu}}[\p{{L}}\d''’-]{{2,}})', 1)) AS name,
    regexp_matches(sentence, 'brought to you by|Go to \w+\.com|\d% off') AS cued FROM sentences
), kept AS (SELECT * FROM names WHERE name NOT IN ({NOT_SOLD})
), reads AS (SELECT episode_id, seq AS read, start AS a, "end" + 60 AS b FROM read_segments WHERE seq % 6 = 3
), found AS (
  SELECT k.episode_id, read, a, b, name, count(*) AS n FROM kept k JOIN reads r ON k.episode_id = r.episode_id AND start >= a AND "end" <= b
  GROUP BY ALL HAVING count(*) >= 2 AND bool_or(cued)
)
SELECT episode_id, read, name, n FROM found f
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.episode_id = f.episode_id AND k.name = f.name AND (k."end" < a - 150 OR k.start > b + 150))""")
def sold_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names said twice or more in a read and the minute after, once where it is worded as one, and nowhere far from it."""
    rows = read_segments(spark, sf_dir)
    reads = rows.filter("seq % 6 = 3").select("episode_id", F.col("seq").alias("read"), "start", (F.col("end") + 60).alias("end"))
    return breaks.sold_names(rows, reads, "episode_id")
