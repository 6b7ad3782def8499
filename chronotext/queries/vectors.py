"""Queries over voice prints: the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.functions import vectors as vx
from chronotext.operators import folds, ranks
from chronotext.queries.registry import query
from chronotext.session import table

DOT = "list_dot_product(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"), "label")


@query(f"""SELECT vec_id, round(sqrt({DOT.format("embedding", "embedding")}), 4) AS norm FROM embeddings""")
def print_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of prints."""
    return prints(spark, sf_dir).select("vec_id", F.round(vx.norm(F.col("v")), 4).alias("norm"))


CENTRES = """c AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM (SELECT label, embedding, unnest(range(1, 65)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)"""


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints(spark, sf_dir).groupBy("label").agg(vx.mean_vector("v", 64).alias("c"))


@query(f"""WITH {CENTRES}, s AS (SELECT vec_id, e.label AS truth, c.label AS voice, {DOT.format("embedding", "c")} / sqrt({DOT.format("c", "c")}) AS sim FROM embeddings e JOIN c ON true)
SELECT vec_id, truth, max_by(voice, sim) AS nearest, round(max(sim), 4) AS likeness FROM s GROUP BY vec_id, truth""")
def nearest_voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each print's nearest voice. There are few voices (one row a label), so they are one broadcast array."""
    voices = centres(spark, sf_dir).agg(F.collect_list(F.struct("label", F.transform("c", lambda x: x).alias("c"))).alias("voices"))
    joined = prints(spark, sf_dir).withColumn("_one", F.lit(1)).join(F.broadcast(voices.withColumn("_one", F.lit(1))), "_one")
    scored = F.transform("voices", lambda k: F.struct((vx.dot(F.col("v"), k["c"]) / vx.norm(k["c"])).alias("like"), k["label"].alias("label")))
    return joined.withColumn("best", F.array_max(scored)).select("vec_id", F.col("label").alias("truth"), F.col("best.label").alias("nearest"), F.round("best.like", 4).alias("likeness"))


@query(f"""WITH {CENTRES}, s AS (SELECT vec_id, e.label AS truth, c.label AS voice, {DOT.format("embedding", "c")} / sqrt({DOT.format("c", "c")}) AS sim FROM embeddings e JOIN c ON true),
b AS (SELECT vec_id, truth, max_by(voice, sim) AS nearest FROM s GROUP BY vec_id, truth), m AS (SELECT nearest, truth, count(*) AS n FROM b GROUP BY nearest, truth)
SELECT nearest AS voice, max_by(truth, (n, -truth)) AS speaker, round(max(n)::DOUBLE / sum(n), 4) AS accuracy FROM m GROUP BY nearest""")
def voice_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each voice's true speaker by most rows, and its share."""
    counted = nearest_voice(spark, sf_dir).groupBy("nearest", "truth").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("nearest").agg(F.max(F.struct("n", (-F.col("truth")).alias("t"))).alias("b"), F.sum("n").alias("all"))
    return best.select(F.col("nearest").alias("voice"), (-F.col("b.t")).alias("speaker"), F.round(F.col("b.n") / F.col("all"), 4).alias("accuracy"))


@query(f"""WITH p AS (SELECT a.label = b.label AS same, {DOT.format("a.embedding", "b.embedding")} AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND (b.vec_id % 50 > 0 OR a.vec_id < b.vec_id)),
r AS (SELECT same, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM p)
SELECT round((sum(r) FILTER (same) - count(*) FILTER (same) * (count(*) FILTER (same) + 1) / 2.0) / (count(*) FILTER (same) * count(*) FILTER (NOT same)), 4) AS auc FROM r""")
def pair_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well similarity tells same from different; a stated set of prints (ids divisible by 50) against
    all others, a pair inside the set once.

    Ranks come from counts of equal scores cut to a grid, summed over the grid: no sort of all pairs in one task.
    """
    p = prints(spark, sf_dir)
    rows = p.select(F.col("vec_id").alias("id"), "v", "label", (F.col("vec_id") % 50 == 0).alias("asked"))
    at = ranks.pair_counts(rows.filter("asked"), rows)
    coarse = at.groupBy(F.floor(F.col("cell") / 100_000).alias("block")).agg(F.sum("neg").alias("n"))
    from pyspark.sql.window import Window

    below = coarse.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("neg").over(Window.partitionBy("block").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = at.withColumn("block", F.floor(F.col("cell") / 100_000)).withColumn("inside", inside).join(F.broadcast(below), "block")
    wins = F.sum(F.col("pos") * (F.col("base") + F.col("inside") + F.col("neg") / 2))
    return ranked.agg(F.round(wins / (F.sum("pos") * F.sum("neg")), 4).alias("auc"))


@query()
def online_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST4: voices found in order, recordings of forty prints; tests hold it against plain Python."""
    rows = prints(spark, sf_dir).select(F.floor(F.col("vec_id") / 40).alias("episode_id"), F.col("vec_id").alias("seq"), "v", (F.col("vec_id") % 7 + 1).cast("double").alias("seconds"))
    return folds.online_voices(rows, "episode_id")


@query()
def print_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """average-link clusters within a recording."""
    rows = prints(spark, sf_dir).select(F.floor(F.col("vec_id") / 40).alias("episode_id"), F.col("vec_id").alias("seq"), "v")
    return folds.clusters(rows, "episode_id", 0.3)
