"""Replicated records: last writer wins, change cursors, snapshots compared, rankings and retention by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, keys: list[str], at: str, arrival: str) -> DataFrame:
    """Current records: the newest ``at`` of each key; equal times keep what arrived first.

    An aggregate, so a key with very many versions is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(at), -F.col(arrival)))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def apply_changes(held: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Held records after changes, with ``changed``: a change wins only if it is newer than what is held."""
    both = held.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return latest(both, keys, at, "_new").withColumn("changed", F.col("_new") == 1).drop("_new")


def since(log: DataFrame, keys: list[str], revision: str, cursor: int) -> DataFrame:
    """What a client with ``cursor`` lacks: the last revision of each key that changed after it."""
    return log.filter(F.col(revision) > cursor).groupBy(*keys).agg(F.max(revision).alias(revision))


def top_per(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in an order; Spark prunes each partition to n rows before the shuffle."""
    out = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def first_per(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Distinct by key, the first in ``order`` stays; an aggregate with map-side combination."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def missing_from(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(known.select(*keys).distinct(), keys, "left_anti")


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Rows of ``after`` that are new or differ in a compared column (nulls equal)."""
    old = before.select(*keys, *(F.col(c).alias(f"_{c}") for c in compared), F.lit(True).alias("_held"))
    joined = after.join(old, keys, "left")
    differs = F.col("_held").isNull()
    for c in compared:
        differs |= ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return joined.filter(differs).select(*after.columns)


def upsert(held: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` replace held rows of the same keys and join the others."""
    return missing_from(held, rows, keys).unionByName(rows)


def keep_within(df: DataFrame, keys: list[str], order: list[Column], size: str, budget: float) -> DataFrame:
    """Rows that fit a budget when taken in ``order``: the running size stays within it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("running", F.sum(size).over(w)).filter(F.col("running") <= budget)


def flatten_map(df: DataFrame, keys: list[str], column: str, prefix: str) -> DataFrame:
    """Records of a map column as rows: keys, key (``prefix/id``), rec."""
    return df.select(*keys, F.explode(column).alias("_id", "rec")).select(*keys, F.concat(F.lit(f"{prefix}/"), F.col("_id")).alias("key"), "rec")


def edit_queue(queue: Column, item: Column, place: str, anchor: Column | None = None) -> Column:
    """A queue of ids after one edit: ``last``, ``next`` (first), ``after`` the anchor, or ``remove``."""
    rest = F.array_remove(queue, item)
    if place == "remove":
        return rest
    if place == "last":
        return F.array_append(rest, item)
    at = F.array_position(rest, anchor) if place == "after" else F.lit(0)
    return F.concat(F.slice(rest, F.lit(1), at.cast("int")), F.array(item), F.slice(rest, at.cast("int") + 1, F.greatest(F.size(rest), F.lit(1))))
