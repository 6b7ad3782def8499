"""Interval and as-of joins. Time is cut into buckets so that every join has an equality to shuffle on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: float, left_span: tuple[str, str] = ("start", "end"), right_span: tuple[str, str] = ("r_start", "r_end")) -> DataFrame:
    """Rows whose spans overlap, with ``overlap`` in seconds. A pair that shares several buckets is kept in its first.

    bucket: seconds; a few times the usual span. A longer span takes part in each bucket that it touches. A row with a
    null bound or key overlaps nothing; repeated rows each pair; spans that only touch do not overlap.
    """
    (ls, le), (rs, re_) = left_span, right_span

    def cut(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
        last = F.greatest(F.floor(F.col(a) / bucket), F.ceil(F.col(b) / bucket) - 1)
        return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(a) / bucket), last)))

    r = cut(right, rs, re_, "_rb")
    for k in keys:
        r = r.withColumnRenamed(k, f"_r_{k}")
    on = (F.col("_lb") == F.col("_rb")) & (F.col(ls) < F.col(re_)) & (F.col(rs) < F.col(le))
    on &= F.col("_lb") == F.floor(F.greatest(F.col(ls), F.col(rs)) / bucket)
    for k in keys:
        on &= F.col(k) == F.col(f"_r_{k}")
    out = cut(left, ls, le, "_lb").join(r, on)
    return out.withColumn("overlap", F.least(le, re_) - F.greatest(ls, rs)).drop("_lb", "_rb", *(f"_r_{k}" for k in keys))


def asof_last(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: list[str], slack: float = 0.0) -> DataFrame:
    """To each left row the right row of the same keys with the latest ``at`` not after the left's ``at`` + slack.

    One shuffle on the keys: both sides are united, and the last right row is carried forward. right: keys, at, values. Of
    right rows at the same time the one of the largest values counts.
    """
    carried = F.struct(F.col(at).alias("_at"), *value)
    a = left.withColumns({"_t": F.col(at) + slack if slack else F.col(at), "_side": F.lit(1), "_carried": F.lit(None)})
    b = right.select(*keys, F.col(at).alias("_t"), F.lit(0).alias("_side"), carried.alias("_carried"))
    order = Window.partitionBy(*keys).orderBy("_t", "_side", "_carried").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn("_carried", F.last("_carried", ignorenulls=True).over(order))
    return both.filter("_side = 1").select(*left.columns, *(F.col(f"_carried.{v}").alias(v) for v in value), F.col("_carried._at").alias("matched_at"))


def islands(df: DataFrame, keys: list[str], order: list[str], fresh: Column, name: str = "island") -> DataFrame:
    """Number runs: a row for which ``fresh`` is true (or null, the first) starts the next one. ``fresh`` may use windows
    over the same keys and order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    started = df.withColumn("_fresh", F.when(F.coalesce(fresh, F.lit(True)), 1).otherwise(0))
    return started.withColumn(name, F.sum("_fresh").over(w)).drop("_fresh")


def merge_spans(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", touch: float = 0.0) -> DataFrame:
    """Spans of each key united where they overlap or lie within ``touch``: keys, start, end, n."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col(start) > F.max(end).over(before) + touch
    found = islands(df, keys, [start, end], fresh)
    return found.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("island")


def selection(df: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """What a selected stretch touches, snapped outwards to whole segments: keys, from, to, n."""
    return df.filter((F.col("end") > low) & (F.col("start") < high)).groupBy(*keys).agg(F.min("start").alias("from"), F.max("end").alias("to"), F.count(F.lit(1)).alias("n"))


def replace_window(old: DataFrame, new: DataFrame, windows: DataFrame, keys: list[str], bucket: float = 300.0, slack: float = 0.05) -> DataFrame:
    """``new`` segments take the place of the ``old`` ones that a window overlaps by more than ``slack`` (keys, w_start, w_end)."""
    inner = windows.withColumns({"w_start": F.col("w_start") + slack, "w_end": F.col("w_end") - slack})
    hit = overlap_join(old.select(*keys, "start", "end"), inner.filter("w_end > w_start"), keys, bucket, right_span=("w_start", "w_end")).select(*keys, "start", "end").distinct()
    return old.join(hit, [*keys, "start", "end"], "left_anti").unionByName(new, allowMissingColumns=True)
