"""Sequence operators: runs, smoothing, gap filling and sliding windows over ordered rows, by window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.operators.ranks import at_share, order_statistics
from chronotext.session import written
from chronotext.operators.intervals import islands


def frame_turns(frames: DataFrame, keys: list[str], seconds: float, least: float = 0.25, gap: float = 0.3) -> DataFrame:
    """Single-speaker turns of frame classes: keys, spk, start, end. frames: keys, frame, spk (-1: nobody or several).

    Runs shorter than ``least`` are dropped, then one speaker's turns across a gap of at most ``gap`` are one.
    """
    w = Window.partitionBy(*keys).orderBy("frame")
    runs = islands(frames, keys, ["frame"], F.col("spk") != F.lag("spk").over(w))
    turns = runs.groupBy(*keys, "island", "spk").agg((F.min("frame") * seconds).alias("start"), ((F.max("frame") + 1) * seconds).alias("end"))
    kept = turns.filter((F.col("spk") >= 0) & (F.col("end") - F.col("start") >= least - 1e-9)).drop("island")
    v = Window.partitionBy(*keys).orderBy("start")
    fresh = (F.col("spk") != F.lag("spk").over(v)) | (F.col("start") - F.lag("end").over(v) > gap + 1e-9)
    return islands(kept, keys, ["start"], fresh).groupBy(*keys, "island", "spk").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def joined_turns(segments: DataFrame, keys: list[str], voice: str, gap: float = 1.5) -> DataFrame:
    """Turns: one voice across gaps of at most ``gap``: keys, voice, start, end, n."""
    w = Window.partitionBy(*keys).orderBy("start", "end")
    same = islands(segments, keys, ["start", "end"], F.col(voice) != F.lag(voice).over(w), "_same")
    near = Window.partitionBy(*keys, "_same").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = (F.col("_same") != F.lag("_same").over(w)) | (F.col("start") - F.max("end").over(near) > gap)
    turns = islands(same, keys, ["start", "end"], fresh)
    return turns.groupBy(*keys, "island", voice).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def delta_code(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Tenths of seconds as gap to the turn before and length; columns gap, len added."""
    w = Window.partitionBy(*keys).orderBy("start")
    a, b = F.floor(F.col("start") * 10 + 0.5).cast("long"), F.floor(F.col("end") * 10 + 0.5).cast("long")
    return turns.withColumns({"_a": a, "_b": b}).withColumns({"gap": F.col("_a") - F.coalesce(F.lag("_b").over(w), F.lit(0)), "len": F.col("_b") - F.col("_a")}).drop("_a", "_b")


def delta_decode(coded: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Starts and ends in seconds from gap and len."""
    w = Window.partitionBy(*keys).orderBy(order)
    through = F.sum(F.col("gap") + F.col("len")).over(w)
    return coded.withColumns({"from": (through - F.col("len")) / 10, "to": through / 10})


def order_statistic(values: Column, share: float, last: bool = False) -> Column:
    """Aggregate: the value at floor(share * n) of the sorted values (``last``: at floor(share * (n - 1))); no interpolation.

    It lists a group, so groups must be small (days of a user, frames of an episode); ``ranks.order_statistics`` is for others.
    """
    ordered = F.array_sort(F.collect_list(values))
    n = F.size(ordered)
    at = F.floor((n - 1) * share) if last else F.least(n - 1, F.floor(n * share))
    return F.get(ordered, at.cast("int"))


def quiet_ranges(frames: DataFrame, keys: list[str], seconds: float = 0.02, least: float = 0.25, span: float = 20.0, fewest: int = 50) -> DataFrame:
    """Pauses: runs of frames under a level set between the 5th and 95th percentile: keys, start, end. frames: keys, frame, db."""
    levels = order_statistics(frames, keys, "db", {"_hi": at_share(0.95), "_lo": at_share(0.05)})
    limit = F.least(F.col("_hi") - 18, F.greatest(F.col("_lo") + 6, F.col("_hi") - 35))
    usable = levels.filter((F.col("_n") >= fewest) & (F.col("_hi") - F.col("_lo") >= span)).select(*keys, limit.alias("_limit"))
    flagged = frames.join(usable, keys).withColumn("_quiet", F.col("db") < F.col("_limit"))
    w = Window.partitionBy(*keys).orderBy("frame")
    runs = islands(flagged, keys, ["frame"], F.col("_quiet") != F.lag("_quiet").over(w)).filter("_quiet")
    out = runs.groupBy(*keys, "island").agg((F.min("frame") * seconds).alias("start"), ((F.max("frame") + 1) * seconds).alias("end"))
    return out.filter(F.col("end") - F.col("start") >= least - 1e-9).drop("island")


def cuts(quiet: DataFrame, limit: float, cost: float = 0.0) -> DataFrame:
    """Stretches to leave out of pauses longer than ``limit``: half of the limit stays on either side."""
    before, after, least = max(0.1, limit / 2), max(0.12, limit / 2 - cost), max(0.2, cost + 0.15)
    out = quiet.filter(F.col("end") - F.col("start") > limit).withColumns({"from": F.col("start") + before, "to": F.col("end") - after})
    return out.filter(F.col("to") - F.col("from") >= least)


def fill_gaps(df: DataFrame, keys: list[str], order: str, value: str, default: int = 0) -> DataFrame:
    """Missing values take the last known one, before the first known one that one, else ``default``."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return df.withColumn(value, F.coalesce(back, ahead, F.lit(default)))


def smooth_mode(df: DataFrame, keys: list[str], order: str, label: str, reach: int = 3) -> DataFrame:
    """Add ``smooth``: the most frequent label within ``reach`` rows on either side; ties take the smaller label."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-reach, reach)
    near = F.collect_list(label).over(w)
    counts = F.transform(F.array_distinct(near), lambda v: F.struct((-F.size(F.filter(near, lambda x: x == v))).alias("n"), v.alias("v")))
    return df.withColumn("smooth", F.array_min(counts)["v"])


def best_window(df: DataFrame, keys: list[str], at: str, value: str, width: int, step: int, fewest: int = 1) -> DataFrame:
    """Per key the window of ``width`` whole seconds with the largest sum, starting at multiples of ``step`` that have a row."""
    w = Window.partitionBy(*keys).orderBy(at).rangeBetween(0, width - 1)
    tried = df.withColumns({"total": F.sum(value).over(w), "n": F.count(F.lit(1)).over(w)}).filter((F.col(at) % step == 0) & (F.col("n") >= fewest))
    return tried.groupBy(*keys).agg(F.max(F.struct("total", (-F.col(at)).alias("_at"))).alias("_b")).select(*keys, (-F.col("_b._at")).alias(at), F.col("_b.total").alias("total"))


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the latest known value of the rows before."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def next_other(df: DataFrame, keys: list[str], order: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the next value that differs from the row's own: the first value of the run that follows."""
    w = Window.partitionBy(*keys).orderBy(order)
    runs = islands(df, keys, [order], F.col(value) != F.lag(value).over(w), "_run")
    last_of_run = F.when(F.lead("_run").over(w) != F.col("_run"), F.lead(value).over(w))
    return runs.withColumn("_next", last_of_run).withColumn(name, F.first("_next", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))).drop("_run", "_next")


def gap_clusters(df: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """One-dimensional clusters: sorted values split where they are more than ``gap`` apart: keys, low, high, n, centre."""
    w = Window.partitionBy(*keys).orderBy(value)
    found = islands(df, keys, [value], F.col(value) - F.lag(value).over(w) > gap)
    return found.groupBy(*keys, "island").agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("centre")).drop("island")


def apart(spots: DataFrame, keys: list[str], at: str, value: str, width: float, top: int = 8, taken: DataFrame | None = None) -> DataFrame:
    """Spots at least ``width`` apart, best first, at most ``top`` a key: keys, at, value (null for a taken one).

    Greedy by value, ties by the earlier spot; a spot nearer than ``width`` to one already chosen is left out. taken: keys,
    at of spots that are chosen beforehand, kept in any case and counted first. Found by rounds of local bests: a spot that
    no nearer open spot surpasses is chosen, its neighbours go, until none is open. A round compares a spot only with those
    of its own stretch of ``width`` and the two beside it, so no key is a group. Null values and places are left out.
    """
    order = F.struct(F.col(value).alias("v"), (-F.col(at)).alias("a"))
    open_ = spots.filter(F.col(at).isNotNull() & F.col(value).isNotNull()).groupBy(*keys, at).agg(F.max(value).alias(value))

    def spread(df: DataFrame, names: dict[str, str]) -> DataFrame:
        near = df.withColumn("_c", F.explode(F.array(*[F.floor(F.col(at) / width) + d for d in (-1, 0, 1)])))
        return near.withColumnsRenamed(names)

    def beside(df: DataFrame, others: DataFrame, extra: Column) -> DataFrame:
        match = (F.col("_own") == F.col("_c")) & (F.abs(F.col(at) - F.col("_at")) < width) & extra
        for i, k in enumerate(keys):
            match &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
        return df.withColumn("_own", F.floor(F.col(at) / width)).join(others, match, "left_anti").drop("_own")

    named = {at: "_at", value: "_value", **{k: f"_k{i}" for i, k in enumerate(keys)}}
    chosen = None
    if taken is not None:
        chosen = taken.select(*keys, F.col(at).cast(spots.schema[at].dataType).alias(at), F.lit(None).cast(spots.schema[value].dataType).alias(value)).distinct()
        open_ = beside(open_, spread(chosen, named).drop("_value"), F.lit(True))
    open_ = written(open_, "open")
    while not open_.isEmpty():
        better = F.struct(F.col("_value").alias("v"), (-F.col("_at")).alias("a")) > order
        best = written(beside(open_, spread(open_, named), better), "chosen")
        chosen = best if chosen is None else chosen.unionByName(best)
        open_ = written(beside(open_, spread(best, named).drop("_value"), F.lit(True)), "open")
    if chosen is None:
        return open_
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_first(), F.col(at)))
    return chosen.withColumn("_rank", rank).filter(F.col("_rank") <= top).drop("_rank")


def window_sums(df: DataFrame, keys: list[str], at: str, value: str, width: int, step: int, last: str) -> DataFrame:
    """Sums over ``width`` whole places from every ``step``-th on, where they are not zero: keys, at, total.

    ``last``: a column with the number of places of the key (from 0); windows end inside it. Places without a row count 0.
    """
    low = F.greatest(F.lit(0), F.ceil((F.col(at) - width + 1) / step))
    high = F.least(F.floor(F.col(at) / step), F.floor((F.col(last) - width) / step))
    fits = df.filter(high >= low).withColumn("_w", F.explode(F.sequence(low, high)))
    return fits.groupBy(*keys, (F.col("_w") * step).alias(at)).agg(F.sum(value).alias("total")).filter("total <> 0")


def worst_windows(seconds: DataFrame, keys: list[str], length: int = 20, step: int = 2, share: float = 0.7) -> DataFrame:
    """Per label the window that sounds worst in its own talking time: keys, label, start, end.

    seconds: keys, t (from 0, none missing), label, bad, talking. A window of ``length`` seconds from a ``step``-th second
    on, inside the recording, counts for a label that has ``share`` of its seconds; its score is what is bad while that
    label talks, ties go to the earlier one. A label without such a window gets the stretch from its first second. Null
    labels have none, null ``bad`` and ``talking`` count nothing. Each second is dealt to the windows it lies in, which are
    summed before they move.
    """
    ends = seconds.groupBy(*keys).agg((F.max("t") + 1).alias("_n"))
    rows = seconds.filter("label IS NOT NULL").join(ends, keys)
    low, high = F.greatest(F.lit(0), F.ceil((F.col("t") - length + 1) / step)), F.least(F.floor(F.col("t") / step), F.floor((F.col("_n") - length) / step))
    windows = rows.select(*keys, "label", "t", "_n", F.when(F.col("talking"), F.col("bad")).otherwise(0).alias("_b"), F.when(high >= low, F.sequence(low, high)).alias("_w"))
    summed = windows.select(*keys, "label", F.explode("_w").alias("_w"), "_b").withColumn("start", F.col("_w") * step).groupBy(*keys, "label", "start").agg(F.count(F.lit(1)).alias("_mine"), F.coalesce(F.sum("_b"), F.lit(0)).alias("_score"))
    best = summed.filter(F.col("_mine") >= length * share).groupBy(*keys, "label").agg(F.min_by("start", F.struct((-F.col("_score")).alias("s"), "start")).alias("_best"))
    first = rows.groupBy(*keys, "label").agg(F.min("t").alias("_first"), F.max("_n").alias("_n"))
    start = F.coalesce("_best", F.col("_first").cast("long"))
    return first.join(best, [*keys, "label"], "left").select(*keys, "label", start.alias("start"), F.least(F.col("_n").cast("long"), start + length).alias("end"))
