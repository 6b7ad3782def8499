"""Queries over signals: events stand for frames, levels and timed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.functions import times as tm
from chronotext.operators import folds, intervals, ranks, sequence
from chronotext.queries.registry import query
from chronotext.queries.views import SPANS, spans
from chronotext.session import table


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("hour", F.floor(F.unix_seconds("ts") / 3600))


@query(f"""WITH {SPANS}, f AS (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY user_id ORDER BY start, "end", event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 600 THEN 1 ELSE 0 END AS fresh FROM spans),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY start, "end", event_id) AS island FROM f)
SELECT user_id, min(start) AS start, max("end") AS "end", count(*) AS n FROM g GROUP BY user_id, island""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that overlap or touch become one."""
    return intervals.merge_spans(spans(spark, sf_dir), ["user_id"], touch=600.0)


@query(f"""WITH {SPANS} SELECT a.event_id, CAST(count(*) AS BIGINT) AS n, round(sum(least(a."end", b."end") - greatest(a.start, b.start)), 3) AS seconds
FROM spans a JOIN spans b ON a.user_id = b.user_id AND a.start < b."end" AND b.start < a."end" WHERE a.event_type = 'click' AND b.event_type = 'view' GROUP BY a.event_id""")
def overlapping_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """clicks' spans against views' spans of the same user, bucketed by the hour."""
    s = spans(spark, sf_dir)
    right = s.filter("event_type = 'view'").select("user_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    found = intervals.overlap_join(s.filter("event_type = 'click'").drop("event_type"), right, ["user_id"], 3600.0)
    return found.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("overlap"), 3).alias("seconds"))


@query("""SELECT c.event_id, p.event_id AS purchase FROM (SELECT * FROM events WHERE event_type = 'click') c ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON c.user_id = p.user_id AND c.ts >= p.ts""")
def asof_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest purchase at each click."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.unix_micros("ts").alias("at"))
    bought = e.filter("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("purchase"))
    return intervals.asof_last(e.filter("event_type = 'click'"), bought, ["user_id"], "at", ["purchase"]).select("event_id", "purchase")


@query("""SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CAST(least(255, greatest(1, floor(sqrt(avg(value * value)) * 1.024 + 0.5))) AS INTEGER) AS level FROM events GROUP BY 1, 2""")
def loudness_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte for each step: the root mean square, at least 1."""
    level = F.least(F.lit(255), F.greatest(F.lit(1), tm.half_up(F.sqrt(F.avg(F.col("value") * F.col("value"))) * 1.024))).cast("int")
    return hours(spark, sf_dir).groupBy("user_id", "hour").agg(level.alias("level"))


@query("""SELECT event_type, max(v) FILTER (k = least(n - 1, floor(0.95::DOUBLE * n))) AS p95, max(v) FILTER (k = least(n - 1, floor(0.05::DOUBLE * n))) AS p05, max(v) FILTER (k = floor((n - 1) * 0.5::DOUBLE)) AS middle
FROM (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type""")
def order_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles that are values of the set, in both index forms; five groups, so by refined counts."""
    wanted = {"p95": ranks.at_share(0.95), "p05": ranks.at_share(0.05), "middle": ranks.at_share(0.5, last=True)}
    return ranks.order_statistics(table(spark, sf_dir, "events"), ["event_type"], "value", wanted).drop("_n")


@query("""WITH b AS (SELECT user_id, CAST(floor((epoch(ts) - 1704067200) / 86400) AS BIGINT) AS bar, max(value) AS v FROM events GROUP BY 1, 2),
p AS (SELECT user_id, greatest(4, max(value) FILTER (k = floor((n - 1) * 0.95::DOUBLE))) AS peak FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY user_id)
SELECT b.user_id, bar, round(least(1.0, pow(v / peak, 0.75)), 4) AS height FROM b JOIN p ON b.user_id = p.user_id""")
def bar_heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest value of each day against the user's 95th percentile."""
    e = table(spark, sf_dir, "events").withColumn("bar", F.floor((F.unix_seconds("ts") - 1704067200) / 86400))
    peak = e.groupBy("user_id").agg(F.greatest(F.lit(4.0), sequence.order_statistic(F.col("value"), 0.95, last=True)).alias("peak"))
    bars = e.groupBy("user_id", "bar").agg(F.max("value").alias("v"))
    return bars.join(peak, "user_id").select("user_id", "bar", F.round(F.least(F.lit(1.0), F.pow(F.col("v") / F.col("peak"), 0.75)), 4).alias("height"))


FRAMES = """f AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, 10 * log10(value * value / 10000 + 1e-10) AS db FROM events),
v AS (SELECT user_id, max(db) FILTER (k = least(n - 1, floor(0.95::DOUBLE * n))) AS hi, max(db) FILTER (k = least(n - 1, floor(0.05::DOUBLE * n))) AS lo, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY db) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM f) GROUP BY 1),
q AS (SELECT f.user_id, frame, db < least(hi - 18, greatest(lo + 6, hi - 35)) AS quiet FROM f JOIN v ON f.user_id = v.user_id WHERE hi - lo >= 20 AND v.n >= 50),
i AS (SELECT *, sum(CASE WHEN quiet IS NOT DISTINCT FROM was THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY frame) AS island FROM (SELECT *, lag(quiet) OVER (PARTITION BY user_id ORDER BY frame) AS was FROM q)),
r AS (SELECT user_id, min(frame) AS a, max(frame) + 1 AS b FROM i WHERE quiet GROUP BY user_id, island)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("frame"), (10 * F.log10(F.col("value") * F.col("value") / 10000 + 1e-10)).alias("db"), "value")


@query(f"""WITH {FRAMES} SELECT user_id, a * 0.25::DOUBLE AS start, b * 0.25::DOUBLE AS "end" FROM r""")
def quiet_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of quiet frames against levels of the whole."""
    return sequence.quiet_ranges(frames(spark, sf_dir), ["user_id"], seconds=0.25)


@query(f"""WITH {FRAMES} SELECT user_id, a * 0.25::DOUBLE + 0.1::DOUBLE AS "from", b * 0.25::DOUBLE - 0.12::DOUBLE AS "to" FROM r WHERE (b - a) * 0.25 > 0.2 AND b * 0.25::DOUBLE - 0.12::DOUBLE - (a * 0.25::DOUBLE + 0.1::DOUBLE) >= 0.2""")
def quiet_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4: what may be left out of the pauses."""
    return sequence.cuts(quiet_ranges(spark, sf_dir), 0.2).select("user_id", "from", "to")


@query("""WITH f AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, CASE WHEN value > 30 THEN length(event_type) % 3 END AS v FROM events)
SELECT user_id, frame, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS v FROM f""")
def filled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown labels take the one before, else the one after."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("frame"), F.when(F.col("value") > 30, F.length("event_type") % 3).alias("v"))
    return sequence.fill_gaps(f, ["user_id"], "frame", "v")


@query("""WITH f AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, length(event_type) % 3 AS v FROM events),
n AS (SELECT a.user_id, a.frame, b.v, count(*) AS c FROM f a JOIN f b ON a.user_id = b.user_id AND b.frame BETWEEN a.frame - 3 AND a.frame + 3 GROUP BY ALL)
SELECT user_id, frame, min_by(v, (-c, v)) AS smooth FROM n GROUP BY user_id, frame""")
def smoothed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent label of the three rows on either side."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("frame"), (F.length("event_type") % 3).alias("v"))
    return sequence.smooth_mode(f, ["user_id"], "frame", "v").select("user_id", "frame", "smooth")


@query("""WITH h AS (SELECT user_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY 1, 2),
s AS (SELECT user_id, hour, CAST(sum(v) OVER (PARTITION BY user_id ORDER BY hour RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS BIGINT) AS total FROM h)
SELECT user_id, max_by(hour, (total, -hour)) AS hour, max(total) AS total FROM s WHERE hour % 2 = 0 GROUP BY user_id""")
def busiest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty hours with most, from an even hour on."""
    h = hours(spark, sf_dir).groupBy("user_id", "hour").agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("v"))
    return sequence.best_window(h, ["user_id"], "hour", "v", 20, 2)


@query("""WITH s AS (SELECT user_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 20 THEN 1 ELSE 0 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY value) AS island FROM s)
SELECT user_id, min(value) AS low, max(value) AS high, count(*) AS n FROM g GROUP BY user_id, island""")
def value_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: one-dimensional clusters, split at wide gaps."""
    return sequence.gap_clusters(table(spark, sf_dir, "events"), ["user_id"], "value", 20.0).drop("centre")


@query("""WITH f AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame, CASE event_type WHEN 'error' THEN -1 WHEN 'view' THEN 0 ELSE 1 END AS spk FROM events),
i AS (SELECT *, sum(CASE WHEN spk = was THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY frame) AS island FROM (SELECT *, lag(spk) OVER (PARTITION BY user_id ORDER BY frame) AS was FROM f)),
t AS (SELECT user_id, spk, min(frame) AS a, max(frame) + 1 AS b FROM i GROUP BY user_id, spk, island), k AS (SELECT * FROM t WHERE spk >= 0 AND b - a >= 2),
j AS (SELECT *, sum(CASE WHEN spk = was AND a - ended <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY a) AS island FROM (SELECT *, lag(spk) OVER (PARTITION BY user_id ORDER BY a) AS was, lag(b) OVER (PARTITION BY user_id ORDER BY a) AS ended FROM k))
SELECT user_id, spk, min(a) * 0.125::DOUBLE AS start, max(b) * 0.125::DOUBLE AS "end" FROM j GROUP BY user_id, spk, island""")
def frame_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame classes to turns: short runs out, then one speaker's runs joined across short gaps."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    spk = F.when(F.col("event_type") == "error", -1).when(F.col("event_type") == "view", 0).otherwise(1)
    f = table(spark, sf_dir, "events").select("user_id", (F.row_number().over(w) - 1).alias("frame"), spk.alias("spk"))
    return sequence.frame_turns(f, ["user_id"], 0.125, 0.25, 0.25)


@query()
def window_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cut is the quietest frame 18 to 29.5 seconds after the one before."""
    f = frames(spark, sf_dir).select("user_id", (F.col("frame") * 0.8).alias("at"), F.col("value").alias("e"))
    return folds.window_cuts(f, "user_id", frame=0.8)


@query("""WITH m AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS d, avg(value) AS l FROM events GROUP BY 1, 2), a AS (SELECT user_id, avg(l) AS base FROM m WHERE l > 20 GROUP BY user_id)
SELECT m.user_id, round(avg(l), 2) AS loudness FROM m JOIN a ON m.user_id = a.user_id WHERE l > 20 AND l > base - 10 GROUP BY m.user_id""")
def gated_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean over what passes an absolute gate and then one relative to the first mean."""
    m = table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.unix_seconds("ts") / 86400).alias("d")).agg(F.avg("value").alias("l")).filter("l > 20")
    base = m.groupBy("user_id").agg(F.avg("l").alias("base"))
    return m.join(base, "user_id").filter("l > base - 10").groupBy("user_id").agg(F.round(F.avg("l"), 2).alias("loudness"))


@query("""WITH f AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value > 20 AS loud FROM events),
i AS (SELECT *, sum(CASE WHEN loud = was THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY k) AS island FROM (SELECT *, lag(loud) OVER (PARTITION BY user_id ORDER BY k) AS was FROM f)),
r AS (SELECT user_id, island, any_value(loud) AS loud, count(*) AS n FROM i GROUP BY user_id, island), e AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY island) AS p, lead(n) OVER (PARTITION BY user_id ORDER BY island) AS q FROM r)
SELECT user_id, count(*) AS dropouts FROM e WHERE NOT loud AND n BETWEEN 2 AND 30 AND p >= 1 AND q >= 1 GROUP BY user_id""")
def dropout_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent runs of two to thirty frames with sound on both sides."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("k"), (F.col("value") > 20).alias("loud"))
    v = Window.partitionBy("user_id").orderBy("k")
    runs = intervals.islands(f, ["user_id"], ["k"], F.col("loud") != F.lag("loud").over(v)).groupBy("user_id", "island").agg(F.first("loud").alias("loud"), F.count(F.lit(1)).alias("n"))
    u = Window.partitionBy("user_id").orderBy("island")
    sides = runs.withColumns({"p": F.lag("n").over(u), "q": F.lead("n").over(u)})
    return sides.filter(~F.col("loud") & F.col("n").between(2, 30) & (F.col("p") >= 1) & (F.col("q") >= 1)).groupBy("user_id").agg(F.count(F.lit(1)).alias("dropouts"))


@query("""SELECT user_id, base64(encode(string_agg(chr(CAST(1 + floor(value) AS INTEGER) % 127 + 1), '' ORDER BY ts, event_id))) AS levels FROM events GROUP BY user_id""")
def levels_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2: levels as base64 text, a byte each."""
    one = F.expr("char(cast(1 + floor(value) as int) % 127 + 1)")
    rows = F.array_sort(F.collect_list(F.struct("ts", "event_id", one.alias("c")))).getField("c")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.translate(F.base64(F.array_join(rows, "").cast("binary")), "\r\n", "").alias("levels"))


@query()
def preview_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the hours with most errors in twelve, every fifth hour on, none within twelve of another, and the
    busiest window before them; tests hold the choice against a greedy loop."""
    first = F.floor(F.unix_seconds("ts") / 3600)
    e = table(spark, sf_dir, "events").select("user_id", (first - F.min(first).over(Window.partitionBy("user_id"))).alias("hour"), (F.col("event_type") == "error").cast("long").alias("v"))
    counted = e.groupBy("user_id", "hour").agg(F.sum("v").alias("v")).withColumn("hours", F.max("hour").over(Window.partitionBy("user_id")) + 1)
    sums = sequence.window_sums(counted, ["user_id"], "hour", "v", 12, 5, "hours")
    worst = sequence.best_window(counted.select("user_id", "hour", "v"), ["user_id"], "hour", "v", 12, 2)
    return sequence.apart(sums, ["user_id"], "hour", "total", 12, 8, worst.select("user_id", "hour")).select("user_id", "hour", "total")


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS t, event_id // 40 % 2 AS label, floor(value) AS bad, event_type <> 'view' AS talking FROM events),
n AS (SELECT user_id, count(*) AS n FROM s GROUP BY 1), w AS (SELECT user_id, n, unnest(range(0, greatest(n - 19, 0), 2)) AS a FROM n),
m AS (SELECT w.user_id, label, a, count(*) AS mine, sum(CASE WHEN talking THEN bad ELSE 0 END) AS score FROM w JOIN s ON s.user_id = w.user_id AND t >= a AND t < a + 20 GROUP BY ALL HAVING count(*) >= 14),
b AS (SELECT user_id, label, min_by(a, (-score, a)) AS best FROM m GROUP BY 1, 2), f AS (SELECT user_id, label, min(t) AS first FROM s GROUP BY 1, 2)
SELECT user_id, label, coalesce(best, first) AS start, least(n, coalesce(best, first) + 20) AS "end" FROM f JOIN n USING (user_id) LEFT JOIN b USING (user_id, label)""")
def worst_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each of two voices the twenty seconds with most to mend in its own talk; a user's events are seconds."""
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    label = F.floor(F.col("event_id") / 40) % 2
    seconds = table(spark, sf_dir, "events").select("user_id", t.cast("long").alias("t"), label.alias("label"), F.floor("value").alias("bad"), (F.col("event_type") != "view").alias("talking"))
    return sequence.worst_windows(seconds, ["user_id"])
