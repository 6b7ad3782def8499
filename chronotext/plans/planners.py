"""Planners: what to transcribe next, which copies to delete, which downloads to fetch or drop, what a library forgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.operators.records import first_per, top_per

DAY = 86_400_000


def work_queue(feeds: DataFrame, library: DataFrame, asked: DataFrame, now: int, max_age_days: int = 14) -> DataFrame:
    """Episodes to transcribe: id, show, rank, published, in the order they are to be done (column ``place``).

    feeds: show, id, published, pos (place in the feed), backfill, fresh; library: id, show, created; asked: id.
    Rank 0: new since the show's first transcript (of a show without any only the newest), 1: asked for, 2: going back.
    Rank 2 runs newest first, the others oldest first. What the library has is left out; the best rank of an id counts.
    """
    firsts = library.groupBy("show").agg(F.min(F.coalesce("created", F.lit(0))).alias("_first"))
    recent = feeds.filter(F.col("published") > now - max_age_days * DAY).join(firsts, "show", "left")
    place = F.row_number().over(Window.partitionBy("show").orderBy("pos"))
    new = recent.withColumn("_n", place).filter(F.col("fresh") & F.when(F.col("_first").isNull(), F.col("_n") == 1).otherwise(F.col("published") >= F.col("_first")))
    back = feeds.filter(F.col("pos") < F.col("backfill"))
    wanted = feeds.join(asked.select("id").distinct(), "id", "left_semi")
    cols = ["id", "show", "published"]
    every = new.select(*cols, F.lit(0).alias("rank")).unionByName(wanted.select(*cols, F.lit(1).alias("rank"))).unionByName(back.select(*cols, F.lit(2).alias("rank")))
    queue = first_per(every.join(library.select("id").distinct(), "id", "left_anti"), ["id"], "rank")
    return queue.withColumn("place", F.when(F.col("rank") == 2, -F.col("published")).otherwise(F.col("published")))


def stale_copies(library: DataFrame, queued: DataFrame, progress: DataFrame, files: DataFrame, now: int, days: int, grace: int = 2) -> DataFrame:
    """Ids whose audio copy may go. library: id, audio (file name), at; queued: id; progress: id, p, done; files: name, mtime.

    A copy stays ``days`` days, three times that while it is queued or started; a file of the last ``grace`` days stays.
    """
    started = progress.filter(~F.coalesce("done", F.lit(False)) & (F.col("p") > 5)).select("id")
    held = queued.select("id").unionByName(started).distinct().withColumn("_held", F.lit(True))
    joined = library.filter(F.col("audio").isNotNull()).join(held, "id", "left").join(files.select(F.col("name").alias("audio"), "mtime"), "audio", "left")
    keep = F.when(F.coalesce("_held", F.lit(False)), 3).otherwise(1) * F.lit(days * DAY).cast("long")
    fresh = F.coalesce(now - F.col("mtime") < grace * DAY, F.lit(False))
    return joined.filter((now - F.coalesce("at", F.lit(0)) > keep) & ~fresh).select("id")


def leftover_files(files: DataFrame, library: DataFrame, now: int, grace: int = 2) -> DataFrame:
    """Names of part files, and of audio files that no entry lists, older than the grace."""
    listed = library.filter(F.col("audio").isNotNull()).select(F.col("audio").alias("name")).distinct().withColumn("_listed", F.lit(True))
    joined = files.join(listed, "name", "left")
    stray = F.col("name").endswith(".part") | (F.col("name").rlike(r"^[0-9a-f]{16}\.(mp3|m4a)$") & F.col("_listed").isNull())
    return joined.filter(stray & (now - F.col("mtime") >= grace * DAY)).select("name")


def pruned_files(library: DataFrame, files: DataFrame, copies: DataFrame, leftovers: DataFrame) -> DataFrame:
    """Files that go when ``copies`` (id) and ``leftovers`` (name) are pruned: name, size. library: id, audio; files: name, size.

    With a copy go its lists of quiet places and its shape; with leftover audio that no entry knows, its quiet list. A
    library without entries prunes nothing: an index that came out empty by a fault must not cost all audio.
    """
    aside = lambda kind: F.concat("id", F.lit(f".{kind}.json"))
    gone = library.join(copies.select("id").distinct(), "id", "left_semi").filter(F.col("audio").isNotNull())
    own = gone.select(F.explode(F.array(F.element_at(F.split("audio", "/"), -1), aside("quiet"), aside("shape"))).alias("name"))
    stray = leftovers.select(F.regexp_extract("name", r"^([0-9a-f]{16})\.(mp3|m4a)$", 1).alias("id")).filter("id <> ''")
    lost = stray.join(library.select("id"), "id", "left_anti").select(aside("quiet").alias("name"))
    names = own.unionByName(leftovers.select("name")).unionByName(lost).distinct()
    some = library.limit(1).select(F.lit(True).alias("_some"))
    return files.join(names, "name", "left_semi").withColumn("_some", F.lit(True)).join(F.broadcast(some), "_some", "left_semi").select("name", "size")


def pruned_library(library: DataFrame, copies: DataFrame) -> DataFrame:
    """The library's rows after pruning: audio, quiet and shape of the copies are null, all else as it was."""
    marked = library.join(copies.select("id").distinct().withColumn("_gone", F.lit(True)), "id", "left")
    kept = {c: F.when(F.col("_gone").isNull(), F.col(c)) for c in ("audio", "quiet", "shape") if c in library.columns}
    return marked.withColumns(kept).select(*library.columns)


def refresh_plan(shows: DataFrame, feeds: DataFrame, now: int, seconds: int) -> DataFrame:
    """What a refresh does: id, action. shows: id of each followed show; feeds: id, fetched_at of each kept feed.

    Feeds of followed shows that were never read, or not within ``seconds``, are read; feeds of other shows are dropped.
    """
    both = shows.select("id").distinct().withColumn("_followed", F.lit(True)).join(feeds.groupBy("id").agg(F.max(F.coalesce("fetched_at", F.lit(0))).alias("_at")), "id", "full")
    stale = F.col("_at").isNull() | (now - F.col("_at") > seconds * 1000)
    action = F.when(F.col("_followed").isNull(), F.lit("drop")).when(stale, F.lit("read"))
    return both.select("id", action.alias("action")).filter(F.col("action").isNotNull())


def downloads(shows: DataFrame, episodes: DataFrame, progress: DataFrame, queue: DataFrame, saved: DataFrame, declined: DataFrame, keep_played: bool = False) -> DataFrame:
    """What to fetch and what to drop: id, action. shows: show, keep; episodes: id, show, url, published; progress: id, p,
    done; queue, declined: id; saved: id, show, auto.

    Wanted are each show's newest ``keep`` episodes that are not played and not declined. Copies saved by hand, queued or
    started ones stay; played ones go unless kept; the others go if their show wants them no more.
    """
    done = progress.filter(F.coalesce("done", F.lit(False))).select("id").distinct().withColumn("_done", F.lit(True))
    busy = queue.select("id").unionByName(progress.filter(~F.coalesce("done", F.lit(False)) & (F.col("p") > 5)).select("id")).distinct().withColumn("_busy", F.lit(True))
    open_ = episodes.filter(F.col("url").isNotNull()).join(done, "id", "left_anti").join(declined.select("id").distinct(), "id", "left_anti")
    place = F.row_number().over(Window.partitionBy("show").orderBy(F.desc(F.coalesce("published", F.lit(0))), F.col("id")))
    wanted = open_.join(shows.filter("keep > 0").select("show", "keep"), "show").withColumn("_rank", place).filter(F.col("_rank") <= F.col("keep")).select("id", "show")
    fetch = wanted.join(saved.select("id"), "id", "left_anti").select("id", F.lit("fetch").alias("action"))
    known = episodes.select("show").distinct().withColumn("_known", F.lit(True))
    auto = saved.filter("auto").join(busy, "id", "left").filter(F.col("_busy").isNull()).join(done, "id", "left")
    auto = auto.join(shows.select("show", "keep"), "show", "left").join(known, "show", "left").join(wanted.select("id", F.lit(True).alias("_wanted")), "id", "left")
    off = F.coalesce("keep", F.lit(0)) == 0
    gone = F.when(F.coalesce("_done", F.lit(False)), F.lit(not keep_played)).otherwise(off | (F.coalesce("_known", F.lit(False)) & F.col("_wanted").isNull()))
    return fetch.unionByName(auto.filter(gone).select("id", F.lit("drop").alias("action")))


def new_episodes(before: DataFrame, after: DataFrame, now: int, per_show: int = 2, max_age_days: int = 3) -> DataFrame:
    """Episodes of a feed's new reading that the one before had not: the newest ``per_show`` of the last days.

    A show that was never read before announces nothing.
    """
    known = before.select("show").distinct()
    fresh = after.join(known, "show", "left_semi").join(before.select("show", "id"), ["show", "id"], "left_anti")
    return top_per(fresh.filter(F.col("published") > now - max_age_days * DAY), ["show"], [F.desc("published"), F.col("id")], per_show)


def forgotten(kind: Column, at: Column, gone: Column, idle: Column, now: int) -> Column:
    """Whether a library record is old enough to go: tombstones of shows after 90 days, idle episodes after 30, wishes after 21."""
    age = now - at
    return F.when(kind == "subs", gone & (age > 90 * DAY)).when(kind == "eps", idle & (age > 30 * DAY)).when(kind == "wants", age > 21 * DAY).otherwise(F.lit(False))


def admit(queue: DataFrame, group: str, order: str, minutes: str, left: float) -> DataFrame:
    """What fits into the time left when taken in order, an item that does not fit being passed over: an array fold."""
    item = F.struct(F.col(order), F.col(minutes).cast("double").alias("need"))
    rows = queue.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("_q"))
    kind = dict(queue.dtypes)[order]
    zero = F.struct(F.lit(float(left)).alias("left"), F.array().cast(f"array<{kind}>").alias("out"))
    fold = F.aggregate("_q", zero, lambda a, x: F.struct((a["left"] - F.when(x["need"] <= a["left"], x["need"]).otherwise(0.0)).alias("left"), F.when(x["need"] <= a["left"], F.array_append(a["out"], x[order])).otherwise(a["out"]).alias("out")))
    return rows.select(group, F.explode(fold["out"]).alias(order))
