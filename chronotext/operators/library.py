"""Rules of a personal library: followed shows, positions, settings, room on the device."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that stay free at least, and the share of the device that does.
RESERVE, RESERVE_SHARE = 500_000_000, 0.1
#: Bytes of a second of sound, and of an episode of unknown length.
BYTES_A_SECOND, UNKNOWN_SIZE = 16_000, 80_000_000


def size_of(seconds: Column) -> Column:
    """About how many bytes an episode has before it is fetched."""
    return F.when(seconds > 0, seconds * BYTES_A_SECOND).otherwise(F.lit(UNKNOWN_SIZE))


def room_for(quota: Column, usage: Column, size: Column) -> Column:
    """Whether an episode fits beside the reserve; an unknown quota (null or 0) is taken as room."""
    free = quota - F.coalesce(usage, F.lit(0)) - F.coalesce(size, F.lit(0))
    return F.when(F.coalesce(quota, F.lit(0)) == 0, True).otherwise(free >= F.greatest(F.lit(RESERVE), quota * RESERVE_SHARE))


def follow(held: DataFrame, asked: DataFrame, now: int) -> DataFrame:
    """The rows that following writes: id, feed_url, title, gone, added_at, at. held: these columns, one row an id.

    A show that was followed keeps the time it was added; a new one, or one that had been given up, gets ``now``. Fields
    that are null in ``asked`` (id, feed_url, title) keep the held value. Repeated ids in ``asked`` count once, the least row.
    """
    once = asked.groupBy("id").agg(F.min(F.struct("feed_url", "title")).alias("_n"))
    had = held.select("id", F.struct("feed_url", "title", F.coalesce("gone", F.lit(False)).alias("gone"), "added_at").alias("_h"))
    added = F.when(~F.col("_h.gone"), F.col("_h.added_at"))
    fields = [F.coalesce(f"_n.{c}", f"_h.{c}").alias(c) for c in ("feed_url", "title")]
    return once.join(had, "id", "left").select("id", *fields, F.lit(False).alias("gone"), F.coalesce(added, F.lit(now)).alias("added_at"), F.lit(now).alias("at"))


def unfollow(held: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """The marks that giving up shows leaves: id, feed_url, title, gone, at. Ids that are not held leave none."""
    return held.join(ids.select("id").distinct(), "id", "left_semi").select("id", "feed_url", "title", F.lit(True).alias("gone"), F.lit(now).alias("at"))


def set_progress(held: DataFrame, news: DataFrame, key: str, now: int) -> DataFrame:
    """The rows that new positions write: key, p, d, done, at. Both sides: key, p, d, done, one row a key.

    A field that is null in ``news`` keeps the held value, else 0 or false. p is not below 0 and rounded to a tenth, d to
    whole seconds, halves upward.
    """
    had = held.select(key, *(F.col(c).alias(f"_{c}") for c in ("p", "d", "done")))
    p, d = (F.coalesce(c, f"_{c}", F.lit(0.0)) for c in ("p", "d"))
    done = F.coalesce("done", "_done", F.lit(False))
    return news.join(had, key, "left").select(key, F.greatest(F.lit(0.0), F.floor(p * 10 + 0.5) / 10).alias("p"), F.floor(d + 0.5).alias("d"), done.alias("done"), F.lit(now).alias("at"))


def settings(own: Column, defaults: dict[str, str]) -> Column:
    """A map of settings laid over the defaults; null is none of one's own, and null values do not hide a default."""
    base = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    mine = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda _, v: v.isNotNull())
    return F.map_zip_with(base, mine, lambda _, a, b: F.coalesce(b, a))


def by_title(shows: DataFrame, title: str, then: str) -> DataFrame:
    """Shows in the order of their titles, without regard to case and accents; null titles first, like empty ones."""
    return shows.orderBy(F.collate(F.coalesce(title, F.lit("")), "UNICODE_CI_AI"), then)


def newest_kept(rows: DataFrame, most: int, at: str, key: str) -> DataFrame:
    """The ``most`` newest rows, ties by the least key: a top-k, which each task prunes before anything moves."""
    return rows.orderBy(F.desc(at), key).limit(most)
