"""Times, durations and playback arithmetic as expressions. Rounding is half up, towards plus infinity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int = 0) -> Column:
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def clock(seconds: Column) -> Column:
    """H:MM:SS, or M:SS under an hour; never below zero."""
    s = F.greatest(half_up(seconds), F.lit(0)).cast("long")
    h, m = F.expr("0") + F.floor(s / 3600), F.floor((s % 3600) / 60)
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s % 60)).otherwise(F.format_string("%d:%02d", m, s % 60))


def stamp(seconds: Column, mark: str = ",") -> Column:
    """HH:MM:SS and milliseconds, as subtitles have it."""
    ms = half_up(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def parse_clock(text: Column) -> Column:
    """Seconds of ``12``, ``1:02`` or ``1:02:03``; null where minutes or seconds pass 59 or the text is none."""
    t = F.trim(text)
    part = F.transform(F.split(t, ":"), lambda x: x.try_cast("double"))
    value = F.aggregate(part, F.lit(0.0), lambda a, x: a * 60 + x)
    small = F.forall(F.slice(part, 2, 2), lambda x: x <= 59)
    return F.when(t.rlike(r"^\d+(\.\d+)?$"), t.try_cast("double")).when(t.rlike(r"^\d{1,3}:\d{1,2}(:\d{1,2})?$") & small, value)


def status(done: Column, position: Column) -> Column:
    return F.when(F.coalesce(done, F.lit(False)), "done").when(position > 5, "started").otherwise("new")


def fraction(done: Column, position: Column, held: Column, duration: Column) -> Column:
    d = F.coalesce(F.nullif(held, F.lit(0)), F.nullif(duration, F.lit(0)))
    return F.when(done, 1.0).when(d.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(position, F.lit(0.0)) / d)))


def finished(position: Column, duration: Column) -> Column:
    return (duration > 60) & (position >= duration - F.least(F.lit(20.0), duration * 0.02))


def rewind(paused: Column) -> Column:
    """Seconds to play again after a pause of so many milliseconds."""
    return F.when(F.coalesce(paused, F.lit(0)) < 60_000, 0).when(paused < 600_000, 3).when(paused < 3_600_000, 8).when(paused < 86_400_000, 15).otherwise(25)


def resume_at(done: Column, position: Column, paused: Column) -> Column:
    return F.when(F.coalesce(done, F.lit(False)) | ~(position > 5), 0.0).otherwise(F.greatest(F.lit(0.0), position - rewind(paused)))


def left_text(position: Column, duration: Column, rate: Column) -> Column:
    s = F.greatest(F.lit(0.0), duration - position) / rate
    m = half_up(s / 60).cast("long")
    return F.when(~(duration > 0), "").when(s < 50, "under a minute left").when(m < 60, F.concat(m, F.lit(" min left"))).otherwise(F.concat(F.floor(m / 60), F.lit(" h "), m % 60, F.lit(" min left")))


def length_text(seconds: Column) -> Column:
    m = F.greatest(F.lit(1), half_up(seconds / 60)).cast("long")
    rest = F.when(m % 60 > 0, F.concat(F.lit(" "), m % 60, F.lit(" min"))).otherwise("")
    return F.when(~(seconds > 0), "").when(m < 60, F.concat(m, F.lit(" min"))).otherwise(F.concat(F.floor(m / 60), F.lit(" h"), rest))


def backoff(failures: Column) -> Column:
    return F.when(failures > 0, F.least(F.lit(7_200_000.0), 60_000 * F.pow(F.lit(2.0), failures - 1))).otherwise(0.0)


SPEEDS = (0.8, 1.0, 1.2, 1.5, 1.8, 2.0, 2.5, 3.0)


def next_speed(rate: Column) -> Column:
    steps = F.array(*map(F.lit, SPEEDS))
    return F.coalesce(F.array_min(F.filter(steps, lambda s: s > rate + 0.001)), F.lit(SPEEDS[0]))


CELLS = (15, 30, 60, 120, 180, 300, 600, 900, 1800)


def cell_seconds(total: Column, most: int = 48) -> Column:
    """The smallest grid step that needs at most ``most`` cells; beyond the list whole minutes."""
    fit = F.array_min(F.filter(F.array(*map(F.lit, CELLS)), lambda s: total / s <= most))
    return F.coalesce(fit, (F.ceil(total / most / 60) * 60).cast("int"))


def day_label(day: Column, today: Column) -> Column:
    age = F.date_diff(today, day)
    return F.when(age == 0, "Today").when(age == 1, "Yesterday").when(age.between(2, 6), F.date_format(day, "EEEE")).otherwise(F.date_format(day, "yyyy-MM-dd"))


def job_percent(position: Column, total: Column) -> Column:
    return F.when(total > 0, F.least(F.lit(99), F.floor(100 * position / total))).cast("int")


def minutes_left(position: Column, total: Column, elapsed: Column) -> Column:
    pace = F.when((elapsed >= 60) & (position > 0), position / elapsed)
    return F.when(pace.isNotNull() & (total > 0), F.greatest(F.lit(1), half_up((total - position) / pace / 60 + 1))).cast("int")
