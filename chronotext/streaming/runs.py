"""Streams over the tables' files: read, transform, write to a checkpointed folder until all is read, and return it."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronotext.functions.times import half_up
from chronotext.operators.records import latest as newest
from chronotext.operators.sequence import quiet_ranges
from chronotext.session import shared_path, ship, zoned


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's folder or file as a stream of files."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4)
    return zoned(reader.parquet(f"{sf_dir}/{name}*.parquet"))


def run(spark: SparkSession, frame: DataFrame, name: str, mode: str = "append", folder: str | None = None) -> DataFrame:
    """Drain the stream into a parquet table and read it.

    With a ``folder`` of one's own, table and checkpoint stay there: a later run takes up what came since, with the state
    of the one before, also where that one was broken off.
    """
    out = folder or shared_path(spark, name)
    query = frame.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(frame.schema).parquet(out)


def merged(spark: SparkSession, frame: DataFrame, name: str, step: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Fold each micro-batch into a table: state = step(state + batch). A batch that runs again gives the same state."""
    out = shared_path(spark, name)
    spark.createDataFrame([], schema).write.parquet(f"{out}/v-1")
    last = [-1]

    def fold(batch: DataFrame, epoch: int) -> None:
        held = batch.sparkSession.read.schema(schema).parquet(f"{out}/v{epoch - 1}")
        step(held.unionByName(batch)).write.mode("overwrite").parquet(f"{out}/v{epoch}")
        last[0] = epoch

    frame.writeStream.foreachBatch(fold).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(f"{out}/v{last[0]}")


def finite(events: DataFrame) -> DataFrame:
    """A watermark of two months: no row of these tables is late."""
    return events.withWatermark("ts", "60 days")


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir, "events")
    each = e.groupBy("user_id", F.window("ts", "1 hour").alias("w")).agg(F.sum(F.col("value") * F.col("value")).alias("s"), F.count(F.lit(1)).alias("n"))
    # Partial sums leave in update mode by micro-batch; the last of a window is its whole.
    out = shared_path(spark, "levels")
    each.select("user_id", F.unix_seconds("w.start").alias("at"), "s", "n").writeStream.outputMode("update").foreachBatch(lambda b, k: b.withColumn("k", F.lit(k)).write.mode("overwrite").parquet(f"{out}/k{k}")).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.parquet(f"{out}/k*").groupBy("user_id", "at").agg(F.max(F.struct("k", "s", "n")).alias("x"))
    return last.select("user_id", "at", F.least(F.lit(255), F.greatest(F.lit(1), half_up(F.sqrt(F.col("x.s") / F.col("x.n")) * 1.024))).cast("int").alias("level"))


def latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").alias("last"), F.lit(1).cast("long").alias("n"))
    step = lambda df: df.groupBy("user_id", "event_type").agg(F.max("last").alias("last"), F.sum("n").alias("n"))
    return merged(spark, e, "latest", step, "user_id long, event_type string, last timestamp, n long")


def records(spark: SparkSession, changes: DataFrame, keys: list[str], at: str, arrival: str) -> DataFrame:
    """Last writer wins over a stream of changes, as a table that each micro-batch is merged into."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changes.schema)
    return merged(spark, changes, "records", lambda df: newest(df, keys, at, arrival).select(*changes.columns), schema)


def told_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = finite(stream(spark, sf_dir, "events")).dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return run(spark, e.select("user_id", "event_type"), "told")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions by session windows; the stream's end closes what is open (a late marker far ahead would on a live one)."""
    e = stream(spark, sf_dir, "events")
    out = shared_path(spark, "sessions")
    grouped = e.withWatermark("ts", "60 days").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("n"))
    grouped.select("user_id", "first", "n").writeStream.outputMode("complete").foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(f"{out}/all")).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/all")


def voices(spark: SparkSession, sf_dir: str, threshold: float = 0.5, cap: float = 30.0, shortest: float = 2.5) -> DataFrame:
    """Online voices with the voices heard so far as state of each recording."""
    ship(spark)
    rows = stream(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 40).alias("episode_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("v"), (F.col("vec_id") % 7 + 1).cast("double").alias("seconds"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat, weights = state.get if state.exists else ([], [])
        weights = list(weights)
        centres = list(np.array(flat, dtype=float).reshape(len(weights), -1)) if weights else []
        out = []
        for seq, v, weight in sorted((s, tuple(v), w) for b in batches for s, v, w in zip(b["seq"], b["v"], b["seconds"], strict=True)):
            x = np.array(v, dtype=float)
            x /= np.linalg.norm(x) or 1
            like = [float(c @ x) for c in centres]
            best = int(np.argmax(like)) if like else -1
            if best >= 0 and like[best] >= threshold:
                mixed = centres[best] * min(weights[best], cap) + x * weight
                centres[best] = mixed / (np.linalg.norm(mixed) or 1)
                weights[best] += weight
            elif weight < shortest:
                best = best if best >= 0 and like[best] >= 0.7 * threshold else None
            else:
                best = len(centres)
                centres.append(x)
                weights.append(weight)
            out.append((key[0], seq, best))
        state.update(([float(x) for c in centres for x in c], [float(w) for w in weights]))
        yield pd.DataFrame(out, columns=["episode_id", "seq", "voice"]).astype({"voice": "Int32"})

    found = rows.groupBy("episode_id").applyInPandasWithState(step, "episode_id long, seq long, voice int", "centres array<double>, weights array<double>", "append", GroupStateTimeout.NoTimeout)
    return run(spark, found, "voices")


def frame_levels(samples: DataFrame, key: str, size: int) -> DataFrame:
    """Levels of whole frames of a stream of samples: key, frame (from 0), db. samples: key, seq, x.

    State of a key is the frame it is in: its sum of squares, its samples so far and its number, whatever the recording's
    length. A batch is taken in the order of seq; a frame that is not full yet waits for the next one. Null samples are
    silence. Quiet stretches need the levels of a whole recording (``sequence.quiet_ranges`` on the frames written so far).
    """
    ship(samples.sparkSession)
    kind = samples.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        carried, held, frame = state.get if state.exists else (0.0, 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        energy = np.nan_to_num(rows["x"].to_numpy(dtype=float)) ** 2
        sums = np.bincount((held + np.arange(len(energy))) // size, weights=energy, minlength=1)
        sums[0] += carried
        full, rest = divmod(held + len(energy), size)
        state.update((float(sums[full]) if rest else 0.0, int(rest), int(frame + full)))
        yield pd.DataFrame({key: [group[0]] * full, "frame": np.arange(frame, frame + full), "db": 10 * np.log10(sums[:full] / size + 1e-10)})

    return samples.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, frame long, db double", "carried double, held long, frame long", "append", GroupStateTimeout.NoTimeout)


def quiet(spark: SparkSession, sf_dir: str, size: int = 2, fewest: int = 20) -> DataFrame:
    """Quiet stretches of users' values as samples, in seconds of four frames: user_id, start, end."""
    samples = stream(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), (F.col("value") / 100).alias("x"))
    frames = run(spark, frame_levels(samples, "user_id", size), "frames")
    return quiet_ranges(frames, ["user_id"], seconds=0.25, fewest=fewest)


def repeated(start: float, step: float, until: float) -> int:
    """How many steps from ``start`` on end by ``until`` and are, added one by one, to the last bit ``start + k * step``.

    At least one, and at most 65,536: the rest follows from the next start on.
    """
    fine = max(start.as_integer_ratio()[1], step.as_integer_ratio()[1])
    # Sums of multiples of 1 / fine are exact below this; only the last step may round.
    exact = 2**53 / fine
    count = min(int((min(until, exact) - start) / step) + 2, 1 << 16)
    while count > 1 and (start + count * step > until or start + (count - 1) * step > exact):
        count -= 1
    return max(count, 1)


def recognition_stretches(frames: DataFrame, key: str, earliest: float = 18.0, latest: float = 29.5, frame: float = 0.1, groups: int = 1024) -> DataFrame:
    """Windows as ``recognition_windows`` gives them, those of a time without frames together: key, job, n, start, end, count.

    A row is ``count`` windows from number ``n`` on, all but the last of ``latest`` seconds; ``stretched`` makes them single
    ones. So what a stream writes grows with its frames, however long a recording's silence is. Recordings share state by
    a hash of their key, since a call costs far more than a recording in it.
    """
    ship(frames.sparkSession)
    kind = frames.schema[key].dataType.simpleString()

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, found = {}, []
        if state.exists:
            *each, sizes, ats, es = state.get
            ends = np.cumsum(sizes).tolist()
            held = {k: (*rest, list(ats[z - size : z]), list(es[z - size : z])) for k, *rest, size, z in zip(*each, sizes, ends, strict=True)}
        rows = pd.concat(list(batches))
        numbers: dict = {}
        code = np.array([numbers.setdefault(k, len(numbers)) for k in rows["key"].tolist()])
        rows = rows.iloc[np.lexsort((rows["at"], rows["job"], code))]
        code, names, jobs = np.sort(code), list(numbers), rows["job"].to_numpy()
        ats, es, lasts = rows["at"].tolist(), rows["e"].fillna(-np.inf).tolist(), rows["last"].to_numpy()  # no energy: the quietest
        edges = [0, *(np.flatnonzero((np.diff(code) != 0) | (np.diff(jobs) != 0)) + 1).tolist(), len(rows)]
        for a, b in zip(edges, edges[1:], strict=False):
            name = names[code[a]]
            job, n, start, at, e = held.get(name, (-1, 0, 0.0, [], []))
            if not jobs[a] >= job:
                continue
            if jobs[a] > job:
                job, n, start, at, e = int(jobs[a]), 0, 0.0, [], []
            at, e, low = at + ats[a:b], e + es[a:b], 0
            end = at[-1] + frame
            while low < len(at) and end - start > latest:
                if at[low] >= start + latest:  # no frame until then: the windows before it at once
                    count = repeated(start, latest, at[low])
                    cut = start + count * latest
                else:
                    count = 1
                    first, last = bisect_left(at, start + earliest, low), bisect_left(at, start + latest - frame, low)
                    cut = at[e.index(min(e[first:last]), first)] + frame / 2 if last > first else start + latest
                found.append((name, job, n, start, cut, count))
                n, start = n + count, cut
                low = bisect_left(at, start, low)
            at, e = at[low:], e[low:]
            if at and lasts[a:b].any():
                found.append((name, job, n, start, at[-1] + frame, 1))
                n, start, at, e = n + 1, at[-1] + frame, [], []
            held[name] = (job, n, start, at, e)
        kept = list(held.values())
        state.update((list(held), *([x[i] for x in kept] for i in range(3)), [len(x[3]) for x in kept], [a for x in kept for a in x[3]], [a for x in kept for a in x[4]]))
        if found:
            yield pd.DataFrame(found, columns=["key", "job", "n", "start", "end", "count"])

    columns = [F.col("job").cast("long").alias("job"), F.col("at").cast("double").alias("at"), F.col("e").cast("double").alias("e"), F.coalesce("last", F.lit(False)).alias("last")]
    dealt = frames.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("g"), F.col(key).cast("string").alias("key"), *columns).filter("job IS NOT NULL AND at IS NOT NULL")
    held_as = "keys array<string>, jobs array<long>, ns array<int>, starts array<double>, sizes array<int>, at array<double>, e array<double>"
    found = dealt.groupBy("g").applyInPandasWithState(step, "key string, job long, n int, start double, end double, count int", held_as, "append", GroupStateTimeout.NoTimeout)
    return found.select(F.col("key").cast(kind).alias(key), "job", "n", "start", "end", "count")


def stretched(stretches: DataFrame, latest: float = 29.5) -> DataFrame:
    """The single windows of ``recognition_stretches``: its columns without count."""
    each = stretches.select("*", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("_k"))
    end = F.when(F.col("_k") == F.col("count") - 1, F.col("end")).otherwise(F.col("start") + (F.col("_k") + 1) * latest)
    return each.withColumns({"n": F.col("n") + F.col("_k"), "start": F.col("start") + F.col("_k") * latest, "end": end}).drop("count", "_k")


def recognition_windows(frames: DataFrame, key: str, earliest: float = 18.0, latest: float = 29.5, frame: float = 0.1) -> DataFrame:
    """Windows of recordings for a recogniser, cut while they come in: key, job, n (from 0), start, end.

    frames: key, job, at (seconds), e (energy), last. Each cut is the quietest frame between ``earliest`` and ``latest``
    seconds after the one before, as in ``folds.window_cuts``; a row marked last closes what is left. A recording may be
    begun anew as a job of a higher number: the older job's frames then no longer count, whenever they arrive. State of a
    recording is its job, where its open window begins and that window's frames: half a minute and what one batch brings.
    """
    return stretched(recognition_stretches(frames, key, earliest, latest, frame), latest)
