"""Times and texts brought into line: parts over talk, labels to quiet moments, words by edit distance, clips by envelope."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.operators.intervals import merge_spans, overlap_join
from chronotext.session import ship


def retimed(parts: DataFrame, turns: DataFrame, keys: list[str], least: float = 0.3, bucket: float = 60.0) -> DataFrame:
    """Parts with their time shared out over the stretches where someone talks: the columns of ``parts``.

    parts: keys, g (what a part was cut from), k (order in it), start, end, text; turns: keys, start, end. The parts of a g
    share its talk by their lengths in characters: a part begins where so much talk has passed, at the next stretch if a
    stretch ends there, and ends likewise, at the end of that stretch. A g of one part, or of which less than a share
    ``least`` is talk, stays as it is; so do the first start and the last end. Turns may overlap; null texts have no
    length. Talk is summed per g and looked up by its seconds, so no join is on time alone.
    """
    by = [*keys, "g"]
    whole = parts.groupBy(*by).agg(F.min_by("start", "k").alias("_s"), F.max_by("end", "k").alias("_e"), F.count(F.lit(1)).alias("_n"), F.min("k").alias("_k0"), F.max("k").alias("_k1")).filter("_n > 1 AND _e > _s")
    spans = turns.select(*keys, F.col("start").alias("r_start"), F.col("end").alias("r_end")).filter("r_end > r_start")
    met = overlap_join(whole.select(*by, "_s", "_e"), spans, keys, bucket, ("_s", "_e"))
    clipped = met.select(*by, F.greatest("_s", "r_start").alias("start"), F.least("_e", "r_end").alias("end"))
    talk = merge_spans(clipped, by)
    before = Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    talk = talk.withColumn("length", F.col("end") - F.col("start")).withColumn("before", F.coalesce(F.sum("length").over(before), F.lit(0.0)))
    held = talk.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("start", "length", "before"))).alias("_talk"), F.sum("length").alias("_sum"))
    chosen = whole.join(held, by).filter(F.col("_sum") >= least * (F.col("_e") - F.col("_s")))
    rows = parts.join(chosen, by, "left").withColumn("_c", F.coalesce(F.length("text"), F.lit(0)))
    group = Window.partitionBy(*by)
    share = lambda upto: F.col("_sum") * upto / F.nullif(F.sum("_c").over(group), F.lit(0))
    rows = rows.withColumn("_through", F.sum("_c").over(group.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))).withColumns({"_from": share(F.col("_through") - F.col("_c")), "_to": share(F.col("_through"))})

    def wall(x: Column, begins: bool) -> Column:
        held = F.filter("_talk", lambda s: (x - s["before"] < s["length"]) if begins else (x - s["before"] <= s["length"]))
        return F.coalesce(F.get(held, 0)["start"] + x - F.get(held, 0)["before"], F.col("_e"))

    moved = F.col("_from").isNotNull()
    start = F.when(moved & (F.col("k") > F.col("_k0")), wall(F.col("_from"), True)).otherwise(F.col("start"))
    end = F.when(moved & (F.col("k") < F.col("_k1")), wall(F.col("_to"), False)).otherwise(F.col("end"))
    return rows.withColumns({"_a": start, "_b": end}).withColumns({"start": F.col("_a"), "end": F.col("_b")}).select(*parts.columns)


def quiet_timeline(labels: DataFrame, frames: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """Runs of one label with each change moved to the quietest frame within half a second: keys, start, end, label.

    labels: keys, t (whole seconds from 0, none missing), label; frames: keys, f (from 0), db; ``rate`` frames a second.
    Equally quiet frames: the one at the change itself, else the first; no frame near it leaves the change where it is.
    Runs that a moved change empties are left out. A change meets frames by the second they lie in.
    """
    w = Window.partitionBy(*keys).orderBy("t")
    changes = labels.withColumns({"_was": F.lag("label").over(w), "_first": F.lag("t").over(w).isNull()}).filter(~F.col("_first") & ~F.col("_was").eqNullSafe(F.col("label")))
    centre = F.floor(F.col("t") * rate)
    near = changes.select(*keys, "t", F.greatest(F.lit(0), F.floor((F.col("t") - 0.5) * rate)).alias("_a"), F.floor((F.col("t") + 0.5) * rate).alias("_b"), centre.alias("_c"))
    near = near.withColumn("_sec", F.explode(F.sequence(F.floor(F.col("_a") / rate), F.floor(F.col("_b") / rate))))
    met = near.join(frames.withColumn("_sec", F.floor(F.col("f") / rate)), [*keys, "_sec"]).filter("f >= _a AND f <= _b AND db IS NOT NULL")
    best = met.groupBy(*keys, "t").agg(F.min(F.struct("db", (F.col("f") != F.col("_c")).alias("_off"), "f"))["f"].alias("_f"))
    moved = changes.join(best, [*keys, "t"], "left").select(*keys, "t", "_was", "label", ((F.coalesce("_f", centre) + 0.5) / rate).alias("at"))
    last = labels.groupBy(*keys).agg((F.max("t") + 1).cast("double").alias("at"), F.max_by("label", "t").alias("_was")).withColumns({"t": F.lit(None).cast(labels.schema["t"].dataType)})
    ends = moved.select(*keys, "t", "at", F.col("_was").alias("label")).unionByName(last.select(*keys, "t", "at", F.col("_was").alias("label")))
    order = Window.partitionBy(*keys).orderBy(F.col("t").asc_nulls_last())
    runs = ends.withColumn("start", F.coalesce(F.lag("at").over(order), F.lit(0.0)))
    return runs.filter("at > start").select(*keys, "start", F.col("at").alias("end"), "label")


def edit_bits(a: list[int], match: Callable[[int], int], size: int, plus: int, minus: int, rows: list[tuple[int, int]] | None = None) -> tuple[int, int]:
    """The steps along a row of the edit-distance table, ``len(a)`` rows further down: where it goes up, where down, as bits.

    Bit j of ``plus`` (``minus``) says that the row rises (falls) by one from place j to j + 1 of ``size``; match(word): the
    places of the other text where it stands. One row is a few operations on whole bit vectors (Myers 1999, Hyyrö 2003).
    ``rows`` gets for each row where its diagonal steps cost nothing and where its value is one more than above.
    """
    whole = (1 << size) - 1
    for word in a:
        equal = match(word) & whole
        free = ((((equal & plus) + plus) ^ plus) | equal | minus) & whole
        more = minus | whole ^ (free | plus)
        if rows is not None:
            rows.append((free, more))
        less, more = (free & plus) << 1, more << 1 | 1
        plus, minus = (less | ~(free | more)) & whole, more & free
    return plus, minus


def aligned(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of places of equal words on a cheapest way from the beginnings of both to the end of ``a``; ``b`` may go on.

    Only every so many rows of the table are kept, the band between two of them is made again on the way back, so memory
    follows len(b) times the root of len(a), in bits. A diagonal step goes before leaving out a word of ``a``, that before
    one of ``b``; of equally cheap ends the first.
    """
    words, others = a.tolist(), b.tolist()
    n, m, band = len(words), len(others), max(1, int(len(words) ** 0.5))
    places: dict[int, list[int]] = {}
    for j, word in enumerate(others):
        places.setdefault(word, []).append(j)

    @lru_cache(band)
    def match(word: int) -> int:
        bits = bytearray(m // 8 + 1)
        for j in places.get(word, ()):
            bits[j >> 3] |= 1 << (j & 7)
        return int.from_bytes(bits, "little")

    def spread(bits: int) -> np.ndarray:
        return np.unpackbits(np.frombuffer(bits.to_bytes(m // 8 + 1, "little"), np.uint8), count=m, bitorder="little").astype(np.int64)

    kept = [((1 << m) - 1, 0)]
    for i in range(0, n, band):
        kept.append(edit_bits(words[i : i + band], match, m, *kept[-1]))
    j = int(np.r_[0, np.cumsum(spread(kept[-1][0]) - spread(kept[-1][1]))].argmin())
    pairs = []
    for k in range(len(kept) - 2, -1, -1):
        low = k * band
        whole = (1 << j) - 1
        rows: list[tuple[int, int]] = []
        edit_bits(words[low : low + band], match, j, kept[k][0] & whole, kept[k][1] & whole, rows)
        i = len(rows)
        while i and j:
            free, more = rows[i - 1]
            same = words[low + i - 1] == others[j - 1]
            if same or not free >> (j - 1) & 1:
                if same:
                    pairs.append((low + i - 1, j - 1))
                i, j = i - 1, j - 1
            elif more >> (j - 1) & 1:
                i -= 1
            else:
                j -= 1
        if not j:
            break
    return pairs[::-1]


def align_words(heard: DataFrame, known: DataFrame, key: str, more: float = 1.5, least: int = 200) -> DataFrame:
    """Words of a recognised text against those of a known one: key, heard_pos, known_pos of each pair of equal words.

    heard, known: key, pos, word. Both are taken in the order of pos; the known text may go on, and is looked at up to
    ``more`` times the heard words and ``least`` beyond. A key without words on either side has no pairs. Null words equal
    nothing. One key, a recording, is one group; see ``aligned`` for its memory.
    """
    ship(heard.sparkSession)
    a, b = (d.select(F.col(key).alias(f"_{side}"), F.col("pos").cast("long").alias("pos"), F.col("word").alias("word")) for side, d in (("a", heard), ("b", known)))

    def words(table: pa.Table) -> tuple[list, list]:
        if not table.num_rows:
            return [], []
        rows = sorted(zip(table["pos"].to_pylist(), table["word"].to_pylist(), strict=True), key=lambda r: r[0])
        return [p for p, _ in rows], [w for _, w in rows]

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        (ap, aw), (bp, bw) = words(left), words(right)
        bw = bw[: int(len(aw) * more + 0.5) + least]
        number = {w: i for i, w in enumerate(dict.fromkeys([*aw, *bw]))}
        pairs = aligned(np.array([number[w] if w is not None else -1 for w in aw]), np.array([number[w] if w is not None else -2 for w in bw])) if aw and bw else []
        keys = (left["_a"] if left.num_rows else right["_b"]).combine_chunks().take(pa.array([0] * len(pairs), pa.int64()))
        return pa.table([keys, pa.array([ap[i] for i, _ in pairs], pa.int64()), pa.array([bp[j] for _, j in pairs], pa.int64())], names=[key, "heard_pos", "known_pos"])

    kind = heard.schema[key].dataType.simpleString()
    return a.groupBy("_a").cogroup(b.groupBy("_b")).applyInArrow(fold, f"{key} {kind}, heard_pos long, known_pos long")


def envelope(x: np.ndarray, width: int) -> np.ndarray:
    """The mean size of the last ``width`` samples, less its own mean."""
    total = np.cumsum(np.abs(x))
    out = (total - np.r_[np.zeros(width), total][: len(x)]) / width
    return out - out.mean() if len(out) else out


def correlations(x: np.ndarray, y: np.ndarray, lags: int) -> np.ndarray:
    """Sums of x[i] * y[i + d] for d from 0 to ``lags``, by blocks of x: a long clip is never transformed as a whole."""
    size = 1 << max(10, (4 * (lags + 1) - 1).bit_length())
    take = size - lags
    out = np.zeros(lags + 1)
    for at in range(0, len(x), take):
        part = np.zeros(size)
        part[: len(x[at : at + take])] = x[at : at + take]
        other = np.zeros(size)
        piece = y[at : at + size]
        other[: len(piece)] = piece
        out += np.fft.irfft(np.conj(np.fft.rfft(part)) * np.fft.rfft(other), size)[: lags + 1]
    return out


def envelope_lags(clips: DataFrame, tracks: DataFrame, key: str, most: int, width: int = 44) -> DataFrame:
    """By how many samples a track runs behind a clip: key, lag, peak. clips, tracks: key, pos, x (samples in order of pos).

    A track covers its clip's time and ``most`` samples on either side, so a lag lies between -most and most: the peak of
    the cross-correlation of their envelopes, the first of equal ones. peak: the correlation there over what the two
    envelopes could reach (0 to 1), by which a doubtful lag can be refused; null, as the lag, where either is missing or
    even. One key, a probe of some seconds, is one group. Several probes go on to ``speech.lag_consensus``.
    """
    ship(clips.sparkSession)

    def samples(table: pa.Table) -> np.ndarray:
        if not table.num_rows:
            return np.zeros(0)
        order = np.argsort(table["pos"].to_numpy(), kind="stable")
        return np.nan_to_num(table["x"].to_numpy().astype(float))[order]

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        x, y = envelope(samples(left), width), envelope(samples(right), width)
        keys = left["_a"] if left.num_rows else right["_b"]
        lag = peak = None
        if len(x) and len(y) and x.any() and y.any():
            c = correlations(x, y, 2 * most)
            best = int(c.argmax())
            part = y[best : best + len(x)]
            lag, peak = best - most, float(max(0.0, c[best]) / max(1e-300, np.linalg.norm(x) * np.linalg.norm(part)))
        return pa.table([keys.slice(0, 1), pa.array([lag], pa.int64()), pa.array([peak], pa.float64())], names=[key, "lag", "peak"])

    a, b = (d.select(F.col(key).alias(f"_{side}"), F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x")) for side, d in (("a", clips), ("b", tracks)))
    kind = clips.schema[key].dataType.simpleString()
    return a.groupBy("_a").cogroup(b.groupBy("_b")).applyInArrow(fold, f"{key} {kind}, lag long, peak double")
