"""Where the frames of MPEG audio files lie, so that an episode can be decoded a piece at a time.

Files are read in windows, each by itself: a window reports the places that look like frame headers, by arrays over its
bytes. What a decoder would lock on to is then found per file from those few places alone, never from its bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.functions import fixed
from chronotext.session import ship

WINDOW, OVERLAP = 4 << 20, 8192  # no frame is as long as the overlap, so a frame and the header behind it always fit
INFO = re.compile(rb"Xing|Info|VBRI")
PLACES = "path string, size long, place long, length int, samples int, rate int, info boolean"


def header_table() -> np.ndarray:
    """(length without padding, samples, rate, size of a slot) by the bits of a header's second and third bytes that say
    them: version, layer, bit rate, sampling rate; zeros where they say nothing."""
    table = np.zeros((4, 4, 16, 4, 4), dtype=np.int32)
    for version, rates in fixed.MPEG_RATES.items():
        kind = 1 if version == 3 else 2
        for layer in (1, 2, 3):
            kbps = fixed.MPEG_KBPS[kind, layer if kind == 1 or layer == 1 else 2]
            for k in range(1, 15):
                for r, rate in enumerate(rates):
                    if layer == 1:
                        entry = (12_000 * kbps[k] // rate * 4, 384, rate, 4)
                    elif layer == 2 or kind == 1:
                        entry = (144_000 * kbps[k] // rate, 1152, rate, 1)
                    else:
                        entry = (72_000 * kbps[k] // rate, 576, rate, 1)
                    table[version, 4 - layer, k, r] = entry
    return table


TABLE = header_table()


def headers(window: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places of a window with a valid header, and (length, samples, rate) of each."""
    b = np.frombuffer(window, dtype=np.uint8)
    at = np.flatnonzero((b[:-3] == 0xFF) & (b[1:-2] >= 0xE0)) if len(b) >= 4 else np.zeros(0, dtype=np.int64)
    second, third = b[at + 1].astype(np.int64), b[at + 2].astype(np.int64)
    found = TABLE[(second >> 3) & 3, (second >> 1) & 3, third >> 4, (third >> 2) & 3]
    length = found[:, 0] + np.where((third >> 1) & 1, found[:, 3], 0)
    valid = found[:, 2] > 0
    return at[valid], np.stack([length, found[:, 1], found[:, 2]], axis=1)[valid]


def audio_start(window: bytes) -> int:
    """Where audio begins: behind the tag at a file's begin, if there is one."""
    if window[:3] != b"ID3" or len(window) < 10:
        return 0
    a, b, c, d = (x & 127 for x in window[6:10])
    return 10 + (a << 21 | b << 14 | c << 7 | d) + (10 if window[5] & 16 else 0)


def window_places(windows: DataFrame) -> DataFrame:
    """Header places of windows: path, size, place (in the file), length, samples, rate, info (holds a metadata mark).

    windows: path, size, start, bytes; windows of a file begin every ``WINDOW`` bytes and overlap. The first window of a
    file also gives a row without length: where its audio starts. Null bytes are no window.
    """
    ship(windows.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start, data in zip(*(batch.column(i) for i in range(4)), strict=True):
                if (window := data.as_py()) is None:
                    continue
                at, found = headers(window)
                own = at < WINDOW
                at, found = at[own], found[own]
                info = [INFO.search(window, p, p + min(n, 64)) is not None for p, n in zip(at.tolist(), found[:, 0].tolist(), strict=True)]
                places, length, samples, rate = (at + start.as_py()).tolist(), *(found[:, i].tolist() for i in range(3))
                if not start.as_py():
                    places, length, samples, rate, info = [audio_start(window), *places], [None, *length], [None, *samples], [None, *rate], [False, *info]
                n = len(places)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path.as_py()] * n, pa.string()), pa.array([size.as_py()] * n, pa.int64()), pa.array(places, pa.int64()), pa.array(length, pa.int32()), pa.array(samples, pa.int32()), pa.array(rate, pa.int32()), pa.array(info, pa.bool_())],
                    names=[c.split()[0] for c in PLACES.split(", ")],
                )

    return windows.select("path", "size", "start", "bytes").mapInArrow(step, PLACES)


def locked(places: list[int], length: list[int], kind: list[tuple[int, int]], start: int, size: int) -> list[int]:
    """Which places (by number) a decoder takes as frames, from ``start`` on; nothing of an unclean file.

    Out of step, a header counts if another follows at its frame's end or the file ends there; in step every header does.
    Frames of another kind than the first are passed over. A file is unclean if no frame begins in the first megabyte, if
    it has under fifty, or if they cover less than four fifths of it.
    """
    known, taken, covered, first = set(places), [], 0, None
    i, in_step = start, False
    while i < size - 4:
        k = bisect_left(places, i)
        if k < len(places) and places[k] == i and length[k] > 4 and (in_step or i + length[k] >= size - 4 or i + length[k] in known):
            in_step, first = True, first or kind[k]
            if kind[k] == first:
                taken.append(k)
                covered += length[k]
            i += length[k]
            continue
        in_step = False
        k = bisect_left(places, i + 1)
        i = places[k] if k < len(places) else size
        if not taken and i - start > 1 << 20:
            return []
    return taken if len(taken) >= 50 and covered >= (size - start) * 0.8 else []


def frame_index(windows: DataFrame) -> DataFrame:
    """Frames of audio files: path, frame (from 0), place, samples (of a frame), rate. ``windows`` as for ``window_places``.

    A first frame that holds metadata is left out. Files that are not clean give no rows. The places of a file, about one
    in four hundred bytes, are one group.
    """

    def fold(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["length"] is not None, r["place"]))
        size = rows[0]["size"]
        start = min(rows[0]["place"], size) if rows[0]["length"] is None else 0
        rows = [r for r in rows if r["length"] is not None]
        taken = locked([r["place"] for r in rows], [r["length"] for r in rows], [(r["samples"], r["rate"]) for r in rows], start, size)
        if taken and rows[taken[0]]["info"]:
            taken = taken[1:]
        found = [rows[k] for k in taken]
        return pa.table({
            "path": pa.array([r["path"] for r in found], pa.string()), "frame": pa.array(range(len(found)), pa.int64()), "place": pa.array([r["place"] for r in found], pa.int64()),
            "samples": pa.array([r["samples"] for r in found], pa.int32()), "rate": pa.array([r["rate"] for r in found], pa.int32()),
        })

    return window_places(windows).groupBy("path").applyInArrow(fold, "path string, frame long, place long, samples int, rate int")


def cut_windows(contents: DataFrame) -> DataFrame:
    """Windows of files that are held whole: contents has path and content (binary)."""
    size = F.octet_length("content").cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)), F.lit(WINDOW).cast("long"))
    cut = contents.filter(F.col("content").isNotNull()).select("path", size.alias("size"), F.explode(starts).alias("start"), "content")
    return cut.select("path", "size", "start", F.expr(f"substring(content, CAST(start + 1 AS INT), {WINDOW + OVERLAP})").alias("bytes"))


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Windows of the files at ``path``, each read from the store by itself, so that no file is ever held whole."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"))
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(WINDOW).cast("long"))
    wanted = files.select("path", "size", F.explode(starts).alias("start"))
    schema = T.StructType([*wanted.schema, T.StructField("bytes", T.BinaryType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for i in range(batch.num_rows):
                store, name = fs.FileSystem.from_uri(batch.column(0)[i].as_py())
                with store.open_input_file(name) as file:
                    size, start = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                    data = file.read_at(min(WINDOW + OVERLAP, size - start), start)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), pa.array([data], pa.binary())], names=schema.names)

    return wanted.repartition(spark.sparkContext.defaultParallelism, "path", "start").mapInArrow(step, schema)
