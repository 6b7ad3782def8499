"""Headers of audio files, read from the binary file source: one row for each file, small parsers on its first bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.session import ship

SCHEMA = "kind string, title string, artist string, album string, rate int, channels int, data_bytes long"


def id3_text(body: bytes) -> str:
    """A text frame of a tag: its first byte names the encoding."""
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 3, "latin-1")
    return body[1:].decode(codec, "replace").split("\x00")[0]


def id3_frames(data: bytes) -> dict[str, str]:
    """Text frames of a tag of version 2.2 to 2.4 by their names; a tag cut short gives what is whole."""
    major = data[3]
    size = sum(b << s for b, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    body = data[10 : 10 + size]
    if data[5] & 0x80 and major < 4:
        body = body.replace(b"\xff\x00", b"\xff")
    name, head = (3, 6) if major == 2 else (4, 10)
    out, at = {}, 0
    while at + head <= len(body) and body[at] != 0:
        raw = body[at + name : at + 2 * name]
        length = sum(b << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major == 4 else int.from_bytes(raw, "big")
        label = body[at : at + name].decode("latin-1")
        if label.startswith("T"):
            out[label] = id3_text(body[at + head : at + head + length])
        at += head + length
    return out


def header(data: bytes | None) -> tuple:
    """SCHEMA's values for one file's bytes: wav by its chunks, mp3 by its tag."""
    nothing = (None,) * 7
    if not data or len(data) < 12:
        return nothing
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        at, rate, channels, size = 12, None, None, None
        while at + 8 <= len(data):
            label, length = data[at : at + 4], struct.unpack("<I", data[at + 4 : at + 8])[0]
            if label == b"fmt ":
                channels, rate = struct.unpack("<HI", data[at + 10 : at + 16])
            if label == b"data":
                size = length
                break
            at += 8 + length + length % 2
        return ("wav", None, None, None, rate, channels, size)
    if data[:3] == b"ID3":
        t = id3_frames(data)
        return ("mp3", t.get("TIT2", t.get("TT2")), t.get("TPE1", t.get("TP1")), t.get("TALB", t.get("TAL")), None, None, None)
    return ("mp3", *(None,) * 6) if data[0] == 0xFF and data[1] & 0xE0 == 0xE0 else nothing


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """path, length and SCHEMA for each audio file of a folder; files that are neither wav nor mp3 have a null kind."""
    ship(spark)

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            yield pd.DataFrame([header(c) for c in contents], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", run("content").alias("h")).select("path", "length", "h.*")
