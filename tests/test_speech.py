"""Operators on recognised speech and audio headers, on literal cases and against loops."""

import random
import struct

import numpy as np

from pyspark.sql import functions as F

from chronotext.operators import folds, speech
from chronotext.sources import audio


def test_sentences_share_the_time(spark):
    parts = spark.createDataFrame([("e", 0, 0.0, 10.0, "Well then. Nobody knows? we asked. 12 did."), ("e", 1, 10.0, 12.0, "one")], "e string, seq int, start double, end double, text string")
    rows = speech.sentence_parts(parts, ["e"]).orderBy("seq", "k").collect()
    assert [r["text"] for r in rows] == ["Well then.", "Nobody knows? we asked.", "12 did.", "one"]
    assert rows[0]["start"] == 0 and abs(rows[2]["end"] - 10) < 1e-9 and all(a["end"] == b["start"] for a, b in zip(rows[:2], rows[1:3], strict=True))


def test_names_are_assigned_greedily(spark):
    draw = np.random.default_rng(8)
    votes = [(int(k), int(v), f"n{n}", float(w)) for k, v, n, w in zip(draw.integers(0, 20, 600), draw.integers(0, 11, 600), draw.integers(0, 12, 600), draw.integers(1, 4, 600), strict=True)]
    want = set()
    for key in range(20):
        total = {}
        for k, v, n, w in votes:
            if k == key:
                total[v, n] = total.get((v, n), 0) + w
        voices, names = set(), set()
        for c, v, n in sorted((-c, v, n) for (v, n), c in total.items() if c >= 2):
            if v not in voices and n not in names:
                voices.add(v)
                names.add(n)
                want.add((key, v, n))
    got = speech.assign_names(spark.createDataFrame(votes, "e int, voice int, name string, weight double"), "e").collect()
    assert {tuple(r) for r in got} == want


def test_sponsor_breaks(spark):
    said = "use promo code HARBOUR today"
    rows = [("e", 0.0, 30.0, 0, "hello there"), ("e", 30.0, 45.0, 0, said), ("e", 60.0, 80.0, 0, said), ("e", 100.0, 120.0, 1, said), ("e", 500.0, 503.0, 1, said)]
    got = speech.sponsor_breaks(spark.createDataFrame(rows, "e string, start double, end double, speaker int, text string"), "e").orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in got] == [(30.0, 80.0), (100.0, 120.0)]


def test_trouble_and_languages(spark):
    rows = spark.createDataFrame([("no trouble here at all, we say enough words for it", 5.0), ("aaaaa", 1.0), ("yes. yes. yes. yes.", 5.0), ("few words", 20.0)], "t string, s double")
    assert [r[0] for r in rows.select(speech.trouble(F.col("t"), F.col("s"))).collect()] == [0, 1, 1, 1]
    scores = spark.createDataFrame([(1, "en", 0.1), (1, "no", 0.3), (1, "sv", 0.35), (1, "ja", 0.25), (2, "en", 0.6), (2, "fr", 0.4)], "w int, lang string, prob double")
    assert [(r["w"], r["code"], round(r["prob"], 2)) for r in speech.foreign_language(scores, ["w"], ["en"]).collect()] == [(1, "no", 0.65)]


def test_glossary_merge(spark):
    old = spark.createDataFrame([("g", "Sayosh = Sayash"), ("g", "Tidewater")], "k string, line string")
    new = spark.createDataFrame([("g", "sayosh = Sayesh")], "k string, line string")
    assert {r["line"] for r in speech.merge_glossary(old, new, "k").collect()} == {"sayosh = Sayesh", "Tidewater"}


def test_path_prefers_long_evidence(spark):
    parts = spark.createDataFrame([("e", 0, 0.0, 4.0, "Who is it?"), ("e", 1, 4.0, 8.0, "It is me."), ("e", 2, 8.0, 8.4, "Hm."), ("e", 3, 8.4, 12.0, "And so on.")], "e string, seq int, start double, end double, text string")
    talk = spark.createDataFrame([("e", 0, 0, 4.0), ("e", 1, 1, 4.0), ("e", 2, 0, 0.4), ("e", 3, 1, 3.6)], "e string, seq int, voice int, seconds double")
    assert [r["speaker"] for r in folds.label_path(parts, talk, "e").orderBy("seq").collect()] == [0, 1, 1, 1]


def test_audio_headers(spark, tmp_path):
    wav = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 44100, 176400, 4, 16) + b"data" + struct.pack("<I", 8) + b"\0" * 8
    frame = lambda n, t: n + struct.pack(">I", len(t) + 1) + b"\0\0\x03" + t
    body = frame(b"TIT2", "Tittel å".encode()) + frame(b"TPE1", b"Someone")
    size = len(body)
    mp3 = b"ID3\x03\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + body
    for name, data in (("a.wav", wav), ("b.mp3", mp3), ("c.txt", b"plain text here")):
        (tmp_path / name).write_bytes(data)
    rows = {r["path"][-5:]: r for r in audio.read_headers(spark, str(tmp_path)).collect()}
    assert (rows["a.wav"]["kind"], rows["a.wav"]["rate"], rows["a.wav"]["channels"], rows["a.wav"]["data_bytes"]) == ("wav", 44100, 2, 8)
    assert (rows["b.mp3"]["title"], rows["b.mp3"]["artist"]) == ("Tittel å", "Someone")
    assert rows["c.txt"]["kind"] is None


def test_foreign_language_names(spark):
    """Which language a window is named after, with the own languages and their neighbours given."""
    cases = [
        ({"en": 0.01, "no": 0.93, "da": 0.04, "sv": 0.02}, ["en"], "no"),
        ({"en": 0.4, "de": 0.55}, ["en"], None),
        ({"en": 0.25, "de": 0.72}, ["en"], None),
        ({"en": 0.04, "de": 0.3, "fr": 0.3, "ja": 0.36}, ["en"], None),
        ({"nn": 0.9, "no": 0.08, "en": 0.02}, ["no", "nn", "da", "sv"], None),
        ({"en": 0.95, "no": 0.03}, ["no", "nn", "da", "sv"], "en"),
        ({"no": 0.53, "sv": 0.46, "en": 0.01}, ["en"], "no"),
        ({"de": 0.49, "da": 0.33, "en": 0.13}, ["en"], "de"),
        ({"da": 0.44, "de": 0.38, "en": 0.04, "sv": 0.1}, ["en"], "da"),
        ({"en": 0.01, "sv": 0.52, "no": 0.4, "da": 0.05}, ["en"], "no"),
        ({"en": 0.01, "sv": 0.85, "no": 0.1}, ["en"], "sv"),
    ]
    for probs, own, code in cases:
        rows = spark.createDataFrame([(1, k, p) for k, p in probs.items()], "w int, lang string, prob double")
        assert [r["code"] for r in speech.foreign_language(rows, ["w"], own).collect()] == ([] if code is None else [code]), probs


def test_shared_files_and_challenge_pages(spark):
    from chronotext.functions import web

    urls = ["https://www.dropbox.com/s/abc/x.mp3?dl=0", "https://www.dropbox.com/scl/fi/a/x.mp3?rlkey=1&dl=0", "https://dropbox.com/sh/a/x.mp3?dl=0&k=2", "https://www.dropbox.com/home", "https://notdropbox.com/s/a", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(web.dropbox_direct(F.col("u"))).collect()]
    assert got == ["https://dl.dropboxusercontent.com/s/abc/x.mp3", "https://dl.dropboxusercontent.com/scl/fi/a/x.mp3?rlkey=1", "https://dl.dropboxusercontent.com/sh/a/x.mp3?k=2", None, None, None]
    pages = ["<title>Just a moment...</title>", "<title>News</title>wait just a moment", "<script src=/cdn/challenge-platform/x>", None]
    assert [r[0] for r in spark.createDataFrame([(p,) for p in pages], "p string").select(web.is_challenge(F.col("p"))).collect()] == [True, False, True, False]


def test_downloads_keep_more_than_64(spark):
    from chronotext.plans import planners

    shows = spark.createDataFrame([("a", 80)], "show string, keep int")
    episodes = spark.createDataFrame([(i, "a", "u", i) for i in range(100)], "id long, show string, url string, published long")
    none = lambda schema: spark.createDataFrame([], schema)
    rows = planners.downloads(shows, episodes, none("id long, p double, done boolean"), none("id long"), none("id long, show string, auto boolean"), none("id long")).collect()
    assert sorted(r["id"] for r in rows) == list(range(20, 100))


def test_attempts_made_against_a_loop(spark):
    draw = random.Random(12)
    rows = [(e, w, a, draw.choice([0, 0, 1, 2, None]), draw.randint(0, 9)) for e in range(8) for w in range(draw.randint(1, 25)) for a in range(1, draw.randint(2, 4))]
    got = {(r["e"], r["window"]): (r["tried"], r["attempt"]) for r in speech.attempts_made(spark.createDataFrame(rows, "e int, window int, attempt int, troubles int, n_words int"), ["e"]).collect()}
    want = {}
    for e in range(8):
        useless = 0
        for w in sorted({r[1] for r in rows if r[0] == e}):
            tried = []
            for a, t, n in sorted((r[2], r[3] or 0, r[4]) for r in rows if r[:2] == (e, w)):
                tried.append((t, -n, a))
                if not t or useless >= 3:
                    break
            best = min(tried)
            useless += len(tried) > 1 and best[0] > 0
            want[e, w] = (len(tried), best[2])
    assert got == want


def test_minor_voices(spark):
    rows = [(1, 0, 0.0, 290.0), (1, 1, 290.0, 298.0), (1, 2, 298.0, 307.0), (1, 2, 307.0, 308.0), (1, None, 0.0, 99.0), (1, 3, 5.0, 5.0), (2, 0, 0.0, 290.0), (2, 1, 290.0, 291.0)]
    segs = spark.createDataFrame(rows, "e int, speaker int, start double, end double")
    assert [(r["e"], r["speaker"]) for r in speech.minor_voices(segs, "e").collect()] == [(1, 1)]
    assert speech.minor_voices(segs, "e", spark.createDataFrame([(1, 1)], "e int, speaker int")).count() == 0
