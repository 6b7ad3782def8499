"""Periodic runs against a search of all periods."""

import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from chronotext.llm import periodic, queries


def plain_runs(words, least=2, times=2):
    """All maximal stretches in which words q apart are the same, q being the smallest such distance."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                run = words[i : j + q]
                if not any(run[p:] == run[:-p] for p in range(1, q)):
                    out.append((i, len(run), q))
            i = j + 1
    return sorted((r for r in out if r[1] >= max(least, times * r[2])), key=lambda r: (r[0], r[2]))


def plain_words(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c == " " or "\x09" <= c <= "\x0d":
            words += [word] if word else []
            word = ""
        else:
            word += c
    return words


def plain_collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))


def test_all_runs_of_random_sequences():
    draw = random.Random(5)
    for _ in range(1500):
        letters = draw.choice([1, 2, 3, 5])
        words = [draw.randrange(letters) for _ in range(draw.randint(2, 45))]
        unit = [draw.randrange(letters) for _ in range(draw.randint(1, 6))]
        at = draw.randint(0, len(words))
        words = words[:at] + unit * draw.randint(1, 6) + words[at:]
        assert sorted(periodic.runs_of(np.array(words))) == sorted(plain_runs(words))


def test_batches_of_texts_and_other_limits():
    draw = random.Random(6)
    for _ in range(400):
        texts = []
        for _ in range(draw.randint(0, 6)):
            letters = draw.choice([1, 2, 3, 30])
            words = [draw.randrange(letters) for _ in range(draw.randint(0, 50))]
            for _ in range(draw.randint(0, 2)):
                at = draw.randint(0, len(words))
                words = words[:at] + [draw.randrange(letters) for _ in range(draw.randint(1, 6))] * draw.randint(2, 7) + words[at:]
            texts.append(words)
        for least, times in ((6, 4), (2, 2), (5, 3), (30, 2)):
            got = periodic.runs_of_texts(np.array(sum(texts, []), dtype=np.int64), np.array([len(t) for t in texts], dtype=np.int64), least, times)
            assert got == [plain_runs(t, least, times) for t in texts]


def test_a_text_that_is_one_long_run():
    assert periodic.runs_of(np.zeros(60000, dtype=np.int64)) == [(0, 60000, 1)]
    assert periodic.runs_of(np.tile(np.arange(700), 60)) == [(0, 42000, 700)]


def test_odd_rows(spark):
    """Null and empty texts, white space of other kinds, repeated rows, null ids, a long text, clashing columns."""
    texts = [None, "", "  \n", "a a a a a a", " a\tb\x0bA b a b a b a b", "x\x1cx x\x85x \xa0 " * 4, "é ü " * 6, "la " * 5, "w" * 5000 + " v" * 3000, "a b c " * 4000]
    rows = [(i if i % 4 else None, t) for i, t in enumerate(texts)] + [(3, "a a a a a a")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clash = frame.withColumns({c: F.lit("clash") for c in ["runs", "collapsed", "n_words", "start", "length", "period"]})
    got = sorted(((r[0], r[1], [tuple(x) for x in r[2]], r[3]) for r in periodic.find_runs(clash).collect()), key=repr)
    want = []
    for key, text in rows:
        words = plain_words(text)
        runs = plain_runs(words, 6, 4) if len(words) < 5000 else [(0, 12000, 3)]
        want.append((key, len(words), runs, plain_collapsed(words, runs) if len(words) < 5000 else "a b c"))
    assert got == sorted(want, key=repr)
    assert periodic.find_runs(frame.limit(0)).collect() == []


def test_query_equals_plain_search(spark, small):
    rows = {r["doc_id"]: r for r in queries.op13_periodic_runs(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    seen = 0
    for key, text in docs:
        words = plain_words(text)
        h, n = zlib.crc32(str(key).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words, 6, 4)
        seen += len(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        r = rows[key]
        assert (r["n_runs"], r["runs_sha256"]) == (len(runs), digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)))
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r["collapsed_sha256"] == digest(plain_collapsed(words, runs))
    assert seen > 10
