"""Re-timing, moved boundaries, word and clip alignment against plain forms."""

import random

import numpy as np
import pytest

from chronotext.operators import alignment


def plain_retimed(parts, turns, least=0.3):
    """parts of one g: (start, end, text)."""
    s, e = parts[0][0], parts[-1][1]
    inside = [any(a <= x < b for a, b in turns) for x in np.arange(s, e, 0.001) + 0.0005]
    if len(parts) < 2 or sum(inside) < least * len(inside):
        return [(a, b) for a, b, _ in parts]
    ticks = [s + 0.001 * i for i, t in enumerate(inside) if t]
    chars = sum(len(t) for *_, t in parts)
    out, done = [], 0.0
    for i, (_, _, text) in enumerate(parts):
        a = s if i == 0 else ticks[min(len(ticks) - 1, round(done))]
        done += len(text) / chars * len(ticks)
        b = e if i == len(parts) - 1 else ticks[min(len(ticks) - 1, round(done) - 1)] + 0.001
        out.append((a, b))
    return out


def test_parts_take_the_time_of_talk(spark):
    draw = random.Random(5)
    parts, turns, want = [], [], {}
    for g in range(25):
        at = 20.0 * g
        mine = [(at + round(draw.uniform(0, 8), 2), 0) for _ in range(draw.randint(0, 4))]
        mine = [(a, round(a + draw.uniform(0.3, 3), 2)) for a, _ in mine]
        turns += [(1, a, b) for a, b in mine]
        n = draw.randint(1, 4)
        cut = [(at + 10.0 * k / n, at + 10.0 * (k + 1) / n, "x" * draw.randint(1, 30)) for k in range(n)]
        parts += [(1, g, k, a, b, t) for k, (a, b, t) in enumerate(cut)]
        for k, span in enumerate(plain_retimed(cut, mine)):
            want[g, k] = span
    frame = spark.createDataFrame(parts, "e int, g int, k int, start double, end double, text string")
    got = alignment.retimed(frame, spark.createDataFrame(turns, "e int, start double, end double"), ["e"]).collect()
    assert len(got) == len(parts)
    for r in got:
        assert (r["start"], r["end"]) == pytest.approx(want[r["g"], r["k"]], abs=0.004)


def test_a_question_ends_before_the_pause_and_the_answer_begins_behind_it(spark):
    parts = spark.createDataFrame([(1, 0, 0, 0.0, 5.0, "a" * 20), (1, 0, 1, 5.0, 10.0, "b" * 20)], "e int, g int, k int, start double, end double, text string")
    turns = spark.createDataFrame([(1, 0.0, 2.0), (1, 8.0, 10.0)], "e int, start double, end double")
    assert [(r["start"], r["end"]) for r in alignment.retimed(parts, turns, ["e"]).orderBy("k").collect()] == [(0.0, 2.0), (8.0, 10.0)]
    few = spark.createDataFrame([(1, 0.0, 2.9)], "e int, start double, end double")
    assert [(r["start"], r["end"]) for r in alignment.retimed(parts, few, ["e"]).orderBy("k").collect()] == [(0.0, 5.0), (5.0, 10.0)]
    assert alignment.retimed(parts.limit(0), turns, ["e"]).count() == 0
    assert alignment.retimed(parts, turns.limit(0), ["e"]).count() == 2


def plain_timeline(labels, db, rate):
    out, start = [], 0.0
    for t in range(1, len(labels) + 1):
        if t < len(labels) and labels[t] == labels[t - 1]:
            continue
        end = float(t)
        if t < len(labels):
            near = [f for f in range(max(0, int((t - 0.5) * rate // 1)), int((t + 0.5) * rate // 1) + 1) if f < len(db)]
            centre = int(t * rate // 1)
            best = min(near, key=lambda f: (db[f], f != centre, f)) if near else centre
            end = (best + 0.5) / rate
        if end > start:
            out.append((start, end, labels[t - 1]))
        start = end
    return out


@pytest.mark.parametrize("rate", [5.0, 50.0, 43.066])
def test_changes_move_to_quiet_frames(spark, rate):
    draw = random.Random(int(rate))
    labels, frames, want = [], [], []
    for e in range(12):
        mine = [draw.randint(0, 1) for _ in range(draw.randint(1, 12))]
        db = [float(draw.randint(-9, 0)) for _ in range(int(len(mine) * rate) - draw.choice([0, 0, 12]))]
        labels += [(e, t, x) for t, x in enumerate(mine)]
        frames += [(e, f, x) for f, x in enumerate(db)]
        want += [(e, *run) for run in plain_timeline(mine, db, rate)]
    got = alignment.quiet_timeline(spark.createDataFrame(labels, "e int, t int, label int"), spark.createDataFrame(frames, "e int, f int, db double"), ["e"], rate).collect()
    assert [x for r in sorted(map(tuple, got)) for x in r] == pytest.approx([x for r in sorted(want) for x in r])


def plain_aligned(a, b):
    cost = [list(range(len(b) + 1))]
    for i in range(1, len(a) + 1):
        cost.append([i])
        for j in range(1, len(b) + 1):
            cost[i].append(min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1))
    i, j = len(a), cost[-1].index(min(cost[-1]))
    out = []
    while i and j:
        if cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            out += [(i - 1, j - 1)] if a[i - 1] == b[j - 1] else []
            i, j = i - 1, j - 1
        elif cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def test_words_by_edit_distance(spark):
    draw = random.Random(8)
    heard, known, want = [], [], []
    for e in range(40):
        a = [draw.choice("abcde") for _ in range(draw.randint(0, 60))]
        b = [w for w in a if draw.random() > 0.1]
        b = [draw.choice("abcde") if draw.random() < 0.1 else w for w in b] + [draw.choice("abcde") for _ in range(draw.randint(0, 40))]
        assert alignment.aligned(np.array([ord(w) for w in a], dtype=int), np.array([ord(w) for w in b], dtype=int)) == plain_aligned(a, b)
        heard += [(e, 10 * i, w) for i, w in enumerate(a)]
        known += [(e, 100 + i, w) for i, w in enumerate(b)]
        want += [(e, 10 * i, 100 + j) for i, j in plain_aligned(a, b)]
    schema = "e int, pos int, word string"
    got = alignment.align_words(spark.createDataFrame(heard, schema), spark.createDataFrame(known, schema), "e").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    nulls = spark.createDataFrame([(1, 0, None), (1, 1, "a")], schema)
    assert [tuple(r) for r in alignment.align_words(nulls, nulls, "e").collect()] == [(1, 1, 1)]
    assert alignment.align_words(nulls.limit(0), nulls, "e").count() == 0


def plain_lag(x, y, most, width=44):
    ex, ey = ([sum(abs(v) for v in a[max(0, i - width + 1) : i + 1]) / width for i in range(len(a))] for a in (x, y))
    ex, ey = ([v - sum(e) / len(e) for v in e] for e in (ex, ey))
    sums = [sum(v * ey[i + d] for i, v in enumerate(ex) if i + d < len(ey)) for d in range(2 * most + 1)]
    return sums.index(max(sums)) - most


def test_clips_by_their_envelopes(spark):
    draw = np.random.default_rng(9)
    clips, tracks, lags, plain = [], [], {}, {}
    for e in range(6):
        most, lag = 30, int(draw.integers(-30, 31))
        loud = np.repeat(draw.random(80), 40)
        x = loud[500:2500] * draw.choice([-1, 1], 2000)
        y = loud[500 - most - lag : 2500 + most - lag] * draw.choice([-1, 1], 2000 + 2 * most) * 0.3
        clips += [(e, i, float(v)) for i, v in enumerate(x)]
        tracks += [(e, i, float(v)) for i, v in enumerate(y)]
        lags[e], plain[e] = lag, plain_lag(x.tolist(), y.tolist(), most)
    schema = "e int, pos int, x double"
    rows = alignment.envelope_lags(spark.createDataFrame([*clips, (7, 0, 0.0)], schema), spark.createDataFrame([*tracks, (8, 0, 1.0)], schema), "e", 30).collect()
    got = {r["e"]: r["lag"] for r in rows}
    assert {e: got[e] for e in lags} == plain and got[7] is None and got[8] is None
    assert all(abs(got[e] - lags[e]) <= 2 for e in lags)
    assert all(r["peak"] > 0.9 for r in rows if r["e"] in lags)


def test_correlation_by_blocks_equals_the_plain_sum():
    draw = np.random.default_rng(10)
    for n, m, lags in ((5, 9, 4), (5000, 5200, 200), (3000, 2000, 600), (1, 1, 0)):
        x, y = draw.normal(size=n), draw.normal(size=m)
        want = [sum(x[i] * y[i + d] for i in range(min(n, m - d))) for d in range(lags + 1)]
        assert alignment.correlations(x, y, lags) == pytest.approx(want, abs=1e-6)
