"""Spots kept apart and sums over windows against plain loops."""

import random
from collections import defaultdict

from chronotext.operators import sequence


def plain_apart(spots, width, top, taken):
    out = [(a, None) for a in sorted(set(taken))]
    for a, v in sorted(spots.items(), key=lambda s: (-s[1], s[0])):
        if all(abs(a - b) >= width for b, _ in out):
            out.append((a, v))
    return out[:top]


def test_spots_apart_are_those_of_a_greedy_loop(spark):
    draw = random.Random(1)
    rows, taken, want = [], [], []
    for e in [*range(12), None]:
        spots = {draw.randint(-20, 60): draw.randint(1, 5) for _ in range(draw.randint(0, 40))}
        before = [draw.randint(0, 60) for _ in range(draw.choice([0, 0, 1, 2]))] if e is not None else []
        rows += [(e, a, v) for a, v in spots.items()]
        taken += [(e, a) for a in before]
        want += [(e, a, v) for a, v in plain_apart(spots, 7, 4, before)]
    frame = spark.createDataFrame([*rows, (1, None, 3), (1, 5, None)], "e int, at int, v int")
    got = sequence.apart(frame, ["e"], "at", "v", 7, 4, spark.createDataFrame(taken, "e int, at int"))
    assert sorted(map(tuple, got.select("e", "at", "v").collect()), key=repr) == sorted(want, key=repr)
    assert sequence.apart(frame.limit(0), ["e"], "at", "v", 7).count() == 0


def test_window_sums(spark):
    draw = random.Random(2)
    rows, want = [], {}
    for e in range(6):
        n = draw.randint(1, 40)
        values = {a: draw.randint(0, 2) for a in range(n) if draw.random() < 0.6}
        rows += [(e, a, v, n) for a, v in values.items()]
        sums = defaultdict(int)
        for t in range(0, n - 9, 5):
            sums[t] = sum(values.get(k, 0) for k in range(t, t + 10))
        want.update({(e, t): s for t, s in sums.items() if s})
    got = sequence.window_sums(spark.createDataFrame(rows, "e int, at int, v int, n int"), ["e"], "at", "v", 10, 5, "n").collect()
    assert {(r["e"], r["at"]): r["total"] for r in got} == want
