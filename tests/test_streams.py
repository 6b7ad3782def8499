"""Streams that go on where an earlier run ended."""

import math
import random

import pytest

from chronotext.operators import folds
from chronotext.streaming import runs


def test_frames_go_on_in_a_later_run(spark, tmp_path):
    draw = random.Random(6)
    rows = [(k, i, draw.random()) for k in range(5) for i in range(draw.choice([0, 1, 7, 30, 41]))] + [(9, 0, None), (9, 1, 1.0), (9, 2, 1.0)]
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "id int, seq int, x double"
    parts = [[r for r in rows if r[1] < 5], [r for r in rows if 5 <= r[1] < 22], [r for r in rows if r[1] >= 22]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        samples = spark.readStream.schema(schema).parquet(source)
        found = runs.run(spark, runs.frame_levels(samples, "id", 3), "levels", folder=table)
    got = {(r["id"], r["frame"]): r["db"] for r in found.collect()}
    want = {}
    for k in {r[0] for r in rows}:
        x = [r[2] or 0.0 for r in sorted(r for r in rows if r[0] == k)]
        want.update({(k, f): 10 * math.log10(sum(v * v for v in x[3 * f : 3 * f + 3]) / 3 + 1e-10) for f in range(len(x) // 3)})
    assert got == pytest.approx(want)


def test_windows_cut_on_the_way_are_those_of_the_whole(spark, tmp_path):
    draw = random.Random(7)
    whole = {k: [(round(0.5 * i, 3), draw.random()) for i in range(draw.randint(1, 260))] for k in range(6)}
    schema = "id int, job long, at double, e double, last boolean"
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    # Recording 0 was begun as job 0 before; the rest of that job comes late and counts for nothing.
    stale = [(0, 0, 0.5 * i, 0.0, False) for i in range(90)]
    for low, high in ((0, 40), (40, 41), (41, 200), (200, 300)):
        part = [(k, 1, a, e, i == len(rows) - 1) for k, rows in whole.items() for i, (a, e) in enumerate(rows) if low <= i < high]
        late = stale[: low + 20] if low in (0, 40) else stale[60:]
        spark.createDataFrame([*part, *late] if low else late, schema).coalesce(1).write.mode("append").parquet(source)
        if not low:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        frames = spark.readStream.schema(schema).parquet(source)
        found = runs.run(spark, runs.recognition_windows(frames, "id", frame=0.5), "windows", folder=table)
    rows = sorted(tuple(r) for r in found.filter("job = 1").collect())
    batch = spark.createDataFrame([(k, a, e) for k, r in whole.items() for a, e in r], "id int, at double, e double")
    cuts = {k: [] for k in whole}
    for r in folds.window_cuts(batch, "id", frame=0.5).orderBy("n").collect():
        cuts[r["id"]].append(r["cut"])
    want = []
    for k, r in whole.items():
        edges = [0.0, *cuts[k], r[-1][0] + 0.5]
        want += [(k, 1, n, a, b) for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    assert [x for r in rows for x in r] == pytest.approx([x for r in sorted(want) for x in r])
