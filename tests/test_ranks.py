"""Order statistics by refined counts against sorted lists."""

import random

from chronotext.operators import ranks


def test_ranks_of_groups_small_and_large(spark):
    draw = random.Random(2)
    groups = {
        "a": [draw.gauss(0, 1) for _ in range(4000)],
        "b": [float(draw.randint(0, 3)) for _ in range(3000)],
        "c": [1e300, -1e300, *[draw.random() * 1e-9 for _ in range(900)]],
        "d": [7.0],
        "e": [5.0] * 2000,
        None: [float(x) for x in range(50)],
    }
    rows = [(k, v) for k, values in groups.items() for v in values] + [("a", None), ("f", None)]
    draw.shuffle(rows)
    wanted = {"hi": ranks.at_share(0.95), "lo": ranks.at_share(0.05), "mid": ranks.at_share(0.5, last=True)}
    frame = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: tuple(r)[1:] for r in ranks.order_statistics(frame, ["k"], "v", wanted, cells=16, few=20).collect()}

    def plain(values):
        n, s = len(values), sorted(values)
        return n, s[min(n - 1, int(0.95 * n))], s[min(n - 1, int(0.05 * n))], s[int((n - 1) * 0.5)]

    assert got == {k: plain(v) for k, v in groups.items()}
    assert ranks.order_statistics(frame.limit(0), ["k"], "v", wanted).count() == 0
