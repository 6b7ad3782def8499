"""Search: phrases over the ends of segments, nulls, empty tables, random episodes by a plain rule."""

import random

from chronotext.plans import search as plan


def hits(spark, rows, query):
    frame = spark.createDataFrame(rows, "episode_id long, seq int, text string").repartition(3)
    return sorted((r["episode_id"], r["runs"], r["from_seq"], r["to_seq"]) for r in plan.search(frame, query).collect())


def test_words_of_a_phrase_in_two_segments(spark):
    rows = [(1, 0, "a steel"), (1, 1, "box by the harbour"), (2, 0, "the box of steel"), (2, 1, "harbour"), (3, 0, "steel boxes"), (3, 1, "harbour"), (4, 0, None), (4, 1, "Steel box,"), (4, 2, "Harbours"), (None, 0, "steel box harbour")]
    assert hits(spark, rows, '"steel box" harbour') == [(1, 1, 0, 1), (4, 1, 1, 2)]


def test_nothing_asked_and_nothing_there(spark):
    assert hits(spark, [(1, 0, "a word")], " ") == []
    assert hits(spark, [], "word") == []


def test_random_episodes_have_all_words_within_three_segments(spark):
    draw = random.Random(3)
    words = "red mill slow train green hill".split()
    said = {e: [" ".join(draw.choices(words, k=draw.randrange(0, 4))) for _ in range(draw.randrange(1, 9))] for e in range(80)}
    rows = [(e, k, line) for e, lines in said.items() for k, line in enumerate(lines)]
    near = lambda lines: any({"red", "train"} <= set(" ".join(lines[k : k + 3]).split()) for k in range(len(lines)))
    assert {e for e, *_ in hits(spark, rows, "red train")} == {e for e, lines in said.items() if near(lines)}
