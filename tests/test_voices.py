"""Names from speech: literal cases for each wording, and votes and their assignment against plain loops."""

import random
from collections import defaultdict

from chronotext.operators import speech, voices

SEGS = "e int, seq int, speaker int, start double, end double, text string"


def guessed(spark, lines, people, host=None, votes=False):
    """lines: (speaker, text[, gap, seconds]); five seconds each where nothing else is said."""
    at, rows = 0.0, []
    for i, (speaker, text, *rest) in enumerate(lines):
        gap, seconds = (rest + [0.4, 5.0][len(rest) :]) if rest else (0.4, 5.0)
        rows.append((1, i, speaker, at + gap, at + gap + seconds, text))
        at += gap + seconds
    segs = spark.createDataFrame(rows, SEGS)
    named = spark.createDataFrame([(1, n, i) for i, n in enumerate(people)], "e int, name string, pos int")
    hosts = spark.createDataFrame([(1, host)] if host else [], "e int, host string")
    if votes:
        return sorted((r["voice"], r["name"], r["weight"]) for r in voices.name_votes(segs, named, hosts, "e").collect())
    return {r["voice"]: r["name"] for r in voices.guess_names(segs, named, hosts, "e").collect()}


def test_introductions(spark):
    lines = [(0, "Hello, I'm Ida Holm."), (1, "And my name is Tom Bergh, from the coast."), (2, "Hallo, ich bin Jon."), (0, "Good.")]
    assert guessed(spark, lines, ["Ida Holm", "Tom Berg", "Jon"], votes=True) == [(0, "Ida Holm", 3.0), (1, "Tom Berg", 3.0), (2, "Jon", 3.0)]
    assert guessed(spark, [(0, "I'm Ida Foundation."), (1, "Yes.")], ["Ida", "Tom Berg"], votes=True) == []


def test_two_introductions_heard_as_one_voice(spark):
    lines = [(0, "I'm Ida Holm."), (0, "I'm Tom Berg.", 0.2, 2.0), (1, "And here is the news.")]
    assert guessed(spark, lines, ["Ida Holm", "Tom Berg"]) == {0: "Ida Holm", 1: "Tom Berg"}


def test_guests_and_hosts(spark):
    long = [(0, "A long talk about boats and their owners.", 0.4, 70.0)]
    lines = [*long, (0, "I'm here with the author Anne Lund today."), (1, "Thank you.")]
    assert guessed(spark, lines, ["Anne Lund"], host="Ida Holm") == {0: "Ida Holm", 1: "Anne Lund"}
    lines = [(0, "Anne Lund, welcome to the show."), (1, "Thanks."), (0, "Bienvenue, Tom."), (None, "Hm."), (2, "Merci.")]
    assert guessed(spark, lines, ["Anne Lund", "Tom Berg"], votes=True) == [(1, "Anne Lund", 2.0), (2, "Tom Berg", 1.0), (2, "Tom Berg", 1.0)]
    assert guessed(spark, [*long, (0, "Welcome back to the podcast."), (1, "Hi.")], [], host="Ida Holm") == {0: "Ida Holm"}


def test_addresses_near_a_turns_end(spark):
    lines = [(0, "So Matias, what do we know?"), (1, "Little."), (0, "And is it right, Mattias?"), (1, "It is."), (0, "Well, Anna."), (2, "Yes.")]
    assert guessed(spark, lines, ["Matias Lund", "Anna Vik", "Anna Holm"], votes=True) == [(1, "Matias Lund", 1.0), (1, "Matias Lund", 1.0)]
    early = [(0, "Matias, what do we know?"), (0, "I ask since much is said.", 0.4, 30.0), (1, "Little.")]
    assert guessed(spark, early, ["Matias Lund"], votes=True) == []


def test_single_votes_and_the_host_by_questions(spark):
    lines = [(0, "Is it so?"), (1, "It is.", 0.4, 70.0), (0, "And Tom, is this?"), (1, "Yes."), (0, "Why?"), (0, "How?", 0.4, 60.0)]
    assert guessed(spark, lines, ["Tom Berg"], host="Ida Holm") == {1: "Tom Berg", 0: "Ida Holm"}
    short = [(0, "And Tom, is this?"), (1, "Yes.")]
    assert guessed(spark, short, ["Tom Berg"]) == {}


def test_organisations_are_no_persons_and_odd_rows(spark):
    assert guessed(spark, [(0, "I'm Gates Foundation."), (1, None), (1, "")], ["Gates Foundation", "The Times"]) == {}
    assert guessed(spark, [], ["Ida Holm"]) == {}
    assert guessed(spark, [(None, "I'm Ida Holm.")], ["Ida Holm", "Ida Holm"]) == {}


def plain_turns(rows):
    out = []
    for i, r in enumerate(rows):
        j = i
        while j + 1 < len(rows) and (rows[j + 1][2] is None or rows[j + 1][2] == rows[j][2]):
            j += 1
        nxt = rows[j + 1] if j + 1 < len(rows) else None
        out.append((r[0], r[1], rows[j][4], nxt and nxt[2], nxt and nxt[3]))
    return out


def test_turns_against_a_loop(spark):
    draw = random.Random(3)
    rows = [(e, i, draw.choice([0, 1, 1, None]), float(i), i + 0.5, "x") for e in range(20) for i in range(draw.randint(1, 12))]
    want = [t for e in range(20) for t in plain_turns([r for r in rows if r[0] == e])]
    got = voices.with_turns(spark.createDataFrame(rows, SEGS), "e").select("e", "seq", "turn_end", "next_speaker", "next_start").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_assignment_is_greedy(spark):
    draw = random.Random(4)
    votes = [(e, draw.randint(0, 5), f"n{draw.randint(0, 6)}", float(draw.randint(1, 4))) for e in range(30) for _ in range(draw.randint(0, 14))]
    got = {(r["e"], r["voice"]): r["name"] for r in speech.assign_names(spark.createDataFrame(votes, "e int, voice int, name string, weight double"), "e").collect()}
    total = defaultdict(float)
    for e, voice, name, weight in votes:
        total[e, voice, name] += weight
    want = {}
    for (e, voice, name), c in sorted(total.items(), key=lambda x: (-x[1], x[0])):
        if c >= 2 and (e, voice) not in want and name not in {n for (f, _), n in want.items() if f == e}:
            want[e, voice] = name
    assert got == want
