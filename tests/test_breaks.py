"""Breaks for sponsors: the cases that define them, and sold names against plain counting."""

import pytest

from chronotext.operators import breaks

SCHEMA = "e int, seq int, start double, end double, speaker int, text string, w double"


class Speech:
    """Sentences timed as a recogniser delivers them, with the half minute they came from."""

    def __init__(self):
        self.at, self.rows = 0.0, []

    def say(self, text, speaker=0, gap=0.4):
        start = self.at + gap
        self.at = start + len(text.split()) / 2.7
        self.rows.append((1, len(self.rows), start, self.at, speaker, text, start // 30 * 30))
        return self.rows[-1]


def found(spark, rows, minor=()):
    frame = spark.createDataFrame(rows, SCHEMA)
    passing = spark.createDataFrame([(1, m) for m in minor], "e int, speaker int")
    return [(r["start"], r["end"], r["reads"]) for r in breaks.ad_breaks(frame, "e", passing).orderBy("start").collect()]


def near(a, b):
    return abs(a - b) <= 1.5


def test_a_read_by_the_host_between_two_stretches_of_the_show(spark):
    s = Speech()
    s.say("Good morning, this is the harbour report.")
    s.say("A bill sponsored by Senator Holm passed the committee, and nobody had expected that.")
    before = s.say("More on what it means for the coast in a minute.")
    s.say("The Harbour Report is brought to you by Boxwise.", gap=3)
    s.say("Moving house is hard, and it takes days to find the right boxes for all that you own.")
    s.say("Boxwise brings them to your door, and takes them back when you are done.")
    s.say("See for yourself at boxwise.com/harbour.")
    after = s.say("Right, the vote. Ida, how did you see it?", gap=3)
    s.say("It was a clear result, and the speeches said more than the count.", 1)
    ((start, end, reads),) = found(spark, s.rows)
    assert near(start, before[3]) and near(end, after[2]) and reads == 1


def test_two_reads_and_a_passing_spot_are_one_break(spark):
    s = Speech()
    before = s.say("So that is where the talks stand tonight, and the morning will tell.")
    s.say("This episode is sponsored by Nappen. Nappen makes pillows for how you sleep.", gap=3)
    s.say("Go to nappen.com/harbour for 20% off.")
    s.say("Support for this show comes from Fjord Mobile. Plans start at 15 dollars a month.", gap=3)
    s.say("Switch at fjordmobile.com/harbour. Terms apply.")
    s.say("Great prices are waiting at a dealer near you this weekend.", 7)
    after = s.say("And we are back. Tom, what of the summit?", gap=3)
    s.say("It went better than it looked, since most was written before it was over.", 1)
    ((start, end, reads),) = found(spark, s.rows, [7])
    assert near(start, before[3]) and near(end, after[2]) and end - start > 20


def test_a_read_inside_a_paragraph_is_cut_there(spark):
    rows = [
        (1, 0, 0.0, 14.0, 0, "That is all of the argument, and it holds up better than its critics say.", 0.0),
        (1, 1, 14.2, 18.0, 0, "The Harbour Report is brought to you by Penga.", 0.0),
        (1, 2, 18.2, 26.0, 0, "Send money abroad at the true rate. Download the Penga app today.", 0.0),
        (1, 3, 26.2, 29.0, 0, "Visit penga.com/harbour.", 0.0),
        (1, 4, 29.4, 50.0, 0, "So, to go on where we were, the second point is about size and it is a serious one.", 0.0),
        (1, 5, 50.2, 70.0, 0, "Nobody has shown that this works in a country of three hundred million.", 0.0),
    ]
    ((start, end, _),) = found(spark, rows)
    assert near(start, 14) and near(end, 29.4)


def test_what_only_sounds_like_trade_is_left_alone(spark):
    s = Speech()
    s.say("We went to acme.com to read their paper on bridges, which is better than the summary.")
    s.say("The trial was free of drama, and that is news of its own.")
    s.say("A resolution sponsored by nine senators in Congress is not nothing.")
    assert found(spark, s.rows) == []


def test_a_stretch_far_too_long_is_no_break(spark):
    s = Speech()
    s.say("This episode is brought to you by nobody, as ever.")
    for _ in range(80):
        s.say("and the hearing went on and on and no end was in sight at all that day")
    s.say("Use code HEARING at checkout.")
    assert all(end - start <= 360 for start, end, _ in found(spark, s.rows))


def read_of(s, brand, speaker=0, gap=3.0):
    s.say(f"This episode is brought to you by {brand}. {brand} makes beds for how you sleep.", speaker, gap)
    s.say(f"Go to {brand.lower()}.com/harbour for 20% off. {brand}, sleep better.", speaker)


def test_show_talk_between_reads_stays_unless_it_names_what_they_sell(spark):
    def episode(between):
        s = Speech()
        s.say("So that is where the strike stands this morning.")
        read_of(s, "Nappen")
        talk = [s.say(between, gap=3 if i == 0 else 0.4) for i in range(10)]
        s.say("Support for this show comes from Fjord Mobile. Plans start at 15 dollars a month.", gap=3)
        s.say("Switch at fjordmobile.com/harbour. Terms apply.")
        s.say("And we are back with Tom.", gap=3)
        s.say("Thanks, it was a long week.", 1)
        return talk, found(spark, s.rows)

    talk, apart = episode("The count matters less than who gives in first, and nobody in that room wants to give in.")
    assert len(apart) == 2 and not any(a <= (t[2] + t[3]) / 2 < b for t in talk for a, b, _ in apart)
    talk, together = episode("The makers of Nappen have thought long about how people lie at night and what wakes them.")
    assert len(together) == 1


def test_a_clip_in_another_voice_before_a_read_is_not_taken_in(spark):
    s = Speech()
    s.say("Here is what the Speaker said on Sunday.")
    clip = [s.say("We will not talk to anybody until the doors are open again, full stop.", 5, 0.5), s.say("That is where this house stands, and will stand tomorrow.", 5)]
    read_of(s, "Nappen", gap=0.5)
    s.say("So what do we make of that clip?", gap=3)
    s.say("It is a bluff, mostly.", 1)
    ((start, end, _),) = found(spark, s.rows)
    assert all(not start <= (c[2] + c[3]) / 2 < end for c in clip)


def test_an_announcer_heard_nowhere_else_and_a_sign_off_join(spark):
    s = Speech()
    s.say("Today's presenting sponsor is Larmtek. Larmtek guards your home while you are away. Go to larmtek.com/harbour for 50% off.", 0)
    s.say("Larmtek, ahead of trouble.", 0, 2.0)
    for text in ("All the films you like are in one place this winter.", "There is drama, and there is song, and dragons.", "Sign up today at filmbox.com/all. Terms apply.", "A winter to remember."):
        s.say(text, 1, 0.2)
    host = s.say("Welcome to the harbour report. I am Dan Holm, and there is a lot to get through.", 3, 0.8)
    for i in range(60):
        s.say("And nobody wants to go first on this, as they said." if i % 2 else "So let us talk about what went on this week, because a lot did.", 3 + i % 2)
    ((start, end, reads),) = found(spark, s.rows)
    assert start == 0 and near(end, host[2]) and reads >= 2


@pytest.mark.parametrize("rows", [[], [(1, 0, 0.0, 3.0, None, None, 0.0), (1, 1, 3.0, 4.0, None, " ", 0.0)], [(1, 0, 0.0, 30.0, None, "Sponsored by Nappen. Use code SLEEP at checkout.", 0.0)] * 1])
def test_odd_rows(spark, rows):
    out = found(spark, rows)
    assert out == ([(0.0, 30.0, 1)] if rows and rows[0][5] else [])


def test_sold_names(spark):
    paras = [
        (1, 0.0, 20.0, "Our guest Nappen spoke."),
        (1, 300.0, 330.0, "Brought to you by Nappen. Nappen and Fjord. Fjord is sponsored by nobody. Bluesea helps."),
        (1, 331.0, 350.0, "Use code BLUE at checkout with Bluesea. Then Ida came."),
        (1, 400.0, 420.0, "Bluesea is near enough to be said again."),
        (1, 900.0, 930.0, None),
        (2, 0.0, 20.0, "Sponsored by Nappen. Nappen!"),
    ]
    frame = spark.createDataFrame(paras, "e int, start double, end double, text string")
    reads = spark.createDataFrame([(1, 0, 300.0, 350.0), (2, 0, 0.0, 20.0)], "e int, read int, start double, end double")
    got = {tuple(r) for r in breaks.sold_names(frame, reads, "e").collect()}
    assert got == {(1, 0, "Fjord", 2), (1, 0, "Bluesea", 2), (2, 0, "Nappen", 2)}
