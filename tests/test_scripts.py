"""Turns of published transcripts, in each way of labelling."""

import pytest

from chronotext.sources import scripts

LONG = "and so it went on for a good while with boats and nets and the long wind that comes from the west in the autumn months here"


def turns(spark, html):
    frame = spark.createDataFrame([(1, html), (2, None), (3, "")], "id int, html string")
    rows = scripts.transcript_turns(frame, "id").orderBy("turn").collect()
    assert [r["turn"] for r in rows] == list(range(len(rows))) and {r["id"] for r in rows} <= {1}
    return [(r["speaker"], r["text"]) for r in rows]


SAID = [("IDA HOLM", f"Welcome {LONG}."), ("TOM BERG", "Thank you, it is good."), ("IDA HOLM", "How are you?"), ("TOM BERG", "Well enough."), ("IDA HOLM", "And the boat?"), ("TOM BERG", "It floats."), ("IDA HOLM", "Good to hear."), ("TOM BERG", "Yes it is.")]


@pytest.mark.parametrize("style", ["colon", "stamp", "alone", "capitals", "run on", "surname"])
def test_ways_of_labelling(spark, style):
    if style == "colon":
        html = "".join(f"<p>{w.title()}: {t}</p>" for w, t in SAID)
    elif style == "stamp":
        html = "".join(f"<div>{w.title()} (00:0{i}:02) {t}</div>" for i, (w, t) in enumerate(SAID))
    elif style == "alone":
        html = "".join(f"<b>{w.title()}</b><br>{t}<br/>" for w, t in SAID if len(t.split()) > 2)
    elif style == "capitals":
        html = "".join(f"<p>{w}, HOST: {t}</p>" for w, t in SAID)
    elif style == "run on":
        html = "<p>" + " ".join(f"{w}: {t}" for w, t in SAID) + "</p>"
    else:
        html = "".join(f"<p>{w if i < 2 else w.split()[1]}: {t}</p>" for i, (w, t) in enumerate(SAID))
    want = [(w, t) for w, t in SAID if style != "alone" or len(t.split()) > 2]
    if style == "alone":
        want = [] if len([1 for w, _ in want if w == "TOM BERG"]) < 4 else want
        got = turns(spark, html)
        assert [t for _, t in got][:1] == [f"Welcome {LONG}. Thank you, it is good."[: len(got[0][1])]] and got[0][0] == "IDA HOLM"
    else:
        assert turns(spark, html) == want


def test_furniture_and_other_colons_are_left_out(spark):
    html = "<script>var x = 'IDA HOLM: no'</script><p>About Ida Holm: a life by the sea.</p><p>Share: this</p>"
    html += "".join(f"<p>IDA HOLM: {t}</p><p>and more of that</p><p>too few</p><p>Note: this is said.</p>" for t in ("Hi there.", f"So {LONG} &amp; more.", "Well.", "Good bye."))
    got = turns(spark, html)
    assert got[0][0] == "IDA HOLM" and got[0][1].startswith("So and so it went on") and "& more. and more of that" in got[0][1]
    assert len(got) == 3 and got[1][1].startswith("Well. and more of that")
    assert turns(spark, "<p>Note: one.</p><p>Just text here and there.</p>") == []
