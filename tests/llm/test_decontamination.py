"""Template decontamination against a plain matcher over all documents, items and diagonals."""

import random
from collections import defaultdict

import regex
from pyspark.sql import functions as F

from chronotext.llm import decontamination as d

WINDOW, LITERALS, LEAST, SHARE, AGREE, DRIFT, SHORTEST = 8, 4, 13, 0.8, 0.75, 3, 3


def plain_tokens(text):
    """(type, value) of each token; the type of a plain word is the word."""
    out, end, before = [], None, None
    for m in regex.finditer(r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+", text or ""):
        word, gap = m[0], text[end : m.start()] if end is not None else None
        after = text[m.end() : m.end() + 1]
        if regex.match(r"\p{N}", word):
            kind = "#"
        elif before == "#" and gap is not None and regex.fullmatch(r"\s?", gap) and regex.fullmatch(f"(?i:{d.UNITS})", word) and not regex.match(r"\p{N}", after):
            kind = "unit"
        elif regex.fullmatch(r"\p{Lu}[\p{Ll}\p{M}]+", word) and not regex.fullmatch(d.OPENERS, word):
            kind = "name"
        else:
            kind = word.lower()
        out.append((kind, word.lower()))
        before, end = kind, m.end()
    return out


def fits(line):
    """Whether enough of the values of a stretch have one value of the document, which no other name has."""
    meets, whose = defaultdict(set), defaultdict(set)
    for (kind, value), there in line:
        if kind in ("#", "unit", "name"):
            meets[kind, value].add(there)
            whose[kind, there].add(value)
    alone = lambda key, there: len(there) == 1 and (key[0] != "name" or len(whose["name", min(there)]) == 1)
    return sum(alone(key, there) for key, there in meets.items()) >= AGREE * len(meets)


def plain_pairs(docs, items):
    """(doc, item) -> tokens of the longest stretch that some band of diagonals covers and that is consistent."""
    found = {}
    told = {k: plain_tokens(t) for k, t in docs.items()}
    slot = lambda t: t in ("#", "unit", "name")
    for item, text in items.items():
        want = plain_tokens(text)
        if len(want) < SHORTEST:
            continue
        n = min(WINDOW, len(want))
        for doc, have in told.items():
            at, places, words = defaultdict(set), defaultdict(list), defaultdict(list)
            for j in range(len(have) - n + 1):
                places[tuple(t for t, _ in have[j : j + n])].append(j)
                words[tuple(w for _, w in have[j : j + n])].append(j)
            for i in range(len(want) - n + 1):
                a = want[i : i + n]
                exact = sum(not slot(t) for t, _ in a) < (LITERALS if n == WINDOW else max(3, (n + 1) // 2))
                for j in [] if exact else places[tuple(t for t, _ in a)]:
                    at[j - i].add(i)
                for j in words[tuple(w for _, w in a)]:
                    at[j - i].add(i)
            for shift in at:
                spots = {}
                for s in range(shift, shift + DRIFT + 1):
                    for i in at.get(s, ()):
                        for p in range(i, i + n):
                            spots.setdefault(p, s)
                if len(spots) < LEAST and len(spots) < SHARE * len(want) - 1e-9:
                    continue
                line = [(want[p], have[p + s][1]) for p, s in sorted(spots.items())]
                for begin in range(len(line)):
                    for end in range(begin + 1, len(line) + 1):
                        long = end - begin == len(want) or len(want) >= WINDOW and (end - begin >= LEAST or end - begin >= SHARE * len(want) - 1e-9)
                        if long and end - begin > found.get((doc, item), 0) and fits(line[begin:end]):
                            found[doc, item] = end - begin
    return found


WORDS = "the old harbour keeps its red mill while slow trains pass through green hills and people rest near water with bread cheese".split()
NAMES = "Anna Karl Maria Tom Lund Berg Oslo Paris Emil Nora".split()


def phrase(draw, n):
    out = []
    while len(out) < n:
        kind = draw.random()
        out += [str(draw.randrange(2, 99)), "km"] if kind < 0.08 else [str(draw.randrange(2, 99))] if kind < 0.18 else [draw.choice(NAMES)] if kind < 0.3 else [draw.choice(WORDS)]
    return out[:n]


def rewritten(draw, words):
    """The same phrase with other values, the same for the same."""
    new = {}
    return [new.setdefault(w, str(draw.randrange(100, 999))) if w.isdigit() else new.setdefault(w, draw.choice(NAMES)) if w in NAMES else w for w in words]


def spoilt(draw, words):
    return [str(draw.randrange(100, 999)) if w.isdigit() else draw.choice(NAMES) if w in NAMES else w for w in words]


def check(spark, docs, items, **settings):
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(list(items.items()), "item_id long, text string")
    rows = d.contaminated(frame, benchmark, **settings).collect()
    classes = {r["item_id"]: r["class_item"] for r in d.members(benchmark).collect()}
    got = {(r["doc_id"], classes[r["item_id"]]): r["matched_tokens"] for r in rows}
    want = {}
    for (doc, item), n in plain_pairs(docs, items).items():
        want[doc, classes[item]] = max(n, want.get((doc, classes[item]), 0))
    assert got == want
    return rows


def test_random_documents_and_items_equal_the_plain_matcher(spark):
    draw = random.Random(6)
    made = {i: phrase(draw, n) for i, n in enumerate([*range(3, 41), 3, 4, 8, 9, 20])}
    items = {i: " ".join(w) for i, w in made.items()}
    items |= {100: "", 101: None, 102: "two words", 103: "12 5 8 9 77 14 3 26 91", 104: items[20]}
    docs = {}
    for _ in range(150):
        parts = []
        for _ in range(draw.randrange(1, 4)):
            parts += phrase(draw, draw.randrange(0, 12))
            words = made[draw.randrange(len(made))]
            kind = draw.random()
            if kind < 0.3:
                words = rewritten(draw, words)
            elif kind < 0.45:
                words = spoilt(draw, words)
            elif kind < 0.6:
                cut = draw.randrange(len(words))
                words = words[:cut] + phrase(draw, 1) + words[cut:]
            elif kind < 0.7:
                words = words[draw.randrange(len(words)) :]
            parts += words
        docs[len(docs)] = " ".join(parts)
    docs |= {1000: None, 1001: "", 1002: "x 12, 5 8; 9 77 14 3 26 91"}
    assert len(check(spark, docs, items)) > 100


def test_every_offset_finds_short_items(spark):
    """Items of 8 to 10 tokens, and shorter ones, wherever they stand."""
    words = "three green boats sail past seven grey stones tonight quietly".split()
    items = {n: " ".join(words[:n]) for n in range(3, 11)}
    docs = {offset * 100 + n: " ".join([*["pad"] * offset, *words[:n], "end"]) for offset in range(9) for n in range(3, 11)}
    rows = check(spark, docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in rows} >= {(offset * 100 + n, n) for offset in range(9) for n in range(3, 11)}


def test_two_copies_in_either_order_and_names_that_begin_sentences(spark):
    item = "Tom has 5 apples. Anna has 3 apples. Tom gives 2 apples to Anna. Then Karl asks how many apples Anna and Tom have left"
    same = item.replace("Tom", "Emil").replace("Anna", "Nora").replace("5", "9").replace("3", "8")
    wrong = "Emil has 5 apples. Nora has 3 apples. Lund gives 2 apples to Berg. Then Oslo asks how many apples Paris and Maria have left"
    mixed = item.replace("Tom", "Lund").replace("Anna", "Lund").replace("Karl", "Lund")
    docs = {1: f"{wrong}. {item}.", 2: f"{item}. {wrong}.", 3: wrong, 4: same, 5: "while " + item, 6: f"{wrong}. and so: {same}", 7: mixed}
    rows = check(spark, docs, {7: item})
    # The second half of the third document is consistent by itself, the seventh's nowhere.
    assert {r["doc_id"]: r["reparameterised"] for r in rows} == {1: False, 2: False, 3: True, 4: True, 5: False, 6: True}


def test_a_copy_of_another_member_of_a_class_is_no_rewrite(spark):
    make = lambda a, b: f"a train leaves the northern station at {a} and reaches the southern village after {b} minutes of slow travel"
    benchmark = spark.createDataFrame([(1, make(4, 50)), (2, make(9, 45)), (3, make(5, 5))], "item_id long, text string")
    frame = spark.createDataFrame([(1, "pad " + make(9, 45) + " end"), (2, make(7, 20)), (3, make(6, 6))], "doc_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["reparameterised"], r["n_items"]) for r in d.contaminated(frame, benchmark, agree=1.0).collect() if r["item_id"] != 3 or r["doc_id"] == 3}
    assert got[1] == (2, False, 2) and got[2] == (1, True, 2) and got[3] == (3, True, 1)
    assert {r["item_id"]: r["class_item"] for r in d.members(benchmark).collect()} == {1: 1, 2: 1, 3: 3}


def test_very_long_texts_and_runs_of_figures(spark):
    words = "three green boats sail past seven grey stones tonight quietly under clear skies beyond northern capes".split()
    long = " ".join(["filler text without end"] * 60_000 + words + ["tail"] * 1000)
    docs = [(1, long), (2, "1," * 200_000), (3, "7" * 300_000), (4, "Ab" * 100_000), (5, "x" * 1_000_000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("_key", "_body", "_dt", "matched_tokens", "_class")})
    benchmark = spark.createDataFrame([(1, " ".join(words)), (2, "1,2,3 " * 5)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["matched_tokens"]) for r in d.contaminated(frame, benchmark).collect()] == [(1, 1, len(words))]
    assert sorted(r["doc_id"] for r in d.keep_clean(frame, benchmark).select("doc_id").collect()) == [2, 3, 4, 5]


def found(spark, docs, items):
    return {(r["doc_id"], r["item_id"]): (r["matched_tokens"], r["reparameterised"]) for r in check(spark, docs, items)}


def test_more_text_of_an_item_never_loses_the_passage(spark):
    head = "the old mill near Oslo has 5 wheels and 7 doors while slow trains pass through green"
    item = head + " hills where Anna keeps 3 goats Karl keeps 4 hens Tom keeps 6 cows and Emil sells 8 geese to Nora"
    same = " where Lund keeps 31 goats Berg keeps 44 hens Lund keeps 62 cows and Berg sells 81 geese to Lund"
    worse = " where Karl keeps 31 goats Karl keeps 44 hens Karl keeps 62 cows and Karl sells 81 geese to Karl Oslo 5"
    docs = {1: head, 2: head + " hills" + same, 3: head + " hills" + worse, 4: head + " hills and" + worse, 5: head + " plus other words follow"}
    got = found(spark, docs, {1: item})
    assert set(got) == {(k, 1) for k in docs} and all(n >= 17 for n, _ in got.values())


def test_case_of_letters_does_not_hide_a_copy(spark):
    items = {1: "Maria and Tom walk along the river near Oslo while slow trains pass", 2: "Calculate the total cost of three apples and seven red pears for Anna"}
    docs = {1: items[1].lower(), 2: items[1].upper(), 3: "please " + items[2][0].lower() + items[2][1:], 4: items[2].title()}
    assert found(spark, docs, items) == {(1, 1): (13, False), (2, 1): (13, False), (3, 2): (13, False), (4, 2): (13, False)}


def test_short_questions_with_other_values(spark):
    items = {1: "What is 12 plus 7?", 2: "Oslo 5 km", 3: "How far is Oslo from Berg?"}
    docs = {1: "so, what is 31 plus 5", 2: "What is 12 plus 7?", 3: "Paris 9 km", 4: "oslo 5 km", 5: "how far is Paris from Lund", 6: "how far is Paris from Paris", 7: "what is 3 minus 5"}
    assert {k: v[1] for k, v in found(spark, docs, items).items()} == {(1, 1): True, (2, 1): False, (4, 2): False, (5, 3): True}


def test_names_that_become_one_are_no_rewrite(spark):
    item = "Maria meets Tom near Oslo and then Maria and Tom walk along the river"
    docs = {1: item.replace("Maria", "Lena").replace("Tom", "Lena").replace("Oslo", "Lena"), 2: item.replace("Maria", "Lena").replace("Tom", "Ben").replace("Oslo", "Bonn")}
    assert set(found(spark, docs, {1: item})) == {(2, 1)}


def test_planted_rewrites_are_found(spark):
    """Items with each value replaced, numbers, names and units; at least nine in ten are found and no other document is."""
    draw = random.Random(11)
    made = {i: phrase(draw, draw.randrange(16, 60)) for i in range(60)}
    docs = {i: " ".join(phrase(draw, 20) + rewritten(draw, w) + phrase(draw, 20)) for i, w in made.items()}
    docs |= {100 + i: " ".join(phrase(draw, 80)) for i in range(60)}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in made.items()], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.contaminated(frame, benchmark).collect()}
    assert sum((i, i) in got for i in made) >= 54 and got <= {(i, i) for i in made}
