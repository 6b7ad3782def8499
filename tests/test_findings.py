"""Small cases of what a review found, each against the query's SQL or a plain loop."""

import itertools
import math
import random
import tracemalloc
from types import SimpleNamespace

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F

import __spark_entry__ as entry
from chronotext.llm import common, packing
from chronotext.operators import alignment, names, ranks, speech
from chronotext.streaming import runs


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL over tables of literal rows: table=(schema, rows)."""
    con = duckdb.connect()
    for table, (schema, rows) in tables.items():
        path = f"{folder}/{table}.parquet"
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    return sorted(map(repr, map(tuple, entry.queries()[name](spark, str(folder)).select(*columns).collect()))), sorted(map(repr, found.fetchall()))


TALK = "conv_id long, turn int, role string, text string"


def turns(*texts, conv=1):
    return [(conv, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]


def test_variants_are_no_group_of_a_key(spark):
    rng = random.Random(5)
    terms = [(lang, t, rng.randrange(4, 60)) for lang in ("a", "b") for t in sorted({"T" + "".join(rng.choice("aeno") for _ in range(rng.randrange(4, 11))) for _ in range(150)})]
    frame = spark.createDataFrame([*terms, (None, "Tanno", 5)], "k string, term string, n int")
    near = {frozenset((r["k"] + r["a"], r["k"] + r["b"])) for r in names.alike_pairs(frame, "k").collect()}
    want = set()
    for lang in ("a", "b"):
        groups = []
        for _, t, n in sorted((t for t in terms if t[0] == lang), key=lambda t: (-t[2], t[1])):
            mine = next((g for g in groups if any(frozenset((lang + t, lang + u)) in near for u, _ in g)), None)
            groups.append([(t, n)]) if mine is None else mine.append((t, n))
        want |= {(lang, t, n, g[0][0]) for g in groups if len(g) > 1 for t, n in g}
    found = names.name_groups(frame, "k")
    assert {tuple(r) for r in found.collect()} == want and len(want) > 100
    assert "Pandas" not in found._jdf.queryExecution().toString()


def test_votes_for_names_that_a_text_only_resembles(spark, tmp_path):
    said = turns("It the and.", "And on. Anhe, onatonan ea in es.", "And in ern of thst.", conv=751)
    got, want = both(spark, tmp_path, "name_votes", conversations=(TALK, said + turns("Ti. Ida, on the.", "Er. Jan, in that", "Of, Tim?", "So.", conv=4)))
    assert got == want


def test_titles_of_pages_with_references(spark, tmp_path):
    html = '<html><head><title>The token = &quot;a5&quot; &amp; more &amp;quot;</title></head><body>a &lt; b</body></html>'
    got, want = both(spark, tmp_path, "page_audio", pages=("page_id long, url string, html string", [(k, f"https://a.example.org/p/{k}", html) for k in range(7)]))
    assert got == want and len(got) == 6


def test_shares_of_talk_that_end_with_a_stretch(spark, tmp_path):
    said = [t for conv in range(40) for t in turns(*["a b c d", "ab cd e", "a b c d e f g h", "abc de fg hi jk"][conv % 3 :], *[" ".join("a" * n) for n in range(conv)], "a b c d", "ab cd e", "a b c de f gh", conv=conv)]
    got, want = both(spark, tmp_path, "retimed_parts", conversations=(TALK, said))
    assert got == want


def test_every_title_asks(spark, tmp_path):
    part = [(k, ("red bolt", "bolt red", "old red bolt", "new  gear", "gear", "rod", None, "red red rod x y")[k % 8] if k < 60 else f"only{k % 3} {k}", f"Brand#{k % 3}" if k % 11 else "Brand") for k in range(70)]
    for name, least in (("best_title_match", 50), ("clear_winner", 50)):
        got, want = both(spark, tmp_path, name, part=("p_partkey long, p_name string, p_brand string", part))
        assert got == want and len(got) >= least


def test_pairs_are_counted_before_they_move(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-0.5, 0.5) for _ in range(4)], rng.randrange(3), i % 5 == 0) for i in range(60)] + [(60, None, 1, True)]
    frame = spark.createDataFrame(rows, "id long, v array<double>, label int, asked boolean")
    for grid, block in ((50, 7), (50_000, 1000)):
        want = {}
        for i, v, m, _ in (r for r in rows[:60] if r[3]):
            for j, w, k, asks in rows[:60]:
                if i != j and (not asks or i < j):
                    cell = want.setdefault(math.floor((sum(x * y for x, y in zip(v, w, strict=True)) + 1) * grid), [0, 0])
                    cell[m != k] += 1
        got = ranks.pair_counts(frame.filter("asked"), frame, 3, grid, block)
        assert {r["cell"]: [r["pos"], r["neg"]] for r in got.collect()} == want


def test_kinds_of_titles_are_ranked_once(spark, tmp_path):
    names_ = ("red bolt", "bolt red", "old red bolt", "old old bolt", "new  gear", "gear", "rod", "red red rod tea", "go")
    part = [(k, names_[k * 7 % 9], f"Brand#{k % 2}", k % 13) for k in range(520)] + [(k, names_[k % 9], "Brand#0", 4) for k in (601, 601, 602)] + [(650, "gear", None, 4), (700, "pin tack", "Brand#2", 1), (703, "tack pin", "Brand#2", 1)]
    got, want = both(spark, tmp_path, "matched_episodes", part=("p_partkey long, p_name string, p_brand string, p_size int", part))
    assert got == want and len(got) > 500
    assert sum("True" in r for r in got) == 1
    found = entry.queries()["matched_episodes"](spark, str(tmp_path))
    assert "Generate explode(filter" not in found._jdf.queryExecution().toString()  # all ranking lies behind, in a table


def test_voices_of_conversations_without_a_key(spark, tmp_path):
    said = [(conv, i, ("user", "assistant", "system")[i % 3], "word " * n) for conv in (None, 3, 4) for i, n in enumerate((200, 90, 60))]
    got, want = both(spark, tmp_path, "minor_voices", conversations=(TALK, said))
    assert got == want and len(got) >= 4


def test_seconds_on_a_threshold_are_added_as_they_are_said(spark):
    # 100 seconds by three voices and a little less than 60 by one, if added in this order; others give less than 100, or 60.
    parts = [(1, 2, 0.0, 18.889), (1, 0, 18.889, 25.185), (1, 1, 25.185, 100.0)]
    parts += [(2, 0, a, b) for a, b in ((3.089, 12.491), (14.456, 38.107), (43.165, 50.232), (57.465, 77.345))] + [(2, 1, 200.0, 400.0)]
    want = set()
    for rows in itertools.permutations(parts[:3]):
        for more in (parts[3:], parts[:2:-1]):
            frame = spark.createDataFrame([*rows, *more], "e int, speaker int, start double, end double").coalesce(1)
            want.add(tuple(sorted(map(tuple, speech.minor_voices(frame, "e", None, 0.4, 60.0, 100.0).collect()))))
    assert [[r[:2] for r in found] for found in want] == [[(1, 0), (1, 2), (2, 0)]]


def windows_of(at, e, earliest=18.0, latest=29.5, frame=0.8):
    """Windows of one recording, one by one."""
    start, out = 0.0, []
    while at and at[-1] + frame - start > latest:
        near = [(x, a) for a, x in zip(at, e, strict=True) if start + earliest <= a < start + latest - frame]
        cut = min(near, key=lambda p: p[0])[1] + frame / 2 if near else start + latest
        out.append((len(out), start, cut))
        start = cut
        low = next((i for i, a in enumerate(at) if a >= cut), len(at))
        at, e = at[low:], e[low:]
    return out


def test_windows_without_frames_are_written_together(spark, tmp_path, monkeypatch):
    draw, said = random.Random(11), {}
    for user in (1, 2, 3):
        ids = sorted({draw.randrange(40_000) for _ in range(120)} | {40_001, 3_000_001, 300_000_001 + user * 2, 300_000_777})
        said[user] = [(i * 2, user, draw.random()) for i in ids]
    rows = [r for each in said.values() for r in each]
    for part in (rows[::3], rows[1::3], rows[2::3]):  # files of one batch, in no order
        spark.createDataFrame(part, "event_id long, user_id long, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    written, run = [], runs.run
    monkeypatch.setattr(runs, "run", lambda *a, **b: written.append(run(*a, **b)) or written[-1])
    found = entry.queries()["stream_windows"](spark, str(tmp_path))
    got = sorted(map(tuple, found.collect()))
    want = [(u, int(u % 3 == 0), *w) for u in (1, 2, 3) for w in windows_of([r[0] / 200 for r in said[u]], [r[2] for r in said[u]])]
    assert got == want and len(got) > 300_000  # to the last bit
    assert found.dtypes == [("user_id", "bigint"), ("job", "bigint"), ("n", "int"), ("start", "double"), ("end", "double")]
    assert written[0].count() < 200


def test_steps_taken_at_once_are_those_taken_one_by_one():
    draw = random.Random(12)
    for _ in range(300):
        start, step = draw.choice([0.0, draw.random() * 10 ** draw.randrange(7), draw.randrange(90) + 0.5]), draw.choice([29.5, 0.1, 3.0, draw.random()])
        until = start + step * (1 + draw.random() * 10 ** draw.randrange(4))
        one, left = start, start
        while left + step <= until:
            count = runs.repeated(left, step, until)
            for k in range(count):
                assert left + k * step == one
                one += step
            left += count * step
            assert left == one <= until


def test_words_of_a_slice_are_looked_up_once():
    class Counted(dict):
        seen = 0

        def get(self, *key):
            Counted.seen += 1
            return super().get(*key)

        def __getitem__(self, key):
            Counted.seen += 1
            return super().__getitem__(key)

    encoder = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    encoder.words = Counted()
    texts = ["the cat, The hat. " * 500, None, "", "  tab\there \u0085", "a\x1cb c\x1f d", "x" * 300, "ΣΑΣ É é 東京 \U0001f600!", "\r\n"]
    assert list(encoder.encode(texts)) == [encoder.ids(t or "") for t in texts]
    assert Counted.seen < 60


def test_a_span_is_compared_with_a_term_once(spark, monkeypatch):
    compared = []
    monkeypatch.setattr(names.Spelling, "hears", lambda self, *heard: compared.append(heard) or names.edits(heard[0], self.plain, self.most) <= self.most)
    monkeypatch.setattr(names.F, "pandas_udf", lambda kind: lambda run: lambda text: F.lit("\n".join(next(run(iter([pd.Series(texts)]))))))
    texts = ["We spoke of treading and theading, thread ing and tables. " * 50] * 3
    frame = spark.createDataFrame([("",)], "t string")
    out = names.corrected(frame, "t", ["threading"], {}, "c").first()["c"]
    assert out == "\n".join([("We spoke of threading and threading, threading and tables. " * 50)] * 3)
    assert 5 < len(compared) < 20


def test_a_long_alignment_is_kept_in_bits():
    rng = random.Random(8)
    known = np.array([rng.randrange(50) for _ in range(6000)])
    heard = np.where(np.arange(6000) % 7 == 0, 99, known)[np.arange(6000) % 9 > 0]
    tracemalloc.start()
    pairs = alignment.aligned(heard, known)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(heard[i] == known[j] for i, j in pairs) and all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) > 0.98 * (heard != 99).sum()
    assert peak < 1_500_000


def test_remembered_words_and_runs_are_bounded_and_common_words_stay():
    """pipeline, memory of its workers: runs were kept to twice the bound, and too many words went with the common ones."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, library = packing.WordEncoder(path, memory=400), packing.Tokenizer.from_file(path)
    draw, learned = random.Random(5), []
    learn = encoder.learn
    encoder.learn = lambda words: (learned.extend(words), learn(words))
    for _ in range(12):
        text = " ".join(["The harbour,", *("".join(draw.choices("abcdefgh", k=9)) for _ in range(150))])
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode([text])] == [library.encode(text, add_special_tokens=False).ids]
        assert len(encoder.words) <= 400 + 152 and len(encoder.runs) <= 400 + 154
    assert learned.count("The") == learned.count("harbour,") == 1


def test_a_step_gives_unused_arrow_memory_back_at_its_end(monkeypatch):
    """pipeline, memory of its workers: what Arrow had taken for one step stood beside that of the next."""
    ends = []
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: ends.append(len(ends))))
    step = common.tidy(lambda batches: (b + 1 for b in batches))
    assert list(step(iter([1, 2]))) == [2, 3] and ends == [0]
