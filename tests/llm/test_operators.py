"""The training-data operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronotext.llm import decontamination, language_id, packing, quality_classifier, quality_rules, sharding, simhash, tokens, url_filter, warc
from chronotext.llm.common import durable, rank_in_groups

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "\n\n", "a", "  a  b ", "don't we'll", "x<|endoftext|>y", "é É ß İ Σσς 中文 1234", "aaaa" * 50, "\x1c\x00 tab\t", "word " * 3000, "<|startoftext|> The"]


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def nasty(spark):
    """Null ids and texts, repeated rows, and other columns whose names operators use themselves."""
    rows = [(i if i % 7 else None, t, "en" if i % 3 else None, "s") for i, t in enumerate(ODD)] + [(1, "a b c d e f", "en", "s")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    clash = ["size", "shard", "slot", "start", "length", "ids", "score", "kept", "fingerprint", "component_id", "_text", "_fp", "n_words", "held_out", "quality", "_key", "row"]
    return frame.withColumns({c: F.lit("clash") for c in clash}), rows


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BYTE)
    frame, rows = nasty(spark)
    got = sorted(map(tuple, tokens.count_tokens(frame, BYTE, limit=40).collect()), key=repr)
    want = []
    for key, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((key, len((text or "").encode()), n, n > 40))
    assert got == sorted(want, key=repr)
    assert tokens.count_tokens(frame.limit(0), BYTE).count() == 0


def test_token_counter_on_random_text():
    library, counter = Tokenizer.from_file(BYTE), tokens.TokenCounter(BYTE, memory=50)
    draw = np.random.default_rng(3)
    parts = ["a", " ", "  ", "\n", " \n", "\t", "'s", "é", "12", "$$", "<|endoftext|>", "\xa0", "😀", "the", "zz"]
    texts = ["".join(draw.choice(parts, draw.integers(1, 25))) for _ in range(3000)]
    assert counter.count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def pack_check(rows, texts, library, length):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        want = [*library.encode(texts[key] or "", add_special_tokens=False).ids, 1]
        got = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in sorted(pieces, key=lambda p: p["start"])])
        assert got.tolist() == want
        assert {p["doc_tokens"] for p in pieces} == {len(want)}
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= length
    return len(by_sequence)


def test_packing_places_every_id_once(spark, documents):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack_documents(documents, WORD, length=256).collect()
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    sequences = pack_check(rows, texts, library, 256)
    assert sum(r["length"] for r in rows) > 0.97 * 256 * sequences
    assert packing.sequences(packing.pack_documents(documents, WORD, length=256)).count() == sequences


def test_packing_odd_rows(spark):
    frame, rows = nasty(spark)
    library = Tokenizer.from_file(WORD)
    out = packing.pack_documents(frame, WORD, length=64).collect()
    assert sum(r["length"] for r in out) == sum(len(library.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    assert len({(r["sequence_id"], r["offset"]) for r in out}) == len(out)
    assert packing.pack_documents(frame.limit(0), WORD).count() == 0


def test_patterns_hold_the_histogram():
    draw = np.random.default_rng(1)
    for _ in range(30):
        histogram = {int(k): int(v) for k, v in zip(draw.choice(np.arange(1, 65), 20, replace=False), draw.integers(1, 200, 20), strict=True)}
        patterns = packing.pack_patterns(histogram, 64)
        assert Counter(packing.piece_lengths(patterns)) == Counter(histogram)
        assert all(sum(p) <= 64 for p, _ in patterns)


def test_shards_are_even_and_slots_gapless(spark, documents):
    rows = sharding.assign_shards(documents, shards=7).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    largest = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]].encode()) + 16, zlib.crc32(texts[r["doc_id"]].encode())) for r in rows)


def test_shards_split_a_group_of_copies_and_take_odd_rows(spark, tmp_path):
    copies = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2000, "same text").otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    rows = sharding.assign_shards(copies, shards=10).groupBy("shard").agg(F.sum("size").alias("s")).collect()
    mean = sum(r["s"] for r in rows) / 10
    assert len(rows) == 10
    assert all(abs(r["s"] - mean) <= 0.02 * mean for r in rows)
    frame, plain = nasty(spark)
    odd = sharding.assign_shards(frame, shards=3).collect()
    assert len(odd) == len(plain)
    assert sharding.assign_shards(frame.limit(0)).count() == 0
    sharding.write_shards(copies, str(tmp_path / "shards"), shards=4)
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 3000


def test_rank_in_groups_is_dense(spark):
    frame = durable(spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 5).alias("g"), "id"), "ranks")
    for g in rank_in_groups(frame, ["g"], F.col("id"), ["id"], "r").groupBy("g").agg(F.sort_array(F.collect_list("r")).alias("r")).collect():
        assert g["r"] == list(range(len(g["r"])))


def test_url_filter_against_all_rules(spark):
    draw = np.random.default_rng(5)
    hosts = ["com", "example.com", "a.example.com", "b.a.example.com", "net", "x.net", "xample.com", "", "org.example.com"]
    paths = ["", "/", "/en", "/en/", "/en/7", "/en/7/x", "/de", "/\uffff\U0010ffff"]
    picked = {(str(draw.choice(hosts)), str(draw.choice(paths))): str(draw.choice(["allow", "block"])) for _ in range(24)}
    rules = [(h, p, a) for (h, p), a in picked.items()]
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/7?q#f", "x://y://example.com/en"] + [f"https://{h}{p}{e}" for h in hosts for p in paths for e in ("", "9", "?x", "#y")]
    urls += urls[:10]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit("clash")})
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(frame, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert len(got) == len(urls)
    for i, url in enumerate(urls):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        fits = [(len(h + p), h.count(".") + (h != ""), h + p, a) for h, p, a in rules if (h in ("", host) or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, None, "allow"))
        assert got[i] == (host, path, best[2], best[3]), url
    assert url_filter.filter_urls(frame.limit(0), spark.createDataFrame(rules, "host string, path string, action string")).count() == 0
    assert {r["verdict"] for r in url_filter.filter_urls(frame, spark.createDataFrame([], "host string, path string, action string")).collect()} == {"allow"}


def test_warc_round_trip(spark, tmp_path):
    big, other = "x" * 1000 + "é", "\r\n\r\nWARC/1.1\r\n" * 100
    rows = [(1, "http://a/\r\nX: y", big), (5, None, big), (3, "u", big), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (7, "u", other), (8, "u", other), (None, "u", other), (9, "u", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"payload_bytes": F.lit("clash"), "refers_to": F.lit("clash")})
    warc.write_warc(frame, str(tmp_path / "w"))
    records = warc.read_warc(spark, str(tmp_path / "w"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.resolved(records).collect()}
    n = len(big.encode())
    assert got == {
        1: ("revisit", 5, n), 3: ("revisit", 5, n), 5: ("response", None, n), 2: ("response", None, 5), 4: ("response", None, 5), 6: ("response", None, 0),
        7: ("revisit", 8, len(other)), 8: ("response", None, len(other)), None: ("revisit", 8, len(other)), 9: ("response", None, 0),
    }
    kept = {r["page_id"]: bytes(r["payload"]).decode() for r in records.filter("record_type = 'response'").collect()}
    assert kept == {5: big, 2: "small", 4: "small", 6: "", 8: other, 9: ""}
    warc.write_warc(frame.limit(0), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0


def plain_fingerprint(text, shingle):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, distance=4):
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= distance and group[i] != group[j]:
                a, b = group[i], group[j]
                group = [a if g == b else g for g in group]
    least = {}
    for g, (key, _) in zip(group, rows, strict=True):
        least[g] = key if least.get(g) is None else least[g] if key is None else min(least[g], key)
    return [least[g] for g in group]


@pytest.mark.parametrize("planned", [None, [(list(range(21)), 1), (list(range(21, 42)), 1), (list(range(42, 64)), 0)], [(list(range(32)), 2), (list(range(32, 64)), 1)]])
def test_simhash_components(spark, documents, monkeypatch, planned):
    if planned:
        monkeypatch.setattr(simhash, "plan", lambda *_: planned)
    frame, _ = nasty(spark)
    both = documents.select("doc_id", "text").unionByName(frame.select((F.col("doc_id") + 100000).alias("doc_id"), "text")).unionByName(frame.select("doc_id", "text"))
    rows = [(r["doc_id"], plain_fingerprint(r["text"], 4)) for r in both.collect()]
    want = Counter((k, f"{f:016x}", c) for (k, f), c in zip(rows, plain_components(rows), strict=True))
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(both).collect())
    assert got == want


def test_simhash_dense_group_and_filter(spark):
    """Very many fingerprints that lie close together: chains and stars in one component, and one row kept."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[:i] + ["changed"] + words[i + 1 :]) for i in range(0, 400, 2)] + [" ".join(words)] * 50 + [f"other {i} text of its own number {i * 7}" for i in range(50)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = [(i, plain_fingerprint(t, 4)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame).collect()}
    assert [got[i] for i in range(len(texts))] == plain_components(rows)
    kept = simhash.keep_one(frame.unionByName(frame), shingle=4)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_threshold_plan_is_general_pigeonhole():
    for n in (100, 10**5, 10**7, 10**9):
        both = np.full((64, 64), n / 4)
        np.fill_diagonal(both, n / 2)
        parts = simhash.plan(n, both, 4)
        assert sum(t + 1 for _, t in parts) == 5
        bits = [b for p, _ in parts for b in p]
        assert len(bits) == len(set(bits))


def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = list(zip(words, words[1:], words[2:], strict=False))
    counts, covered, seen, dup = Counter(triples), set(), set(), 0
    for i, t in enumerate(triples):
        if counts[t] > 1:
            covered |= {i, i + 1, i + 2}
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_rule_statistics_against_plain_python(spark, documents):
    texts = [*ODD, "a b c a b c a b c", "x\nx\n \n y\n y", *(r["text"] for r in documents.limit(60).collect())]
    assert [quality_rules.statistics(t) for t in texts] == [plain_statistics(t) for t in texts]


def test_rules_keep_clean_and_reject_junk(spark, documents, small):
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(documents).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    judged = [(labels[k], r["kept"]) for k, r in rows.items() if k in labels and not r["base_failed"]]
    assert sum(kept for q, kept in judged if q == 1) >= 0.99 * sum(q == 1 for q, _ in judged)
    frame, plain = nasty(spark)
    assert quality_rules.quality_rules(frame).count() == len(plain)
    assert quality_rules.quality_rules(frame.limit(0)).count() == 0
    kept = quality_rules.keep_good(documents)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in rows.items() if r["kept"]}


def test_rules_find_planted_outliers(spark):
    draw = np.random.default_rng(2)
    vocabulary = [f"word{i}" for i in range(500)]
    clean = [" ".join(draw.choice(vocabulary, 200)) for _ in range(400)]
    marked = [" ".join(w + "***" for w in draw.choice(vocabulary, 200)) for _ in range(40)]
    frame = spark.createDataFrame([(i, t, "en", "a" if i % 2 else "b") for i, t in enumerate(clean + marked)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(frame).collect()}
    assert all(kept[i] for i in range(400))
    assert not any(kept[i] for i in range(400, 440))


def test_decontamination_finds_copies_and_changed_values(spark):
    items = [(1, "Anna Berg walks 12 km from the old harbour to the red mill and then rests for 12 minutes before she goes on to Karl"), (2, "short one"), (3, None), (4, "a train leaves the northern station at 9 and reaches the southern village after 45 minutes of slow travel through hills")]
    pad = "this is some other text that says nothing of interest about it all and goes on for a while "
    docs = [
        (10, pad + items[0][1] + " " + pad),
        (11, pad + "Maria Lund walks 30 km from the old harbour to the red mill and then rests for 30 minutes before she goes on to Karl"),
        (12, pad + "Maria Lund walks 30 km from the old harbour to the red mill and then rests for 31 minutes before she goes on to Karl"),
        (13, pad * 5),
        (14, None),
        (15, ""),
        (16, pad + "a train leaves the northern station at 7 and reaches the southern village after 20 minutes of slow travel through hills " + pad),
        (17, pad + "a train leaves the northern station"),
        (10, pad + items[0][1] + " " + pad),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontamination.contaminated(frame, benchmark, agree=1.0).collect()}
    assert got == {(10, 1): False, (11, 1): True, (16, 4): True}
    kept = decontamination.keep_clean(frame, benchmark, agree=1.0)
    assert kept.columns == frame.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [12, 13, 14, 15, 17]
    assert decontamination.contaminated(frame.limit(0), benchmark).count() == 0
    assert decontamination.contaminated(frame, benchmark.limit(0)).count() == 0


def test_decontamination_against_window_scan(spark, documents, small):
    benchmark = spark.read.parquet(f"{small}/benchmark.parquet")
    windows = defaultdict(set)
    words = lambda t: re.findall(r"\w+", t.lower())
    for r in benchmark.collect():
        w = words(r["text"])
        for i in range(len(w) - 7):
            windows[tuple(w[i : i + 8])].add(r["item_id"])
    want = set()
    for r in documents.collect():
        w = words(r["text"])
        for i in range(len(w) - 7):
            want |= {(r["doc_id"], k) for k in windows.get(tuple(w[i : i + 8]), ())}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(documents, benchmark).collect()}
    assert got == want


def test_quality_classifier_held_out(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality_classifier.classify(documents, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_quality_classifier_odd_rows(spark):
    frame, rows = nasty(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(frame, labels).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality_classifier.classify(frame, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.classify(frame.limit(0), labels).count() == 0
    assert quality_classifier.keep_accepted(frame, labels).columns == frame.columns


def test_language_held_out(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = [r for r in language_id.identify(documents).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows]) >= 0.98


def test_language_odd_rows(spark):
    frame, rows = nasty(spark)
    out = language_id.identify(frame.drop("row"), least=5).collect()
    assert len(out) == len(rows)
    none = [r for r in language_id.identify(frame.limit(0)).collect()]
    assert none == []
    blank = spark.createDataFrame([(1, None, "en"), (2, "123 !!", "en"), (3, "some words", None)], "doc_id long, text string, lang string")
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in language_id.identify(blank).collect()} == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)}


def test_language_grams_match_plain_counts():
    letters = language_id.letter_table()
    codes = language_id.folded("Ab, cÉ 12 x", letters)
    assert "".join(map(chr, codes)) == " ab cé x "
    columns, counts = language_id.grams(codes)
    assert counts.sum() == sum(len(codes) - k for k in range(3))
    assert len(language_id.grams(language_id.folded("12 !", letters))[0]) == 0
