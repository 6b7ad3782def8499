"""Best-fit packing: ids against the library, whole placing, and local search against all packings of small inputs."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chronotext.llm import best_fit, queries

BYTE = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", None, " ", "\n\n", "a", "  a  b ", "don't we'll", "x<|endoftext|>y", "é É ß İ Σσς 中文 1234", "aaaa" * 50, "\x1c\x00 tab\t", "word " * 3000, "<|endoftext|>"]


def test_ids_equal_the_library():
    library, encoder = Tokenizer.from_file(BYTE), best_fit.TokenEncoder(BYTE, memory=50)
    draw = np.random.default_rng(4)
    parts = ["a", " ", "  ", "\n", " \n", "\t", "'s", "é", "12", "$$", "<|endoftext|>", "\xa0", "😀", "the", "zz", "aa", "ing", "　", "ﬁ", "Ⅷ", "²"]
    texts = ["".join(draw.choice(parts, draw.integers(1, 25))) for _ in range(3000)] + ODD
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def fewest(sizes, length):
    """The least number of packs, by trying all."""
    best = len(sizes)

    def put(i, packs):
        nonlocal best
        if len(packs) >= best:
            return
        if i == len(sizes):
            best = len(packs)
            return
        for k in range(len(packs)):
            if packs[k] + sizes[i] <= length:
                put(i + 1, [*packs[:k], packs[k] + sizes[i], *packs[k + 1 :]])
        put(i + 1, [*packs, sizes[i]])

    put(0, [])
    return best


def content(packs):
    out = Counter()
    for pattern, n in packs.items():
        for size in pattern:
            out[size] += n
    return out


def squared(packs):
    return sum(sum(p) ** 2 * n for p, n in packs.items())


def test_search_keeps_all_pieces_and_frees_packs():
    draw = random.Random(7)
    better = excess = 0
    for _ in range(300):
        sizes = sorted((draw.randint(*draw.choice([(1, 20), (5, 12), (6, 9)])) for _ in range(draw.randint(1, 9))), reverse=True)
        first = best_fit.best_fit(Counter(sizes), 20)
        packs = best_fit.local_search(first, 20)
        assert content(first) == content(packs) == Counter(sizes)
        assert all(sum(p) <= 20 and n > 0 for p, n in packs.items())
        assert squared(packs) >= squared(first)
        n = sum(packs.values())
        better += sum(first.values()) - n
        excess += n - fewest(sizes, 20)
    assert excess <= 3
    many = Counter(draw.randint(257, 400) for _ in range(1500))
    first = best_fit.best_fit(many, 1024)
    packs = best_fit.local_search(first, 1024)
    assert content(packs) == many
    assert sum(packs.values()) < 0.96 * sum(first.values())


def test_exchanges():
    assert best_fit.best_exchange((5,), (3, 4), 4) == (4, (4,), ())
    assert best_fit.best_exchange((6, 3), (5,), 2) == (2, (5,), (3,))
    assert best_fit.best_exchange((7,), (4, 4), 1) == (1, (4, 4), (7,))
    assert best_fit.best_exchange((4, 4), (9,), 1) == (1, (9,), (4, 4))
    assert best_fit.best_exchange((7,), (7,), 1)[0] == 0
    assert best_fit.patterns({}, 10) == []


def check(rows, texts, length):
    library = Tokenizer.from_file(BYTE)
    placed, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for parts in placed.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    assert set(by_doc) == set(texts)
    for key, pieces in by_doc.items():
        want = [*library.encode(texts[key] or "", add_special_tokens=False).ids, 2]
        pieces.sort(key=lambda p: p["piece"])
        assert [p["piece"] for p in pieces] == list(range(-(-len(want) // length)))
        assert all(p["length"] == length for p in pieces[1:])
        assert np.concatenate([np.frombuffer(p["ids"], "<u4") for p in pieces]).tolist() == want
        assert [p["start"] for p in pieces] == np.r_[0, np.cumsum([p["length"] for p in pieces])][:-1].tolist()
    return len(placed)


def test_documents_are_packed_whole(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = best_fit.pack_whole(docs, BYTE, length=300).collect()
    sequences = check(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, 300)
    assert sequences <= 1.02 * sum(r["length"] for r in rows) / 300 + 1


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    clash = frame.withColumns({c: F.lit("clash") for c in ["piece", "start", "length", "ids", "sequence_id", "offset", "_rank"]})
    check(best_fit.pack_whole(clash, BYTE, length=64).collect(), dict(rows), 64)
    again = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "c"), (1, "c"), (1, "c")], "doc_id long, text string")
    out = best_fit.pack_whole(again, BYTE, length=64).collect()
    assert len(out) == 5 and len({(r["sequence_id"], r["offset"]) for r in out}) == 5
    assert best_fit.pack_whole(frame.limit(0), BYTE).count() == 0


def test_query_returns_digests_of_ids(spark, small):
    out = queries.op11_best_fit_packing(spark, small)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    pieces = {(r["doc_id"], r["piece"]): r["c"] for r in best_fit.whole_pieces(spark.read.parquet(f"{small}/documents.parquet"), BYTE).withColumn("c", F.crc32("ids")).collect()}
    rows = out.collect()
    assert {(r["doc_id"], r["piece"]): r["ids_crc32"] for r in rows} == pieces and len(rows) == len(pieces)
