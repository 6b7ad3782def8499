"""Similarity links against brute force over all pairs of texts."""

import random
from collections import defaultdict

import numpy as np

from chronotext.llm import resemblance, simhash
from tests.llm.test_operators import plain_fingerprint


def shingles(text: str | None, n: int = 5) -> frozenset[bytes]:
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def overlap(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


def estimate(x, y):
    """The similarity that two sketches' bits stand for."""
    planes = [np.unpackbits(np.array(v, dtype="<i8").view(np.uint8)).reshape(2, -1) for v in (x, y)]
    return 1 - 4 / 3 * np.mean((planes[0] != planes[1]).any(axis=0))


def test_sketch_estimates_the_overlap():
    draw = random.Random(3)
    for share in (0.5, 0.8, 0.95):
        both = [draw.getrandbits(64) for _ in range(int(5000 * share))]
        own = [[draw.getrandbits(64) for _ in range((5000 - len(both)) // 2)] for _ in range(2)]
        a, b = (resemblance.sketch(np.array(both + o, dtype="<u8"))[0] for o in own)
        assert abs(estimate(a, b) - share) < 0.11
    planes, bands = resemblance.sketch(np.zeros(0, dtype="<u8"))
    assert (len(planes), len(bands)) == (2 * resemblance.PLANES, resemblance.BANDS)
    assert resemblance.most_differing(0.8, 0) == round(256 * 0.15) and resemblance.most_differing(0.8, 3) < 38 < resemblance.most_differing(0.8, -3)


def test_near_copies_share_a_component_and_clean_texts_do_not(spark):
    """Edited copies of several texts, hundreds of one; the components are those of all pairs of 0.8 or more, or of four bits."""
    draw = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    texts: list[str | None] = []
    for n, copies in ((60, 3), (200, 4), (300, 150), (900, 5), (2500, 3)):
        base = draw.choices(words, k=n)
        texts.append(" ".join(base))
        for _ in range(copies):
            other = list(base)
            for _ in range(max(1, n // 100)):
                other[draw.randrange(n)] = draw.choice(words)
            texts.append(" ".join(other))
    texts += [" ".join(draw.choices(words, k=draw.randrange(5, 400))) for _ in range(60)] + [None, "", "one", "two words"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame, shingle=5, similarity=0.8).collect()}
    sets, prints = [shingles(t) for t in texts], [plain_fingerprint(t, 5) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if want[i] != want[j] and ((prints[i] ^ prints[j]).bit_count() <= 4 or sets[i] and sets[j] and overlap(sets[i], sets[j]) >= 0.8):
                a, b = sorted((want[i], want[j]))
                want = [a if w == b else w for w in want]
    assert [got[i] for i in range(len(texts))] == want
    members = defaultdict(list)
    for k, c in got.items():
        members[c].append(k)
    kept = [r["doc_id"] for r in simhash.keep_one(frame.unionByName(frame), shingle=5, similarity=0.8).collect()]
    assert sorted(kept) == sorted(members)
    assert simhash.keep_one(frame.limit(0), shingle=5, similarity=0.8).count() == 0
