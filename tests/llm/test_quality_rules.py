"""The robust estimate of the quality rules: each part alone, convergence from several starts, small groups."""

import numpy as np
import pytest

from chronotext.llm import quality_rules

VOCABULARY = [f"word{i}" for i in range(500)]


def clean_lines(draw, lines=20, words=10):
    return [" ".join(draw.choice(VOCABULARY, words)) for _ in range(lines)]


def planted(draw):
    """One document for each part that stands out in this part alone."""
    words = draw.choice(VOCABULARY, 200)
    banner = [*clean_lines(draw), *draw.choice(VOCABULARY[:12], 60)]
    passage = list(draw.choice(VOCABULARY, 40))
    return {
        "symbols": " ".join(w + ("#" if i % 3 == 0 else "") for i, w in enumerate(words)),
        "dup_lines": "\n".join(banner),
        "repeats": " ".join([*words[:60], *passage, *words[60:120], *passage]),
        "long_words": " ".join(w + "x" * 12 for w in words),
    }


@pytest.mark.parametrize("part", list(quality_rules.PARTS))
def test_each_part_alone_rejects(spark, part):
    draw = np.random.default_rng(5)
    texts = ["\n".join(clean_lines(draw)) for _ in range(400)] + [planted(draw)[part]]
    frame = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(frame).collect()}
    assert not rows[400]["base_failed"] and not rows[400]["kept"]
    assert all(rows[i]["kept"] for i in range(400))


def plain_steps(x, centre, cov):
    """Concentration steps in numpy until the determinant's logarithm falls by less than 1e-9; returns it."""
    floor = np.diag(np.array(list(quality_rules.PARTS.values())) ** 2)
    last = np.inf
    while True:
        d = x - centre
        near = np.argsort(np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d))[: int(np.ceil(0.75 * len(x)))]
        centre, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) * quality_rules.consistency(0.75) + floor
        if (now := np.linalg.slogdet(cov)[1]) > last - 1e-9:
            return now
        last = now


def test_estimate_is_no_worse_than_plain_steps_to_convergence(spark):
    """A tight majority beside a wide fifth and a far twentieth, so that steps from the medians need many rounds."""
    draw = np.random.default_rng(8)
    x = np.abs(np.vstack([draw.normal(0.3, 0.1, (700, 4)), draw.normal(0.9, 0.6, (250, 4)), draw.normal(4, 0.05, (50, 4))]))
    frame = spark.createDataFrame([("en", "a", *map(float, r)) for r in x], "_lang string, _source string, " + ", ".join(f"{f} double" for f in quality_rules.FIELDS))
    row = quality_rules.fit(frame).filter("_source = 'a'").first()
    got = np.array([[row[f"v{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)]) + np.diag(np.array(list(quality_rules.PARTS.values())) ** 2)
    middle = np.median(x, axis=0)
    spread = np.diag((1.4826 * np.median(np.abs(x - middle), axis=0)) ** 2 + np.array(list(quality_rules.PARTS.values())) ** 2)
    assert np.linalg.slogdet(got)[1] < plain_steps(x, middle, spread) + 0.02


def test_every_group_is_shrunk_towards_its_language(spark):
    """Each group counts by its size, 199 rows almost as much as 201; a language of few rows is judged by its own too."""
    draw = np.random.default_rng(4)
    sizes = {("en", "a"): (600, 0.0), ("fr", "a"): (199, 1.0), ("fr", "b"): (201, 1.0), ("de", "a"): (60, 2.0), ("de", "b"): (1, 2.0)}
    rows = [(*g, *map(float, draw.normal(centre, 0.05, 4))) for g, (n, centre) in sizes.items() for _ in range(n)]
    frame = spark.createDataFrame(rows, "_lang string, _source string, " + ", ".join(f"{f} double" for f in quality_rules.FIELDS))
    model = quality_rules.fit(frame)
    plain = {(r["_lang"], r["_source"]): r for r in model.collect()}
    own, language, every = quality_rules.shrunken(model)
    got = {(r["_lang"], r["_source"]): r for r in own.collect()}
    assert set(got) == set(sizes)
    wide = {r["_lang"]: r for r in language.collect()}
    overall = every.first()
    for (lang, source), row in got.items():
        n, n_lang = sizes[lang, source][0], sum(k for (other, _), (k, _) in sizes.items() if other == lang)
        for value in ("c0", "v00", "v12"):
            by_language = (n_lang * plain[lang, "\x00"][value] + 50 * overall[value]) / (n_lang + 50)
            assert np.isclose(wide[lang][value], by_language)
            assert np.isclose(row[value], (n * plain[lang, source][value] + 50 * by_language) / (n + 50))
    assert abs(got["fr", "a"]["c0"] - got["fr", "b"]["c0"]) < 0.03


def test_verdict_is_the_mahalanobis_distance_of_numpy(spark):
    """Distances and verdicts of one group by plain numpy steps; both sides of the centre."""
    draw = np.random.default_rng(9)
    x = np.vstack([draw.normal(1, 0.3, (900, 4)), draw.normal(1, 0.3, (40, 4)) + 3, draw.normal(1, 0.3, (40, 4)) - 3])
    frame = spark.createDataFrame([(i, "en", "a", *map(float, r)) for i, r in enumerate(x)], "_key long, _lang string, _source string, " + ", ".join(f"{f} double" for f in quality_rules.FIELDS))
    rows = {r["_key"]: r for r in quality_rules.judged(frame, quality_rules.fit(frame.drop("_key")), 0.99999).collect()}
    centre, cov = np.median(x, axis=0), np.diag(np.full(4, 0.09))
    for _ in range(50):
        d = x - centre
        near = np.argsort(np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d))[: int(np.ceil(0.75 * len(x)))]
        centre, cov = x[near].mean(axis=0), np.cov(x[near].T, bias=True) * quality_rules.consistency(0.75) + np.diag(np.array(list(quality_rules.PARTS.values())) ** 2)
    d = x - centre
    want = np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)
    got = np.array([rows[i]["distance"] for i in range(len(x))])
    assert np.allclose(got, want, rtol=0.35)  # the estimate of all rows and the floors are mixed in by the shrinking
    assert [rows[i]["_outlier"] for i in range(900, 940)] == [True] * 40
    assert not any(rows[i]["_outlier"] for i in range(940, 980)) and sum(rows[i]["_outlier"] for i in range(900)) <= 2
    assert {r["group_rows"] for r in rows.values()} == {980}


def test_quantiles_and_consistency():
    assert abs(quality_rules.cutoff(0.95) - 9.4877) < 1e-3 and abs(quality_rules.cutoff(0.75) - 5.3853) < 1e-3
    normal = np.random.default_rng(1).normal(size=(200_000, 4))
    near = normal[np.argsort((normal**2).sum(axis=1))[:150_000]]
    assert abs(quality_rules.consistency(0.75) * near.var() - 1) < 0.02
