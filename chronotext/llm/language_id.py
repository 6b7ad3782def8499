"""Language identification: sparse multinomial logistic regression on TF-IDF weights of character n-grams.

N-grams of one to three characters are hashed to a fixed number of columns. Weights are learned by follow-the-
regularised-leader with an elastic-net penalty, so most of them are exactly zero; a temperature set on rows that were not
trained on calibrates the probabilities. Features are made on the executors; a bounded sample of them reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import arrow_map, durable, prepare, share_of, sized, spread, tasks_of

COLUMNS_BITS = 15
ORDERS = 3
EPOCHS, ALPHA, BETA, LASSO, RIDGE = 4, 0.5, 1.0, 0.02, 0.01
#: Odd multipliers of the rolling hash, one for each order.
MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Which of all code points are letters, as Python says; made once for each worker process."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def folded(text: str, letters: np.ndarray) -> np.ndarray:
    """Lower-cased code points in which every run of other characters is one space, with a space at both ends."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(letters[codes], codes, np.uint32(32))
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    space = codes == 32
    return codes[~(space & np.r_[False, space[:-1]])]


def grams(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns and counts of the hashed n-grams of folded text (none of a text without letters)."""
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    total = np.zeros(1 << COLUMNS_BITS, dtype=np.int64)
    rolled = np.zeros(len(codes), dtype=np.uint32)
    for order in range(ORDERS):
        rolled = (rolled[: len(codes) - order] * np.uint32(0x01000193)) ^ codes[order:] if order else codes.copy()
        column = ((rolled + np.uint32(order)) * MIX[order]) >> np.uint32(32 - COLUMNS_BITS)
        total += np.bincount(column, minlength=1 << COLUMNS_BITS)
    used = np.flatnonzero(total)
    return used, total[used].astype(float)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def features(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[columns]
        return x / max(float(np.sqrt((x * x).sum())), 1e-9)

    def logits(self, columns: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.features(columns, counts) @ self.weights[columns] + self.bias

    def predict(self, text: str | None, letters: np.ndarray) -> tuple[str, float]:
        columns, counts = grams(folded(text or "", letters))
        if not len(columns) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(columns, counts) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Weights from (language, columns, counts) rows; every fifth row sets the temperature and is not trained on."""
    width = 1 << COLUMNS_BITS
    languages = sorted({r[0] for r in rows})
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    used = [r for i, r in enumerate(rows) if i % 5 != 4] if len(rows) >= 10 else rows
    seen = np.zeros(width)
    for _, columns, _ in used:
        seen[columns] += 1
    idf = np.log((1 + len(used)) / (1 + seen)) + 1
    k = len(languages)
    model = Model(languages, idf, np.zeros((width, k)), np.zeros(k), 1.0)
    if not rows:
        return model
    z, n = np.zeros((width + 1, k)), np.zeros((width + 1, k))  # the last row is the bias

    def weights(at: np.ndarray | slice) -> np.ndarray:
        some = z[at]
        shrunk = np.sign(some) * np.maximum(np.abs(some) - LASSO, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + RIDGE)

    draw = np.random.default_rng(11)
    for _ in range(EPOCHS):
        for i in draw.permutation(len(used)):
            language, columns, counts = used[i]
            at = np.append(columns, width)
            x = np.append(model.features(columns, counts), 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[languages.index(language)] -= 1
            g = np.outer(x, error)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    final = weights(slice(None))
    model.weights, model.bias = final[:width], final[width]
    if held and k > 1:
        logits = np.stack([model.logits(c, n) for _, c, n in held])
        truth = np.array([languages.index(r[0]) for r in held])
        grid = 2.0 ** np.linspace(-4, 3, 57)
        loss = [-float(np.mean(np.log(np.maximum(softmax(logits / t)[np.arange(len(truth)), truth], 1e-12)))) for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def held_out(key: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def learn(docs: DataFrame, bound: int = 3000, least: int = 300) -> Model:
    """Fit on about ``bound`` whole documents (doc_id, text, lang): those of small hash, from each language an equal share.

    IDF is part of the classifier and comes from the same sample. Languages share the bound, but each may have
    ``least``. Rows equal in id and language are chosen together, so where they are more than twice the bound, they are
    thinned by a hash of id and text. Rows without text or language are not used; with no rows the model knows no
    language.
    """
    spark = docs.sparkSession
    rows = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = durable(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")), "languages")
    each = max(least, bound // max(1, sizes.count()))
    chance = sizes.select("lang", (F.lit(float(each)) / F.col("_n")).alias("_chance"))
    draw = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.select("doc_id", "text", "lang", draw.alias("_draw")).join(sized(chance, 100_000), "lang").filter("_draw < _chance")
    sample = durable(sample.select("text", "lang", F.xxhash64("doc_id", "text").alias("_order")).repartition(min(64, tasks_of(spark)), "_order"), "language-rows")
    most = 2 * max(bound, each * sizes.count())
    if (drawn := sample.count()) > most:
        sample = sample.filter(share_of(F.struct("_order", F.monotonically_increasing_id()), most, drawn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = letter_table()
        for batch in batches:
            found = [grams(folded(t, letters)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array([c.astype(np.uint16).tobytes() for c, _ in found], pa.binary()), pa.array([n.astype(np.uint32).tobytes() for _, n in found], pa.binary())],
                names=["lang", "o", "c", "n"],
            )

    made = arrow_map(sample, run, "lang string, o long, c binary, n binary").collect()
    made.sort(key=lambda r: (r["o"], r["lang"]))
    return fit([(r["lang"], np.frombuffer(r["c"], dtype=np.uint16).astype(np.int64), np.frombuffer(r["n"], dtype=np.uint32).astype(float)) for r in made if len(r["c"])])


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", **settings: int) -> DataFrame:
    """Per row of ``docs``: key, held_out, lang_pred, score. Held-out rows are never learned from.

    Only the text decides. Null texts and texts without a letter are ``und`` with score 0; null keys are not held out;
    repeated rows are each judged; an empty table gives no rows, and with nothing to learn from all are ``und``.
    """
    model = learn(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(~held_out()), **settings)
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        letters, one = letter_table(), shared.value
        for texts in batches:
            yield pd.DataFrame([one.predict(t, letters) for t in texts], columns=["lang_pred", "score"])

    return spread(docs.select(key, text)).select(F.col(key), held_out(key).alias("held_out"), run(F.col(text)).alias("_p")).select(key, "held_out", "_p.lang_pred", "_p.score")
