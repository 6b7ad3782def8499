"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

Every known token has a fixed sparse index vector, drawn from a hash of the token, and a context vector: the sum of the
index vectors of its neighbours in the training texts. A document is the mean over its tokens of both. The network ends
in a probability whose temperature is set on training rows that it was not fitted to.

The vocabulary, context vectors and pooled vectors come from Spark jobs over a bounded sample of labelled rows; what
reaches the driver is bounded by the settings: the vocabulary, its vectors, and one vector for each sampled document.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import arrow_map, durable, prepare, share_of, sized, spread, tasks_of, text_slices

DIM, ONES, REACH = 48, 6, 2
#: Of a pooled document: index and context vectors, and two shares of repeated words.
WIDTH = 2 * DIM + 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 40, 64, 3e-3, 1e-4
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
#: Tokens that stand for all unknown ones of a kind; they head every vocabulary.
KINDS = ["<word>", "<number>", "<mark>", "<upper>"]


def index_vector(token: str) -> np.ndarray:
    """A sparse ternary vector that depends on the token alone."""
    draw = np.random.default_rng(zlib.crc32(token.encode("utf-8", "surrogatepass")))
    v = np.zeros(DIM, dtype=np.float32)
    v[draw.choice(DIM, ONES, replace=False)] = np.where(np.arange(ONES) % 2, -1, 1)
    return v


def plain_tokens(word: str) -> list[str]:
    return TOKEN.findall(word.lower())


@dataclass
class Vocabulary:
    """Token ids of words between white space; words seen are remembered, up to ``memory`` of them."""

    ids: dict[str, int]
    memory: int = 100_000
    known: dict[str, list[int]] = field(default_factory=dict)

    def of(self, word: str) -> list[int]:
        out = []
        for token in TOKEN.findall(word):
            low = token.lower()
            kind = 0 if low[0].isalpha() else 1 if low[0].isdigit() else 2
            out.append(self.ids.get(low, kind))
            if kind == 0 and len(token) > 1 and token.isupper():
                out.append(3)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_words((text or "").split())

    def encode_words(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.memory:
            self.known = {}
        known = self.known
        for word in set(words):
            if word not in known:
                known[word] = self.of(word)
        return np.fromiter(chain.from_iterable(map(known.__getitem__, words)), dtype=np.int64)


@dataclass
class Model:
    tokens: list[str]
    vectors: np.ndarray  # of each token: its index vector and its context vector
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    prior: float

    def pooled(self, vocabulary: Vocabulary, texts: list[str | None]) -> np.ndarray:
        """Means of the tokens' vectors; the share of words that repeat the word before, and of different words."""
        out = np.zeros((len(texts), WIDTH), dtype=np.float32)
        for i, text in enumerate(texts):
            words = (text or "").split()
            ids = vocabulary.encode_words(words)
            for at in range(0, len(ids), 1 << 14):
                out[i, :-2] += self.vectors[ids[at : at + (1 << 14)]].sum(axis=0)
            out[i, :-2] /= max(1, len(ids))
            out[i, -2] = sum(map(eq, words, words[1:])) / max(1, len(words))
            out[i, -1] = np.log1p(len(set(words))) / np.log1p(max(1, len(words)))
        return out

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(pooled), self.prior)
        return sigmoid(forward(self.layers, (pooled - self.mean) / self.scale)[1] / self.temperature)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(x @ layers[0] + layers[1])
    return hidden, hidden @ layers[2] + layers[3][0]


def train(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[np.ndarray]:
    """Weights of the two layers by Adam on the cross entropy; the same rows in the same order give the same weights."""
    draw = np.random.default_rng(seed)
    layers = [draw.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(x))
        for at in range(0, len(x), BATCH):
            some = order[at : at + BATCH]
            hidden, logit = forward(layers, x[some])
            d = (sigmoid(logit) - y[some]) / len(some)
            back = np.outer(d, layers[2]) * (1 - hidden**2)
            grads = [x[some].T @ back, back.sum(axis=0), hidden.T @ d, np.array([d.sum()])]
            step += 1
            for k, g in enumerate(grads):
                g = g + DECAY * layers[k] * (k % 2 == 0)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] = layers[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return layers


def best_temperature(logit: np.ndarray, y: np.ndarray) -> float:
    """The temperature from 0.25 to 8 with the least cross entropy."""
    grid = 2.0 ** np.linspace(-2, 3, 51)
    loss = [float(np.mean(np.logaddexp(0, logit / t) - y * logit / t)) for t in grid]
    return float(grid[int(np.argmin(loss))])


def vocabulary_of(sample: DataFrame, size: int, least: int) -> list[str]:
    """The ``size`` tokens in most sampled documents, of those in at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(set(plain_tokens(text or "")))
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = arrow_map(sample.select("text"), run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return [*KINDS, *sorted(r["token"] for r in counted.orderBy(F.desc("n"), "token").limit(size).collect())]


def context_vectors(sample: DataFrame, tokens: list[str], index: np.ndarray) -> np.ndarray:
    """For each token the sum of the index vectors of its neighbours within REACH, over all sampled texts."""
    shared = sample.sparkSession.sparkContext.broadcast((tokens, index))
    n = len(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, index = shared.value
        vocabulary = Vocabulary({t: i for i, t in enumerate(tokens)})
        total = np.zeros((n, DIM))
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for start, end in text_slices(texts, 1 << 18):
                pairs = []
                for text in texts[start:end]:
                    ids = vocabulary.encode(text)
                    for reach in range(1, REACH + 1):
                        pairs += [ids[:-reach] * n + ids[reach:], ids[reach:] * n + ids[:-reach]]
                pair, times = np.unique(np.concatenate(pairs), return_counts=True)
                for at in range(0, len(pair), 1 << 16):
                    token, other = np.divmod(pair[at : at + (1 << 16)], n)
                    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
                    total[token[first]] += np.add.reduceat(index[other] * times[at : at + (1 << 16), None], first, axis=0)
        used = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["token", "vector"])

    each = arrow_map(sample.select("text"), run, "token long, vector array<double>")
    summed = each.groupBy("token").agg(F.array(*[F.sum(F.col("vector")[k]) for k in range(DIM)]).alias("vector")).collect()
    out = np.zeros((n, DIM), dtype=np.float32)
    for r in summed:
        out[r["token"]] = r["vector"]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def learn(docs: DataFrame, labels: DataFrame, bound: int = 4000, size: int = 8000, least: int = 3) -> Model:
    """Fit on at most about ``bound`` labelled documents, chosen by a hash of their id (every whole text of them).

    Where ids repeat so often that more than twice as many rows are drawn, these are thinned by a hash of id and text.

    docs: doc_id, text; labels: doc_id, quality (0 or 1; of several the larger). A fifth of the sample sets the
    temperature. With labels of one kind only, or none, the model is a constant.
    """
    spark = docs.sparkSession
    prepare(spark)
    kept = labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = kept.count()
    chosen = durable(kept.filter(share_of(F.col("doc_id"), bound, rows)), "labels")
    sample = docs.select("doc_id", "text").join(sized(chosen, 4 * bound), "doc_id").repartition(min(64, tasks_of(spark)), "doc_id")
    sample = durable(sample.select("text", "quality", F.xxhash64("doc_id", "text").alias("_order")), "labelled")
    if (drawn := sample.count()) > 2 * bound:
        sample = durable(sample.filter(share_of(F.struct("_order", F.monotonically_increasing_id()), bound, drawn)), "labelled")
    tokens = vocabulary_of(sample, size, least)
    index = np.stack([index_vector(t) for t in tokens])
    index /= ONES**0.5
    vectors = np.hstack([index, context_vectors(sample, tokens, index)])
    model = Model(tokens, vectors, np.zeros(WIDTH), np.ones(WIDTH), [], 1.0, 0.5)
    shared = spark.sparkContext.broadcast(model)

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        vocabulary = Vocabulary({t: i for i, t in enumerate(one.tokens)})
        for batch in batches:
            pooled = one.pooled(vocabulary, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(1).cast(pa.int32()), pa.array([v.tobytes() for v in pooled], pa.binary())], names=["o", "y", "x"])

    found = sorted(arrow_map(sample, pool, "o long, y int, x binary").collect())
    if not found:
        return model
    y = np.array([r["y"] for r in found], dtype=float)
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in found]).astype(float)
    model.prior = float((y.sum() + 1) / (len(y) + 2))
    calibration = np.arange(len(y)) % 5 == 4
    if len(set(y[~calibration])) < 2:
        return model
    model.mean = x[~calibration].mean(axis=0)
    model.scale = x[~calibration].std(axis=0) + 1e-4
    z = (x - model.mean) / model.scale
    model.layers = train(z[~calibration], y[~calibration])
    if calibration.any():
        model.temperature = best_temperature(forward(model.layers, z[calibration])[1], y[calibration])
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """The probability of label 1 for a text column; whole texts, null and blank ones included."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value
        vocabulary = Vocabulary({t: i for i, t in enumerate(one.tokens)})
        for texts in batches:
            yield pd.Series(one.probability(one.pooled(vocabulary, list(texts))))

    return run(F.col(text))


def held_out(key: str = "doc_id", parts: int = 3, part: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % parts == part, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """Per row of ``docs``: key, held_out, score, predicted. Labels of held-out keys are never learned from.

    Only the text decides a score. Null and blank texts get the score of a text without tokens; null keys are not held
    out; repeated rows are each scored; an empty table gives no rows; other columns are not read.
    """
    model = learn(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels.select("doc_id", "quality").filter(~held_out()), **settings)
    out = spread(docs.select(key, text)).select(key, held_out(key).alias("held_out"), score(docs, model, text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_accepted(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """The rows of ``docs`` whose score is 0.5 or more, with their columns as they are.

    Repeated rows, null keys, null and blank texts are scored like any other; an empty table stays empty; without labels
    of both kinds every row has the prior's score, 0.5 with none at all, and stays if that is 0.5 or more.
    """
    model = learn(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), labels.select("doc_id", "quality").filter(~held_out()), **settings)
    whole = spread(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), score(docs, model, text).alias("_score"))
    return whole.filter("_score >= 0.5").select("_row.*")
