"""The pipeline's rows against plain Python: what each stage must have removed, and exact packing of the rest."""

import re

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from chronotext.llm.common import durable
from tests.llm.test_operators import plain_fingerprint, plain_statistics


def test_pipeline(spark, small):
    documents = spark.read.parquet(f"{small}/documents.parquet")
    docs, counts = documents, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, small), name)
        assert docs.columns == documents.columns
        counts.append(docs.count())
    assert sorted(counts, reverse=True) == counts and counts[-1] > 0
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(texts) == counts[-1]
    for text in texts.values():
        n, _, _, _, repeated = plain_statistics(text)
        assert n >= 50 and 100 * repeated <= 50 * n
    prints = np.array([plain_fingerprint(t, 5) for t in texts.values()], dtype=np.uint64)
    for i in range(len(prints)):
        assert (np.bitwise_count(prints[i + 1 :] ^ prints[i]) > 4).all()
    items = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect() for w in [re.findall(r"\w+", r["text"].lower())] for i in range(len(w) - 12)}
    for text in texts.values():
        w = re.findall(r"\w+", text.lower())
        assert not any(tuple(w[i : i + 13]) in items for i in range(len(w) - 12))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = corpus_pipeline.run(spark, small)
    total = {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()}
