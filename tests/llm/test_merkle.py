"""The Merkle manifest against a plain tree over lists."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronotext.llm import merkle, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def joined(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return joined("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(digests, arity):
    """Root, and per leaf the (before, after) siblings of each level."""
    proofs, at, nodes = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = range(i // arity * arity, min(i // arity * arity + arity, len(nodes)))
            proofs[k].append(([nodes[j] for j in run if j < i], [nodes[j] for j in run if j > i]))
            at[k] = i // arity
        nodes = [joined(nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], proofs


def plain_manifest(rows, arity=3):
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r[f] for f in FIELDS)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([d for *_, d in sorted(by[s])], arity) for s in order}
    root, upper = plain_tree([trees[s][0] for s in order], arity)
    out = []
    for s, top in zip(order, upper, strict=True):
        for (there, key, digest), proof in zip(sorted(by[s]), trees[s][1], strict=True):
            text = ";".join(f"{''.join(a)}.{''.join(b)}" for a, b in proof + top)
            out.append((key if there else None, digest, trees[s][0], root, text))
    return sorted(out, key=repr)


def spark_manifest(frame, arity=3):
    out = merkle.manifest(frame, FIELDS, "source", "doc_id", arity=arity)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize(("arity", "bits"), [(3, 3), (2, 14)])
def test_manifest_equals_plain_trees(spark, small, monkeypatch, arity, bits):
    monkeypatch.setattr(merkle, "LEAF_BITS", bits)
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*FIELDS)
    assert spark_manifest(docs, arity) == plain_manifest(docs.collect(), arity)


def test_manifest_of_odd_rows(spark, monkeypatch):
    """Null ids, sources and texts, repeated rows, sources beyond ASCII, a hot source, and columns that clash with ours."""
    monkeypatch.setattr(merkle, "LEAF_BITS", 2)
    rows = [(i if i % 11 else None, [None, "", "é", "z", "😀", "￿"][i % 6] if i % 2 else "hot", "en" if i % 3 else None, i if i % 5 else None, ["", None, "a\nb", "ü" * 5000][i % 4]) for i in range(90)]
    rows += [(7, "hot", "en", 1, "same")] * 40
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    clash = ["leaf", "frag", "at", "gid", "root", "proof", "_tie", "first", "n"]
    assert spark_manifest(frame.withColumns({c: F.lit("clash") for c in clash})) == plain_manifest(frame.collect())
    one = frame.limit(1)
    assert spark_manifest(one) == plain_manifest(one.collect())
    assert spark_manifest(one)[0][4] == ""
    assert spark_manifest(frame.limit(0)) == []


def test_query_finds_what_was_tampered_with(spark, small):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op12_merkle_manifest(spark, small).collect()
    assert len(rows) == len(docs)
    for r in rows:
        changed = zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and "\n" in (docs[r["doc_id"]]["text"] or "")
        assert r["verified"] == (not changed) == (r["folded_root"] == r["root"])


def test_subroots_name_the_changed_group(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(*FIELDS)
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 5, "other").otherwise(F.col("text")))
    old, new = ({r["source"]: r["subroot"] for r in merkle.subroots(d, FIELDS, "source", "doc_id").collect()} for d in (docs, changed))
    source = docs.filter("doc_id = 5").first()["source"]
    assert {s for s in old if old[s] != new[s]} == {source}
    by_id = {m[0]: m[2] for m in plain_manifest(docs.collect())}
    assert old == {d["source"]: by_id[d["doc_id"]] for d in docs.collect()}
