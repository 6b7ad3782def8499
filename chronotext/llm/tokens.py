"""Token counts: byte-level BPE over batches of pre-tokens held as ragged numpy arrays.

All pre-tokens of a batch advance together. In each round every pre-token finds the lowest rank among its adjacent
pairs and merges all places of that pair at once; pre-tokens without a mergeable pair leave the arrays and report how
many symbols are left. Results equal the tokenizer file's own library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronotext.llm.common import arrow_map, spread, text_slices

#: The byte-level pre-tokenizer's pattern (a fixed value of the tokenizer file's kind).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes stand for themselves."""
    plain = [b for r in ((33, 126), (161, 172), (174, 255)) for b in range(r[0], r[1] + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class RankMerger:
    """The merge table of a byte-level BPE file, applied to many byte strings at once."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.width = max(vocab.values()) + 1
        self.letter = np.array([vocab[c] for c in byte_letters()], dtype=np.int64)
        left, right, made = (np.array([vocab[x(m)] for m in merges], dtype=np.int64) for x in (lambda m: m[0], lambda m: m[1], "".join))
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int32), made[order]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.made[np.searchsorted(self.keys, a * self.width + b)]

    def counts(self, words: list[bytes]) -> np.ndarray:
        """How many symbols are left of each byte string (none of an empty one)."""
        left = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.letter[np.frombuffer(b"".join(words), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(words)), left)
        rank = np.full(len(sym), NONE, dtype=np.int32)
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        rank[inner] = self.ranks(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[starts, len(seq)])
            least = np.minimum.reduceat(rank, starts)
            done = least == NONE
            if done.any():
                left[seq[starts[done]]] = size[done]
                stay = np.repeat(~done, size)
                sym, seq, rank = sym[stay], seq[stay], rank[stay]
                size, least = size[~done], least[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # Places of a pair of equal symbols can overlap; the leftmost of each run counts, then every second.
            first = np.r_[True, np.diff(hit) != 1]
            at = np.arange(len(hit))
            hit = hit[(at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0]
            sym[hit] = self.merged(sym[hit], sym[hit + 1])
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            place = (np.cumsum(keep) - 1)[hit]
            sym, seq, rank = sym[keep], seq[keep], rank[keep]
            touched = np.unique(np.r_[place, place[place > 0] - 1])
            rank[touched] = NONE
            touched = touched[touched + 1 < len(sym)]
            touched = touched[seq[touched] == seq[touched + 1]]
            rank[touched] = self.ranks(sym[touched], sym[touched + 1])
        return left


class TokenCounter:
    """Counts tokens of texts; pieces between spaces are merged once and remembered, up to ``memory`` of them."""

    def __init__(self, path: str, memory: int = 400_000) -> None:
        self.merger, self.memory = RankMerger(path), memory
        self.pattern = regex.compile(PRETOKEN)
        self.special = re.compile("(?:" + "|".join(map(re.escape, self.merger.special)) + ")") if self.merger.special else None
        self.odd = re.compile(r" \s| $")
        self.cut = re.compile(r"(?= \S)")
        self.heads: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> tuple[str, list[str]]:
        """Head, and the pieces that each follow one space.

        A space before a character that is no white space always begins a pre-token, so nothing crosses these cuts.
        """
        if not self.odd.search(text):
            head, *rest = text.split(" ")
            return head, rest
        head, *rest = self.cut.split(text)
        if head.startswith(" ") and len(head) > 1 and not head[1].isspace():
            head, rest = "", [head, *rest]
        return head, [r[1:] for r in rest]

    def learn(self, heads: Iterable[str], pieces: Iterable[str]) -> None:
        new = [(self.heads, h, h) for h in heads] + [(self.known, p, " " + p) for p in pieces]
        found = [self.pattern.findall(text) for _, _, text in new]
        words = list(set().union(*found))
        count = dict(zip(words, self.merger.counts([w.encode("utf-8", "surrogatepass") for w in words]).tolist(), strict=True))
        for (into, key, _), tokens in zip(new, found, strict=True):
            into[key] = sum(map(count.__getitem__, tokens))

    def count(self, texts: list[str | None]) -> list[int]:
        out: list[int] = []
        for start, end in text_slices(texts):
            if len(self.known) + len(self.heads) > self.memory:
                self.known, self.heads = {}, {}
            parts = []
            for text in texts[start:end]:
                runs = self.special.split(text or "") if self.special and text and "<" in text else [text or ""]
                parts.append([self.pieces(run) for run in runs])
            self.learn({h for p in parts for h, _ in p} - self.heads.keys(), set().union(*(r for p in parts for _, r in p)) - self.known.keys())
            known = self.known.__getitem__
            out += [len(p) - 1 + sum(self.heads[h] + sum(map(known, rest)) for h, rest in p) for p in parts]
        return out


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per row of ``docs``: key, n_bytes, n_tokens, over_limit (n_tokens > ``limit``); no shuffle.

    tokenizer: path of a byte-level BPE .json file, the same on every executor. Null text counts as empty (0 bytes, 0
    tokens, not over). Texts of any length are taken whole. Repeated rows are each counted, a null key stays null, an
    empty table gives no rows, and other columns of ``docs`` are neither read nor returned. Special strings inside a
    text count as one token, as the library's default does.
    """
    source = spread(docs.select(key, text))
    schema = T.StructType([source.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or TokenCounter(tokenizer)
            texts = batch.column(1).to_pylist()
            tokens = counter.count(texts)
            sizes = [len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], names=schema.names)

    return arrow_map(source, run, schema)
