"""Packing: documents become token sequences of a fixed length, placed by shortest-pack-first over the length histogram.

Only the histogram of piece lengths (at most ``length`` numbers) comes to the driver. Placing happens there on counts of
equal packs, longest lengths first, each into the shortest pack that has room. The patterns then go back to the pieces
by rank: the r-th piece of a length takes the r-th place that the patterns hold for this length.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain
from struct import pack
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from chronotext.llm.common import arrow_map, durable, rank_in_groups, sized, spread, text_slices
from chronotext.llm.tokens import byte_letters

#: Characters that Python splits at and the tokenizer's white space does not hold.
UNSAFE = re.compile("[\x1c-\x1f]")
#: Letters whose lower case depends on their place or is more than one character.
UNEVEN = frozenset("\u03a3\u0130")
MARKS = ".,!?;:\"'()[]{}*#$%&|-_/+=<>"


class WordEncoder:
    """Ids of whole texts by the tokenizer library, which sees each word, or each run of letters, once.

    Right for tokenizers that lower-case, drop white space and never join over it, as the word-level files do. A word of
    letters with marks behind is two of the tokenizer's own pre-tokens, which go straight to its merge model; any other
    word goes through the whole library. Texts with control characters that the two notions of white space treat unlike
    go to the library as they are. ``memory`` bounds the remembered words, twice that the runs; both live as long as the
    worker.
    """

    def __init__(self, path: str, memory: int = 120_000) -> None:
        self.library, self.memory = Tokenizer.from_file(path), memory
        self.model = self.library.model
        self.letters = str.maketrans(dict(enumerate(byte_letters())))
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {"": b""}

    def ids(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def run(self, letters: str) -> bytes:
        """Ids of one pre-token, a run of letters or of marks in normal form."""
        found = self.runs.get(letters)
        if found is None:
            tokens = self.model.tokenize(letters.encode().decode("latin-1").translate(self.letters))
            found = self.runs[letters] = pack(f"<{len(tokens)}I", *[t.id for t in tokens])
        return found

    def learn(self, words: Iterable[str]) -> None:
        known, run = self.words, self.run
        for word in words:
            core = word.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or is_normalized("NFC", core) and UNEVEN.isdisjoint(core)):
                low = core.lower()
                if low.isalpha():
                    known[word] = run(low) if len(core) == len(word) else run(low) + run(word[len(core) :])
                    continue
            known[word] = self.ids(word)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text. A slice's words are numbered by Arrow, so Python sees each once."""
        for start, end in text_slices(texts):
            if len(self.runs) > self.memory:
                self.runs = {"": b""}
            some = pa.array([t or "" for t in texts[start:end]], pa.large_string())
            odd = pc.match_substring_regex(some, UNSAFE.pattern)
            split = pc.utf8_split_whitespace(pc.if_else(odd, "", some))
            numbers = split.values.dictionary_encode()
            # One string of all words, cut by Python: much quicker than one object from Arrow each.
            words = pc.binary_join(pa.ListArray.from_arrays([0, len(numbers.dictionary)], numbers.dictionary), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
            found = list(map(self.words.get, words))
            if len(self.words) > self.memory:
                self.words = {w: ids for w, ids in zip(words, found, strict=True) if ids is not None}  # those that come again
            new = [i for i, ids in enumerate(found) if ids is None]
            self.learn([words[i] for i in new])
            for i in new:
                found[i] = self.words[words[i]]
            held = np.fromiter(map(len, found), np.int64, len(found)) // 4
            first = np.cumsum(held) - held
            of = numbers.indices.to_numpy()
            size = held[of]
            upto = np.r_[0, np.cumsum(size)]
            ids = np.frombuffer(b"".join(found), dtype="<u4")[np.repeat(first[of] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
            bounds = 4 * upto[split.offsets.to_numpy()]
            for i, whole in enumerate(odd.to_pylist()):
                yield self.ids(some[i].as_py()) if whole else ids[bounds[i] : bounds[i + 1]]


@lru_cache(maxsize=2)
def encoder_of(path: str) -> WordEncoder:
    """One encoder for each worker process: tasks that follow one another there share what it has seen."""
    return WordEncoder(path)


def tokenize_pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of at most ``length`` ids: key, start, length, doc_tokens, ids (binary, little-endian unsigned 32-bit).

    Each document's ids are followed by ``end_id``, so a null or empty text gives one piece of one id. Repeated rows and
    null keys each give pieces of their own; an empty table gives none; other columns are neither read nor returned.
    """
    source = spread(docs.select(key, text))
    schema = T.StructType([source.schema[0], *(T.StructField(n, T.LongType()) for n in ("start", "length", "doc_tokens")), T.StructField("ids", T.BinaryType())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            rows: list[tuple[int, int, int, bytes]] = []
            for i, ids in enumerate(encoder.encode(batch.column(1).to_pylist())):
                ids += end
                total = len(ids) // 4
                rows += [(i, at, total, ids[4 * at : 4 * (at + length)]) for at in range(0, total, length)]
            of, start, total, ids = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                names=schema.names,
            )

    return arrow_map(source, run, schema)


def pack_patterns(histogram: dict[int, int], length: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (piece lengths in order, how many packs) by shortest-pack-first, lengths placed longest first.

    histogram: how many pieces there are of each length from 1 to ``length``. The work depends on ``length`` alone.
    """
    open_packs: list[tuple[int, int, tuple]] = []  # (filled, serial, linked pattern), shortest first
    count: dict[int, int] = {}
    serial = 0
    closed: list[tuple[tuple, int]] = []

    def put(filled: int, pattern: tuple, n: int) -> None:
        nonlocal serial
        if filled == length:
            closed.append((pattern, n))
            return
        serial += 1
        count[serial] = n
        heapq.heappush(open_packs, (filled, serial, pattern))

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            if not open_packs or open_packs[0][0] + size > length:
                put(size, (size, None), left)
                left = 0
                continue
            filled, at, pattern = heapq.heappop(open_packs)
            n = count.pop(at)
            used = min(n, left)
            put(filled + size, (size, pattern), used)
            if n > used:
                put(filled, pattern, n - used)
            left -= used
    closed += [(pattern, count[at]) for _, at, pattern in sorted(open_packs, key=lambda x: x[1])]

    def unlinked(pattern: tuple) -> tuple[int, ...]:
        out = []
        while pattern:
            out.append(pattern[0])
            pattern = pattern[1]
        return tuple(reversed(out))

    return [(unlinked(p), n) for p, n in closed]


def places(spark: SparkSession, patterns: list[tuple[tuple[int, ...], int]]) -> DataFrame:
    """Places by length: the pieces of rank ``first`` to ``first + n - 1`` go to sequences from ``sequence`` on, at ``offset``."""
    taken: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for size in pattern:
            rows.append((size, taken.get(size, 0), n, sequence, offset))
            taken[size] = taken.get(size, 0) + n
            offset += size
        sequence += n
    return spark.createDataFrame(rows, "_length long, _first long, _n long, _sequence long, offset long")


def place(pieces: DataFrame, length: int = 2048, solve: Callable[[dict[int, int], int], list[tuple[tuple[int, ...], int]]] = pack_patterns) -> DataFrame:
    """Add sequence_id and offset to pieces with a column ``length``; the other columns go along. ``solve`` finds the
    patterns from the histogram.

    Every sequence is filled from 0 without gaps. Ranks within a length come from cells (see rank_in_groups), so one
    length may hold most of the pieces. The places of a length lie in blocks of ranks: pieces and places meet on the
    length and the block, never on the length alone.
    """
    spark = pieces.sparkSession
    kept = durable(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    block = 1 << max(0, max(histogram.values(), default=1).bit_length() - 10)
    ranked = rank_in_groups(kept, ["length"], F.struct(*kept.columns), kept.columns[:2], "_rank")
    slots = places(spark, solve(histogram, length)).withColumn(
        "_block", F.explode(F.sequence(F.expr(f"_first div {block}"), F.expr(f"(_first + _n - 1) div {block}")))
    )
    slots = sized(slots, 200_000)
    met = ranked.withColumn("_at", F.expr(f"_rank div {block}")).join(
        slots,
        (F.col("length") == F.col("_length")) & (F.col("_at") == F.col("_block")) & (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n")),
    )
    return met.withColumn("sequence_id", F.col("_sequence") + F.col("_rank") - F.col("_first")).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as placed pieces with their ids: key, start, length, doc_tokens, ids, sequence_id, offset."""
    return place(tokenize_pieces(docs, tokenizer, length, end_id, key, text), length)


def sequences(packed: DataFrame) -> DataFrame:
    """The training sequences themselves: sequence_id, ids (binary), length. At most ``length`` ids meet in a group."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_parts"), F.sum("length").alias("length"))
    return parts.select("sequence_id", F.aggregate("_parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"), "length")


def padding(histogram: dict[int, int], length: int) -> float:
    """The share of padded positions that shortest-pack-first leaves for a histogram."""
    patterns = pack_patterns(histogram, length)
    total = sum(n for _, n in patterns) * length
    return 1 - sum(n * sum(p) for p, n in patterns) / total if total else 0.0


def piece_lengths(patterns: list[tuple[tuple[int, ...], int]]) -> list[int]:
    """All lengths that the patterns hold, each as often as packs hold it (for small checks)."""
    return list(chain.from_iterable(list(p) * n for p, n in patterns))
