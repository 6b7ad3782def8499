"""Best-fit packing improved by local search: whole documents into as few sequences as can be found.

As in ``packing``, only the histogram of lengths comes to the driver and the found patterns go back to the pieces by
rank. Packs of one pattern are alike, so the search works on patterns with counts: it starts from best fit, longest
pieces first, then moves a piece, exchanges one for one, two for one or one for two between two underfull packs, each time
to the fuller one's gain. The sum of squared fills grows with every step; packs run empty on the way.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chronotext.llm.common import arrow_map, spread, text_slices
from chronotext.llm.packing import place
from chronotext.llm.tokens import PRETOKEN, TokenCounter, byte_letters

Pattern = tuple[int, ...]  # lengths of a pack's pieces, longest first


class Spelled(dict):
    """Ids of pieces with a space before them, encoded when first asked for."""

    def __init__(self, spell: Callable[[str], bytes]) -> None:
        super().__init__()
        self.spell = spell

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = self.spell(" " + piece)
        return found


class TokenEncoder(TokenCounter):
    """Ids of texts by a byte-level BPE file. What lies between spaces is met again and again and encoded once, by ranks
    read from the file. ``memory`` bounds the remembered pieces.

    Ranks alone give the file's ids where its merges make each token once and in the order of ids, as training does;
    another file is refused.
    """

    def __init__(self, path: str, memory: int = 400_000) -> None:
        super().__init__(path, memory)
        if (np.diff(self.merger.made[np.argsort(self.merger.rank)]) <= 0).any() or self.merger.letter.max() >= self.merger.made.min():
            raise ValueError(f"{path}: merges are not in the order of ids")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.marks = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in spec["added_tokens"]}
        byte = {c: i for i, c in enumerate(byte_letters())}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in self.marks}
        self.ranked = tiktoken.Encoding(path, pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})
        self.ids = Spelled(self.spelled)

    def spelled(self, text: str) -> bytes:
        return array("I", self.ranked.encode_ordinary(text)).tobytes()

    def run(self, text: str) -> bytes:
        """Ids of a text without special strings."""
        head, rest = self.pieces(text)
        return self.spelled(head) + b"".join(map(self.ids.__getitem__, rest))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text; special strings inside a text are their own ids."""
        for start, end in text_slices(texts):
            if len(self.ids) > self.memory:
                self.ids = Spelled(self.spelled)
            for text in texts[start:end]:
                if self.special and text and (found := self.special.findall(text)):
                    runs = self.special.split(text)
                    yield self.run(runs[0]) + b"".join(self.marks[m] + self.run(r) for m, r in zip(found, runs[1:], strict=True))
                else:
                    yield self.run(text or "")


@lru_cache(maxsize=2)
def encoder_of(path: str) -> TokenEncoder:
    """One for each worker process."""
    return TokenEncoder(path)


def whole_pieces(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as pieces: key, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    Each document's ids are followed by ``end_id``. Only a longer document than ``length`` is cut, into pieces of that
    length behind a first one that may be shorter. Null and empty texts give one piece of one id; repeated rows and null
    keys give pieces of their own; an empty table gives none; other columns are neither read nor returned.
    """
    source = spread(docs.select(key, text))
    schema = T.StructType([source.schema[0], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())])
    end = np.array([end_id], dtype="<u4").tobytes()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            of, piece, start, ids = [], [], [], []
            for i, found in enumerate(encoder.encode(batch.column(1).to_pylist())):
                found += end
                n = len(found) // 4
                cuts = [0, *range((n - 1) % length + 1, n, length), n]
                for k in range(len(cuts) - 1):
                    of.append(i)
                    piece.append(k)
                    start.append(cuts[k])
                    ids.append(found[4 * cuts[k] : 4 * cuts[k + 1]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                names=schema.names,
            )

    return arrow_map(source, step, schema)


def best_fit(histogram: dict[int, int], length: int) -> Counter[Pattern]:
    """Patterns and counts of best fit, longest pieces first: each goes into the fullest pack with room."""
    packs: list[dict[Pattern, int]] = [{} for _ in range(length + 1)]  # by room left
    rooms: list[int] = []  # rooms that some pack has, ascending

    def put(room: int, pattern: Pattern, n: int) -> None:
        if not packs[room]:
            rooms.insert(bisect_left(rooms, room), room)
        packs[room][pattern] = packs[room].get(pattern, 0) + n

    for size in sorted(histogram, reverse=True):
        left = histogram[size]
        while left:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                put(length - size, (size,), left)
                break
            room = rooms[at]
            pattern, n = packs[room].popitem()
            if not packs[room]:
                rooms.pop(at)
            used = min(n, left)
            if n > used:
                put(room, pattern, n - used)
            put(room - size, (*pattern, size), used)
            left -= used
    return Counter({pattern: n for held in packs for pattern, n in held.items()})


@lru_cache(maxsize=1 << 14)
def sums(pattern: Pattern) -> tuple[np.ndarray, np.ndarray, dict[int, Pattern]]:
    """Lengths of single pieces and of pairs of a pack, ascending, and the pieces that give each."""
    count = Counter(pattern)
    sizes = sorted(count)
    pairs = {a + b: (a, b) for i, a in enumerate(sizes) for b in sizes[i:] if a != b or count[a] > 1}
    return np.array(sizes), np.array(sorted(pairs), dtype=np.int64), pairs


NONE = np.zeros(1, dtype=np.int64)


def best_exchange(taker: Pattern, giver: Pattern, room: int) -> tuple[int, Pattern, Pattern]:
    """(gain, pieces the taker gets, pieces it gives back): the largest gain up to ``room``; gain 0 if there is none.

    A move, one for one, two for one and one for two.
    """
    one_in, two_in, in_pairs = sums(giver)
    one_out, two_out, out_pairs = sums(taker)
    best: tuple[int, Pattern, Pattern] = (0, (), ())
    for into, out in ((one_in, NONE), (one_in, one_out), (two_in, one_out), (one_in, two_out)):
        if len(into) and len(out):
            at = np.searchsorted(into, out + room, side="right") - 1
            gain = np.where(at >= 0, into[at] - out, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                gets, gives = int(into[at[k]]), int(out[k])
                best = int(gain[k]), in_pairs[gets] if into is two_in else (gets,), out_pairs[gives] if out is two_out else () if out is NONE else (gives,)
                if best[0] == room:
                    break
    return best


def exchanged(pattern: Pattern, out: Pattern, into: Pattern) -> Pattern:
    return tuple(sorted((Counter(pattern) - Counter(out) + Counter(into)).elements(), reverse=True))


def local_search(packs: Counter[Pattern], length: int, looks: int = 400_000) -> Counter[Pattern]:
    """Improve packs until no exchange helps, the least possible number of packs is met, or ``looks`` pairs of patterns
    were looked at (the packing is whole at every step; the bound is on effort alone).

    A step takes from the emptiest packs it can and gives to the fullest that gain, for as many pairs of packs as there
    are of the two patterns. It works on patterns, so its cost does not follow the number of packs.
    """
    packs = Counter(packs)
    least = -(-sum(sum(p) * n for p, n in packs.items()) // length)
    total = sum(packs.values())
    fill = {p: sum(p) for p in packs}
    open_packs = sorted((fill[p], p) for p in packs if fill[p] < length)
    barren: set[tuple[Pattern, Pattern]] = set()

    def change(pattern: Pattern, n: int) -> None:
        if pattern not in packs and n > 0:
            fill[pattern] = sum(pattern)
            if fill[pattern] < length:
                insort(open_packs, (fill[pattern], pattern))
        packs[pattern] += n
        if not packs[pattern]:
            del packs[pattern]
            if fill[pattern] < length:
                del open_packs[bisect_left(open_packs, (fill[pattern], pattern))]

    def next_step() -> tuple[Pattern, Pattern, Pattern, Pattern] | None:
        nonlocal looks
        for i, (_, giver) in enumerate(open_packs):
            for _, taker in reversed(open_packs[i:]):
                if (taker, giver) in barren or taker == giver and packs[giver] < 2:
                    continue
                looks -= 1
                gain, into, out = best_exchange(taker, giver, length - fill[taker])
                if gain:
                    return taker, giver, into, out
                barren.add((taker, giver))
                if looks <= 0:
                    return None
        return None

    while looks > 0 and total > least and (step := next_step()):
        taker, giver, into, out = step
        pairs = packs[giver] // 2 if taker == giver else min(packs[taker], packs[giver])
        change(taker, -pairs)
        change(giver, -pairs)
        change(exchanged(taker, out, into), pairs)
        if rest := exchanged(giver, into, out):
            change(rest, pairs)
        else:
            total -= pairs
    return packs


def patterns(histogram: dict[int, int], length: int) -> list[tuple[Pattern, int]]:
    """Best fit and local search; an empty histogram gives no patterns."""
    return sorted(local_search(best_fit(histogram, length), length).items(), reverse=True)


def pack_whole(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as placed pieces with their ids: key, piece, start, length, ids, sequence_id, offset."""
    return place(whole_pieces(docs, tokenizer, length, end_id, key, text), length, patterns)
