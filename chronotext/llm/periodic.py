"""Periodic runs of words, by linear-time detection of tandem repeats.

The words of a batch become one sequence of numbers with a number of its own between any two stretches, so no repeat
crosses texts. Longest-previous-factor blocks of that sequence yield squares that cover the leftmost occurrence of every
square; suffix-link walks in the suffix tree turn each into its rotations that occur anywhere, which completes the
vocabulary of squares; the leaves below a square's place are its occurrences. Occurrences of primitive squares of one
period at consecutive places merge into runs.

Words that lie in no window that occurs again in their text cannot lie in a run of the length asked for; the sequence is
cut there first, so the trees are built over the rest only.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.llm.common import arrow_map, spread, text_slices

Runs = list[tuple[int, int, int]]  # start, length, period


def suffix_order(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and ranks by prefix doubling; only suffixes whose rank is still shared are sorted again."""
    _, rank = np.unique(s, return_inverse=True)
    n, width = len(s), 1
    order = np.argsort(rank, kind="stable")
    rank = rank.astype(np.int64)
    starts = np.flatnonzero(np.r_[True, np.diff(rank[order]) != 0])
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))  # a rank is the first place of its class
    while True:
        sizes = np.diff(np.r_[starts, n])
        shared = np.repeat(sizes > 1, sizes)
        places = np.flatnonzero(shared)
        if not len(places):
            return order, rank
        members = order[places]
        after = np.where(members + width < n, rank[np.minimum(members + width, n - 1)], -1)
        again = np.lexsort((after, rank[members]))
        members, after = members[again], after[again]
        order[places] = members
        old = rank[members]
        fresh = np.r_[True, (old[1:] != old[:-1]) | (after[1:] != after[:-1])]
        rank[members] = places[np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))]
        starts = np.union1d(starts, places[fresh])
        width *= 2


def common_prefixes(s: list[int], order: list[int], rank: list[int]) -> list[int]:
    """Of each suffix and the one before it in order; 0 for the first."""
    n, h = len(s), 0
    out = [0] * n
    for i, r in enumerate(rank):
        if r:
            j = order[r - 1]
            top = n - max(i, j)
            while h < top and s[i + h] == s[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def previous_factors(order: list[int], common: list[int]) -> list[int]:
    """For each place the length of the longest factor that also begins earlier."""
    n = len(order)
    out = [0] * n
    stack: list[tuple[int, int]] = []  # (place, common prefix with the one below), places ascending
    for r in range(n + 1):
        i, h = (order[r], common[r]) if r < n else (-1, 0)
        while stack and stack[-1][0] > i:
            j, below = stack.pop()
            out[j] = max(below, h)
            h = min(below, h)
        stack.append((i, h))
    return out


def agreements(pattern: list[int], text: list[int]) -> list[int]:
    """For each place of ``text`` how far it agrees with the beginning of ``pattern``."""
    m = len(pattern)
    s = [*pattern, None, *text]
    z = [0] * len(s)
    left = right = 0
    for i in range(1, len(s)):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < len(s) and s[k] == s[i + k] and k < m:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z[m + 1 :]


def agreement(s: list[int], i: int, j: int, most: int, step: int) -> int:
    """How many places from i and j on (``step`` 1 or -1) agree, up to ``most``; i < j."""
    n = min(most, len(s) - j if step > 0 else i + 1)
    k = 0
    while k < n and s[i] == s[j]:
        i, j, k = i + step, j + step, k + 1
    return k


def over_end(s: list[int], h: int, end: int, halves: list[int]) -> Iterator[tuple[int, int, int]]:
    """(half, forward, backward) of the squares that reach over a block's end: how far the places from end on agree with
    those a half before, and how far backwards before it. Places are compared one by one up to a linear number of steps."""
    size, steps = end - h, 0
    while halves and steps <= 8 * size:
        k = halves.pop()
        found = k, agreement(s, end - k, end, k, 1), agreement(s, end - k - 1, end - 1, k - 1, -1)
        steps += found[1] + found[2]
        yield found
    if not halves:
        return
    ahead = agreements(s[end : end + size], s[h : end + size])
    back = agreements(s[h:end][::-1], s[max(0, h - size) : end][::-1])
    for k in halves:
        yield k, min(ahead[size - k], k), min(back[k], k - 1) if k < len(back) else 0


def over_start(s: list[int], h: int, upto: int, halves: list[int]) -> Iterator[tuple[int, int, int]]:
    """The same for squares that begin at or before a block and have their centre in it or the next."""
    span, steps = upto - h, 0
    while halves and steps <= 8 * span:
        k = halves.pop()
        found = k, agreement(s, h, h + k, k, 1), agreement(s, h - 1, h + k - 1, k - 1, -1) if h else 0
        steps += found[1] + found[2]
        yield found
    if not halves:
        return
    ahead = agreements(s[h : h + span], s[h : h + 2 * span])
    low = max(0, h - span)
    back = agreements(s[low:h][::-1], s[low:upto][::-1]) if h else []
    for k in halves:
        yield k, min(ahead[k], k), min(back[span - k], k - 1) if h else 0


def covering_squares(s: list[int], blocks: list[int]) -> Iterator[tuple[int, int]]:
    """(start, half) of squares that cover the leftmost occurrence of every square: for each block those that reach over
    its end and those that begin at or before it and have their centre near. Either way a known place must equal the one
    a half further, which leaves few halves to look at; their agreements are compared one by one up to a number of steps
    linear in the block, the rest counted in linear time."""
    for b in range(len(blocks) - 1):
        h, end = blocks[b], blocks[b + 1]
        upto = blocks[b + 2] if b + 2 < len(blocks) else end
        if end < len(s):
            number = s[end]
            for k, forward, backward in over_end(s, h, end, [k for k in range(1, end - h + 1) if s[end - k] == number]):
                if forward and forward + backward >= k:
                    yield end - k - backward, k
        number = s[h]
        for k, forward, backward in over_start(s, h, upto, [k for k in range(1, min(upto, len(s) - 1) - h + 1) if s[h + k] == number]):
            if forward and forward + backward >= k:
                yield h - backward, k


@lru_cache(maxsize=1 << 16)
def divisors(n: int) -> list[int]:
    """Proper divisors, smallest first."""
    low = [d for d in range(1, int(n**0.5) + 1) if n % d == 0]
    return sorted({*low, *(n // d for d in low)} - {n})


def primitive(s: list[int], squares: Iterable[tuple[int, int]]) -> dict[int, list[int]]:
    """Halves by start of the squares that no shorter period holds. By ascending half: a square is one of those if it lies
    in a run already met whose period divides its half."""
    met: dict[int, list[tuple[int, int]]] = {}  # runs by period, by start
    out: dict[int, list[int]] = defaultdict(list)
    for half, start in sorted({(half, start) for start, half in squares}):
        end = start + 2 * half

        def held(p: int) -> bool:
            runs = met.get(p, ())
            i = bisect_right(runs, (start, len(s))) - 1
            return i >= 0 and runs[i][1] >= end

        if any(p in met and held(p) for p in divisors(half)):
            continue
        out[start].append(half)
        if not held(half):
            left = agreement(s, start - 1, start - 1 + half, len(s), -1) if start else 0
            right = agreement(s, end - half, end, len(s), 1) if end < len(s) else 0
            met.setdefault(half, []).append((start - left, end + right))
    return out


class SuffixTree:
    """The suffix tree over a sequence whose last number occurs once. Nodes: places are leaves, then inner nodes."""

    def __init__(self, s: np.ndarray) -> None:
        self.s = s.tolist()
        n = self.n = len(s)
        order, rank = suffix_order(s)
        self.order, self.rank = order.tolist(), rank.tolist()
        self.common = common_prefixes(self.s, self.order, self.rank)
        depth, low, high, parent = [0], [0], [n - 1], [-1]  # inner nodes, the root first
        above = [0] * n  # parents of leaves, by place in order
        stack = [0]
        for r in range(1, n + 1):
            h = self.common[r] if r < n else 0
            last, begin = -1, r - 1  # what is closed and hangs below the next node on the stack
            while depth[stack[-1]] > h:
                if last < 0:
                    above[r - 1] = stack[-1]
                top = stack.pop()
                high[top] = r - 1
                if last >= 0:
                    parent[last] = top
                last, begin = top, low[top]
            if depth[stack[-1]] < h:
                depth.append(h)
                low.append(begin)
                high.append(-1)
                parent.append(-1)
                stack.append(len(depth) - 1)
                if last < 0:
                    above[r - 1] = stack[-1]
            elif last < 0:
                above[r - 1] = stack[-1]
            if last >= 0:
                parent[last] = stack[-1]
        self.depth, self.low, self.high, self.parent, self.above = depth, low, high, parent, above
        self.links = [0] + [-1] * (len(depth) - 1)
        self.edges()

    def edges(self) -> None:
        """Children as one sorted table of (parent, first number), leaves as ``inner + place in order``."""
        n, m, s, order = self.n, len(self.depth), np.array(self.s), np.array(self.order)
        self.inner = m
        depth, parent = np.array(self.depth), np.array(self.parent + self.above)
        begin = np.r_[np.array(self.low), np.arange(n)]
        at = np.minimum(order[begin] + depth[np.maximum(parent, 0)], n - 1)
        self.width = int(s.max()) + 1
        keys = np.where(parent >= 0, parent * self.width + s[at], -1)
        by = np.argsort(keys, kind="stable")
        self.keys, self.children = array("q", keys[by].tobytes()), array("q", by.tobytes())

    def child(self, node: int, number: int) -> int:
        key = node * self.width + number
        i = bisect_left(self.keys, key)
        return self.children[i] if i < len(self.keys) and self.keys[i] == key else -1

    def depth_of(self, node: int) -> int:
        return self.depth[node] if node < self.inner else self.n - self.order[node - self.inner]

    def parent_of(self, node: int) -> int:
        return self.parent[node] if node < self.inner else self.above[node - self.inner]

    def first_of(self, node: int) -> int:
        """A place where the node's text occurs."""
        return self.order[self.low[node] if node < self.inner else node - self.inner]

    def below(self, node: int, at: int, depth: int) -> int:
        """From inner ``node`` down the text at place ``at`` to the first node at least so deep (it must exist)."""
        while self.depth_of(node) < depth:
            node = self.child(node, self.s[at + self.depth_of(node)])
        return node

    def link(self, v: int) -> int:
        """The inner node of v's text without its first number; found once, after those of the nodes above."""
        chain = []
        while self.links[v] < 0:
            chain.append(v)
            v = self.parent[v]
        for v in reversed(chain):
            self.links[v] = self.below(self.links[self.parent[v]], self.first_of(v) + 1, self.depth[v] - 1)
        return self.links[v]

    def places_of(self, squares: dict[int, list[int]]) -> Iterator[tuple[int, int, int]]:
        """(start, half, the first node at least 2 * half deep on the way to start's leaf), by one pass over the leaves."""
        nodes = np.lexsort((np.array(self.depth), np.array(self.low))).tolist()
        low, high, depth = self.low, self.high, self.depth
        path: list[int] = []
        depths: list[int] = []
        i = 0
        for r in sorted(self.rank[at] for at in squares):
            while i < self.inner and low[nodes[i]] <= r:
                v = nodes[i]
                i += 1
                if high[v] < r:
                    continue
                while path and high[path[-1]] < low[v]:
                    path.pop()
                    depths.pop()
                path.append(v)
                depths.append(depth[v])
            while path and high[path[-1]] < r:
                path.pop()
                depths.pop()
            for half in squares[self.order[r]]:
                j = bisect_left(depths, 2 * half)
                yield self.order[r], half, path[j] if j < len(path) else self.inner + r

    def vocabulary(self, squares: dict[int, list[int]]) -> dict[int, list[int]]:
        """Half lengths to the nodes of all their squares in the text: each covering square and, by suffix links, its
        rotations as long as they occur."""
        found: dict[int, list[int]] = defaultdict(list)
        seen: set[tuple[int, int]] = set()
        s = self.s
        for at, half, node in self.places_of(squares):
            length = 2 * half
            while (node, half) not in seen:
                seen.add((node, half))
                found[half].append(node)
                u = self.parent_of(node)
                number = s[at]
                v = self.below(self.link(u), at + 1, length - 1)
                if self.depth_of(v) == length - 1:
                    v = self.child(v, number) if v < self.inner else -1
                elif s[self.first_of(v) + length - 1] != number:
                    v = -1
                if v < 0:
                    break
                node, at = v, self.first_of(v)
        return found

    def occurrences(self, node: int) -> list[int]:
        return self.order[self.low[node] : self.high[node] + 1] if node < self.inner else [self.order[node - self.inner]]


def runs_of(s: np.ndarray) -> Runs:
    """All maximal runs (length at least twice the smallest period) of a sequence, by period, then start."""
    if len(s) < 2:
        return []
    s = np.r_[s, s.max() + 1]  # an end that occurs once
    tree = SuffixTree(s)
    longest = previous_factors(tree.order, tree.common)
    blocks, at = [], 0
    while at < len(s):
        blocks.append(at)
        at += max(1, longest[at])
    squares = primitive(tree.s, covering_squares(tree.s, [*blocks, len(s)]))
    out: Runs = []
    for half, nodes in sorted(tree.vocabulary(squares).items()):
        places = np.sort(np.array([i for v in nodes for i in tree.occurrences(v)], dtype=np.int64))
        cut = np.flatnonzero(np.diff(places) != 1)
        starts, ends = places[np.r_[0, cut + 1]].tolist(), (places[np.r_[cut, len(places) - 1]] + 2 * half).tolist()
        out += [(a, b - a, half) for a, b in zip(starts, ends, strict=True)]
    return out


def window_width(least: int, times: int) -> int:
    """The widest window of which a run of period q and at least max(least, times * q) words repeats every one q apart."""
    return max(1, min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1)))


def recurring(ids: np.ndarray, of: np.ndarray, width: int, times: int) -> np.ndarray:
    """Which words lie in a window of ``width`` words that occurs again in the same stretch (``of``), no farther off than
    its length over ``times``: no run there has a longer period."""
    n = len(ids) - width + 1
    if n < 2:
        return np.zeros(len(ids), dtype=bool)
    with np.errstate(over="ignore"):
        h = of[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for j in range(width):
            h = (h ^ ids[j : j + n].astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
    bits = min(22, n.bit_length() + 3)
    slot = (h >> np.uint64(64 - bits)).astype(np.int64)
    whole = np.flatnonzero((of[:n] == of[width - 1 :]) & (np.bincount(slot, minlength=1 << bits)[slot] > 1))
    by = whole[np.argsort(h[whole], kind="stable")]
    same = np.flatnonzero(h[by[1:]] == h[by[:-1]])
    left, right = by[same], by[same + 1]
    near = (right - left) * times <= np.bincount(of)[of[left]]
    twice = np.union1d(left[near], right[near])
    return np.cumsum(np.bincount(twice, minlength=len(ids)) - np.bincount(twice + width, minlength=len(ids))[: len(ids)]) > 0


def stretches(marked: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of the marked stretches, cut where ``of`` changes."""
    change = np.r_[True, of[1:] != of[:-1]]
    first = marked & (change | ~np.r_[False, marked[:-1]])
    last = marked & np.r_[change[1:] | ~marked[1:], True]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def runs_of_texts(ids: np.ndarray, sizes: np.ndarray, least: int, times: int) -> list[Runs]:
    """Per text its runs of at least max(least, times * period) words, by start, then period; ``ids`` are the words of
    all texts, ``sizes`` how many each has."""
    out: list[Runs] = [[] for _ in sizes]
    if not len(ids):
        return out
    of, offset = np.repeat(np.arange(len(sizes)), sizes), np.r_[0, np.cumsum(sizes)]
    width = window_width(least, times)
    group, kept = of, np.arange(len(ids))
    for _ in range(4):  # a window must come again inside its own stretch, so a cut can lead to more
        begins, ends = stretches(recurring(ids[kept], group, width, times), group)
        begins, ends = begins[ends - begins >= least], ends[ends - begins >= least]
        if not len(begins):
            return out
        lengths = ends - begins
        total = lengths.sum()
        settled = total == len(kept)
        kept = kept[np.repeat(begins - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(total)]
        group = np.repeat(np.arange(len(begins)), lengths)
        if settled:
            break
    lengths = np.bincount(group)
    _, numbers = np.unique(ids[kept], return_inverse=True)
    place = np.arange(len(kept)) + group  # one number of its own behind each stretch
    s = np.empty(len(kept) + len(lengths), dtype=np.int64)
    s[place] = numbers
    s[np.cumsum(lengths) + np.arange(len(lengths))] = numbers.max() + 1 + np.arange(len(lengths))
    back = np.full(len(s), -1, dtype=np.int64)
    back[place] = kept
    for start, length, period in runs_of(s):
        if length >= max(least, times * period):
            at = int(back[start])
            out[of[at]].append((at - int(offset[of[at]]), length, period))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of some texts (what lies between blanks and the characters 9 to 13), and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    there = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy()
    return flat.filter(pa.array(there)), np.diff(np.r_[0, np.cumsum(there)][offsets - offsets[0]])


def joined(words: pa.Array, sizes: np.ndarray, runs: list[Runs]) -> pa.Array:
    """The words of each text with one blank between, each run keeping its first period only."""
    offset = np.r_[0, np.cumsum(sizes)]
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for begin, found in zip(offset, runs, strict=False):
        for start, length, period in found:
            drop[begin + start + period] += 1
            drop[begin + start + length] -= 1
    stay = np.cumsum(drop[:-1]) == 0
    left = np.r_[0, np.cumsum(stay)][offset]
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.filter(pa.array(stay))), " ")


def strongest(runs: str | Column) -> Column:
    """The run of the greatest exact length / period (ties: the first by start, then period), null if there is none."""
    runs = F.col(runs) if isinstance(runs, str) else runs
    return F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best))


def spelled(runs: str | Column) -> Column:
    """``start,length,period`` and a line end for each run."""
    line = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return F.array_join(line, "")


def words_array(text: str | Column) -> Column:
    """The words of a text, none of a null one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def with_period(words: Column, start: Column, period: Column) -> Column:
    """The words with those from ``start`` on replaced by the ``period`` words there, over and over."""
    left = F.size(words) - start
    again = F.flatten(F.array_repeat(F.slice(words, start + 1, period), F.ceil(left / period).cast("int")))
    return F.concat(F.slice(words, F.lit(1), start), F.slice(again, F.lit(1), left))


def find_runs(docs: DataFrame, least: int = 6, times: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_words, runs (array of start, length, period by start, then period), collapsed.

    A run is a stretch of consecutive words with smallest period q, at least max(``least``, ``times`` * q) long (times is
    2 or more), that no neighbouring word extends. Words are numbered from 0. collapsed: the words of no run's repeats,
    each run keeping its first period, with one blank between. Null text counts as empty: no runs, collapsed empty. Texts
    of any length are taken whole. Repeated rows and null keys give rows of their own, an empty table gives none; other
    columns of ``docs`` are neither read nor returned.
    """
    if times < 2 or least < 2:
        raise ValueError("a run holds its period twice at least")
    source = spread(docs.select(key, text))
    run = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([source.schema[0], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in text_slices(batch.column(1).cast(pa.binary()).to_pylist()):
                words, sizes = split_words(batch.column(1).slice(begin, end - begin))
                runs = runs_of_texts(words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes, least, times)
                listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(sizes, pa.int64()), pa.array(listed, kind), joined(words, sizes, runs)], names=schema.names)

    return arrow_map(source, step, schema)
