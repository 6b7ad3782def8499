"""Links between texts whose sets of word shingles overlap by a given share (Jaccard similarity).

Four differing bits of a 64-bit fingerprint stand for a similarity of about 0.97, and no radius that reaches 0.8 (up to
18 bits) can be searched at scale. This module adds the missing links. Each text keeps the least values of its shingles
under PERMUTATIONS fixed permutations, two bits of each; texts that agree in one of BANDS groups of them share a bucket.
A pair in a bucket is a candidate if the bits' estimate comes within ``below`` standard errors of the limit. Candidates
that lie clearly above it are links; all others are decided by the shingle sets themselves.

No pair inside a group that is linked already is made. First each text meets two texts of each of its buckets, which
connects most of a dense group; then texts meet within a bucket only across components, each pair in the first bucket it
shares, tested by a bit count inside the join. Buckets are dealt to cells by their size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import arrow_map, dealt_join, durable, sized

BANDS, ROWS, PERMUTATIONS = 16, 4, 256
PLANES = PERMUTATIONS // 64
#: Texts of a bucket that one cell holds, about.
CELL = 2048
_draw = np.random.default_rng(2)
_FACTOR = _draw.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def sketch(hashes: np.ndarray) -> tuple[list[int], list[int]]:
    """2 * PLANES signed longs (the two bit planes of the permutations' least values) and BANDS signed 32-bit numbers from
    a text's shingle hashes, repeats or not; any number of shingles."""
    mixed = hashes ^ (hashes >> np.uint64(29))
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(mixed), 256):
        part = mixed[at : at + 256, None] * _FACTOR
        part += _SHIFT
        least = np.minimum(least, part.min(axis=0))
    # The least value's own high bits are all small; a multiplication spreads it before bits or a band are taken.
    spread = least * np.uint64(0x9E3779B97F4A7C15)
    bands = spread[: BANDS * ROWS].reshape(BANDS, ROWS)
    folded = np.zeros(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        folded = (folded ^ bands[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
        folded ^= folded >> np.uint64(31)
    planes = [np.packbits((spread >> np.uint64(bit) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<i8") for bit in (62, 63)]
    return np.concatenate(planes).tolist(), (folded >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()


def differing(x: str, y: str) -> Column:
    """On how many permutations two sketches differ."""
    each = [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i))).bitwiseOR(F.get(x, F.lit(PLANES + i)).bitwiseXOR(F.get(y, F.lit(PLANES + i))))) for i in range(PLANES)]
    return sum(each[1:], each[0])


def most_differing(similarity: float, errors: float) -> int:
    """The number of differing permutations at ``errors`` standard errors above (or, negative, below) a similarity."""
    agree = similarity + (1 - similarity) / 4
    return round(PERMUTATIONS * (1 - agree) - errors * (PERMUTATIONS * agree * (1 - agree)) ** 0.5)


def links(sketches: DataFrame, sets: Callable[[DataFrame], DataFrame], components: Callable[[DataFrame], DataFrame], similarity: float, below: float = 2.7, above: float = 3.4) -> DataFrame:
    """Pairs a, b of fingerprints of texts that overlap by ``similarity`` or more, enough of them to connect each group.

    sketches: durable, one row for each distinct text with _body (its id), _fp, _sketch and _bands. sets: from ids (_body)
    to their shingle sets (_body, _set: sorted little-endian unsigned 64-bit hashes). components: from links a, b to
    _fp, _root of all fingerprints in them.
    """
    near, sure = most_differing(similarity, -below), most_differing(similarity, above)
    filed = sketches.select("_body", F.posexplode("_bands").alias("_band", "_value"))
    order = F.xxhash64("_body", "_band")
    buckets = filed.groupBy("_band", "_value").agg(F.min_by("_body", order).alias("_low"), F.max_by("_body", order).alias("_high"), F.count(F.lit(1)).alias("_n"))
    buckets = durable(buckets.filter("_low <> _high").withColumn("_cells", F.ceil(F.col("_n") / CELL).cast("int")).drop("_n"), "buckets")
    wide = sketches.select("_body", "_fp", "_sketch", "_bands", F.posexplode("_bands").alias("_band", "_value"))
    dense = durable(wide.join(sized(buckets, 500_000), ["_band", "_value"]).withColumn("_cell", F.pmod(F.xxhash64("_body", F.lit(5)), F.col("_cells")).cast("int")), "dense-buckets")
    place = ["_band", "_value", "_cell"]
    copied = lambda df: df.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))  # noqa: E731  to each cell of a bucket

    def pairs(left: DataFrame, right: DataFrame, other: Column, name: str) -> DataFrame:
        """Distinct candidates a, b with their fingerprints and _d; both sides: place, _body, _fp, _sketch, and what ``other`` names."""
        y = right.select(*place, *(F.col(c).alias(f"y{c}") for c in right.columns if c not in place))
        met = left.join(y, place).withColumn("_d", differing("_sketch", "y_sketch")).filter(other & (F.col("_fp") != F.col("y_fp")) & (F.col("_d") <= near))
        return durable(met.select(F.col("_body").alias("a"), F.col("y_body").alias("b"), F.col("_fp").alias("a_fp"), F.col("y_fp").alias("b_fp"), "_d").distinct(), name)

    def tested(candidates: DataFrame) -> DataFrame:
        """Of candidates that are not clear by their bits, those whose sets overlap enough."""
        unsure = durable(candidates.filter(F.col("_d") > sure), "unsure")
        needed = unsure.select(F.col("a").alias("_body")).union(unsure.select(F.col("b").alias("_body"))).distinct()
        held = durable(sets(needed), "shingle-sets")
        both = dealt_join(unsure, held.select(F.col("_body").alias("b"), F.col("_set").alias("_y")), "b", ["a"])
        both = both.join(held.select(F.col("_body").alias("a"), F.col("_set").alias("_x")), "a")
        return arrow_map(both.select("a_fp", "b_fp", "_x", "_y"), overlapping(similarity), "a long, b long")

    clear = lambda candidates: candidates.filter(F.col("_d") <= sure).select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b"))
    chosen = copied(dense.filter((F.col("_body") == F.col("_low")) | (F.col("_body") == F.col("_high"))))
    stars = pairs(dense, chosen, F.lit(True), "star-pairs")
    # Of the unclear ones each text tries its best here; all that matter are tried below.
    best = stars.filter(F.col("_d") > sure).groupBy("a").agg(F.min_by(F.struct("b", "a_fp", "b_fp", "_d"), F.struct("_d", "b")).alias("_b")).select("a", "_b.*")
    found = durable(clear(stars).unionByName(tested(best)).distinct(), "star-links")
    roots = durable(components(found), "star-roots")
    rooted = dense.join(sized(roots, 500_000), "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp"))
    sizes = durable(rooted.groupBy("_band", "_value", "_root").agg(F.count(F.lit(1)).alias("_n")), "bucket-roots")
    largest = sizes.groupBy("_band", "_value").agg(F.max_by("_root", F.struct("_n", "_root")).alias("_most"), F.count(F.lit(1)).alias("_roots")).filter("_roots > 1").drop("_roots")
    open_ = durable(rooted.join(sized(largest, 500_000), ["_band", "_value"]).select(*place, "_cells", "_body", "_fp", "_sketch", "_bands", "_root", "_most"), "open-buckets")
    # One side leaves out a bucket's largest component; two texts outside it meet once.
    once = (F.col("y_root") == F.col("_most")) | (F.col("_body") < F.col("y_body"))
    earlier = [(F.col("_band") > i) & (F.get("_bands", F.lit(i)) == F.get("y_bands", F.lit(i))) for i in range(BANDS - 1)]
    shared_before = earlier[0]
    for e in earlier[1:]:
        shared_before |= e
    across = pairs(open_.filter("_root <> _most"), copied(open_), (F.col("_root") != F.col("y_root")) & once & ~shared_before, "cross-pairs")
    return found.unionByName(clear(across)).unionByName(tested(across)).distinct()


def overlapping(similarity: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (a, b, set, set) whose sets overlap by ``similarity`` or more: (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), "<u8") for c in (2, 3))
                same = len(np.intersect1d(x, y, assume_unique=True))
                held.append(same >= similarity * (len(x) + len(y) - same) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(held, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    return run
