"""SimHash near-duplicates by the generalised pigeonhole principle.

64-bit fingerprints link at ``distance`` or fewer differing bits. The bits are cut into parts, correlated bits together,
and each part gets its own threshold t_i (-1: unused) with sum(t_i + 1) = distance + 1; two linked fingerprints are then
within t_i in some part i. Parts and thresholds come from a dynamic program over estimated candidate counts. Every
distinct fingerprint is filed under its value in each used part and probes all values within t_i of its own.

Dense groups are settled without their pairs. First each probe meets only the smallest fingerprint filed under its
value; these links, at most one a probe, are contracted to components. Then fingerprints meet across components alone:
under each value one side leaves out the component that has most fingerprints there, and a pair has a link tested by a
bit count inside the join. What is linked is exactly what all pairs would link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.llm import resemblance
from chronotext.llm.common import arrow_map, dealt_join, durable, sized, spread

BITS = 64
#: Cost of a probe row, and of a candidate that is tested, in the planner's units.
PROBE, TEST = 1.0, 0.1
#: Fingerprints of one part's value that one cell holds, about.
CELL = 4096


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of the word shingles of a text, repeats included: words between ASCII white space, A-Z lower-cased."""
    body = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not body:
        return np.zeros(0, dtype="<u8")
    if len(body) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(body), 42)]
    else:
        line = b" ".join(body)
        ends = np.cumsum([len(w) + 1 for w in body]) - 1
        starts = np.r_[0, ends[:-1] + 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], 42) for a, b in zip(starts[: len(body) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return np.array(hashes, dtype="<u8")


def majority(packed: np.ndarray) -> int:
    """A fingerprint bit is set if it is in over half the hashes; zero without any."""
    total = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(packed), 1 << 16):
        part = packed[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(packed), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 4) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id", text: str = "text", sketches: bool = False) -> DataFrame:
    """key, _fp (the 64 bits as a signed long), _body (xxhash64 of the text); with ``sketches`` also _sketch and _bands
    (see resemblance.sketch). No shuffle, whole texts."""
    source = spread(docs.select(key, text)).select(F.col(key), F.col(text), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_body"))
    more = [T.StructField("_sketch", T.ArrayType(T.LongType())), T.StructField("_bands", T.ArrayType(T.IntegerType()))] if sketches else []
    schema = T.StructType([source.schema[0], T.StructField("_fp", T.LongType()), T.StructField("_body", T.LongType()), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            prints, drawn, bands = [], [], []
            for text in texts:
                hashes = shingle_hashes(text, shingle)
                prints.append(majority(hashes))
                if sketches:
                    one, values = resemblance.sketch(hashes)
                    drawn.append(one)
                    bands.append(values)
            extra = [pa.array(drawn, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int32()))] if sketches else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), batch.column(2), *extra], names=schema.names)

    return arrow_map(source, run, schema)


def shingle_sets(docs: DataFrame, bodies: DataFrame, shingle: int, text: str = "text") -> DataFrame:
    """_body, _set of the texts whose hash is in ``bodies``: the sorted distinct shingle hashes as bytes. Reads the texts."""
    keyed = docs.select(F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_body"), F.col(text).alias("_text"))
    some = keyed.join(sized(bodies, 500_000), "_body", "left_semi").dropDuplicates(["_body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["_body", "_set"])

    return arrow_map(some, run, "_body long, _set binary")


def bit_statistics(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and how often each two bits are both set: 64 x 64 counts over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS))
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(x)
            for i in range(0, len(x), 1 << 16):
                both += x[i : i + (1 << 16)].T @ x[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS + 1), pa.int32()), pa.array([*both.tolist(), [float(n)] * BITS])], names=["row", "counts"])

    each = arrow_map(prints.select("_fp"), run, "row int, counts array<double>")
    summed = each.select("row", F.posexplode("counts").alias("at", "n")).groupBy("row", "at").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((BITS + 1, BITS))
    for r in summed:
        table[r["row"], r["at"]] = r["n"]
    return int(table[BITS, 0]), table[:BITS]


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Cut the bits into ``parts`` near-equal parts; each starts at the freest bit and takes those most correlated to it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    correlation = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        part = [max(free, key=lambda b: spread[b])]
        while len(part) < size:
            part.append(max((b for b in free if b not in part), key=lambda b: correlation[b, part].mean()))
        free = [b for b in free if b not in part]
        out.append(sorted(part))
    return out


def within(n: int, both: np.ndarray, part: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most 0, 1, ... ``most`` bits of a part.

    Two fingerprints differ in bit b with chance 2 p (1 - p). Correlated bits count less: the part is taken to be as
    wide as its correlation matrix says (the participation ratio of its eigenvalues).
    """
    p = np.diag(both)[part] / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    values = np.linalg.eigvalsh((both[np.ix_(part, part)] / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    width = max(1, round(float(values.sum() ** 2 / max((values**2).sum(), 1e-9))))
    differ = float(np.mean(2 * p * (1 - p)))
    return np.cumsum([math.comb(width, d) * differ**d * (1 - differ) ** (width - d) for d in range(most + 1)]).tolist()


def ball(width: int, most: int) -> int:
    return sum(math.comb(width, d) for d in range(most + 1))


def plan(n: int, both: np.ndarray, distance: int, most: int = 2) -> list[tuple[list[int], int]]:
    """Parts and thresholds of least estimated cost. For each number of parts a dynamic program deals out the
    ``distance + 1`` units of sum(t_i + 1); a part's cost is its probes and its estimated candidates."""
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(2, distance + 2):
        parts = correlated_parts(n, both, m)
        costs: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for part in parts:
            share = within(n, both, part, most)
            following: dict[int, tuple[float, list[int]]] = {}
            for units, (cost, chosen) in costs.items():
                for t in range(-1, most + 1):
                    if units + t + 1 > distance + 1:
                        break
                    more = cost + (0 if t < 0 else PROBE * n * ball(len(part), t) + TEST * n * n * share[t])
                    if more < following.get(units + t + 1, (math.inf, []))[0]:
                        following[units + t + 1] = (more, [*chosen, t])
            costs = following
        if distance + 1 in costs and costs[distance + 1][0] < best[0]:
            best = (costs[distance + 1][0], [(p, t) for p, t in zip(parts, costs[distance + 1][1], strict=True) if t >= 0])
    return best[1]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def filed(prints: DataFrame, planned: list[tuple[list[int], int]]) -> DataFrame:
    """A row for each fingerprint and used part: _part and _value, the fingerprint's bits in that part."""
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(signed(sum(1 << b for b in part))).cast("long").alias("m")) for i, (part, _) in enumerate(planned)])
    rows = prints.withColumn("_mask", F.explode(masks))
    return rows.select(*prints.columns, F.col("_mask.i").alias("_part"), F.col("_fp").bitwiseAND(F.col("_mask.m")).alias("_value"))


def probes(prints: DataFrame, planned: list[tuple[list[int], int]]) -> DataFrame:
    """A row for each fingerprint, used part and value within the part's threshold of its own."""
    out = None
    for i, (part, most) in enumerate(planned):
        mask = signed(sum(1 << b for b in part))
        flips = [signed(sum(1 << b for b in some)) for d in range(most + 1) for some in combinations(part, d)]
        flip = F.explode(F.array(*[F.lit(f).cast("long") for f in flips])) if len(flips) > 1 else F.lit(0).cast("long")
        rows = prints.withColumn("_flip", flip).select(*prints.columns, F.lit(i).alias("_part"), F.col("_fp").bitwiseAND(F.lit(mask).cast("long")).bitwiseXOR(F.col("_flip")).alias("_value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root: the smallest node that each node reaches. nodes: node; edges: a, b. Ends in O(log n) rounds as a rule.

    Each round links a node to the smallest neighbour of its root (hooking) and then halves the paths; every round is a
    durable table, and only the count of what changed comes to the driver.
    """
    links = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    touched = links.select(F.col("a").alias("node")).union(links.select(F.col("b").alias("node"))).distinct()
    root = durable(touched.withColumn("root", F.col("node")), "roots")
    while not links.isEmpty():
        # Links between roots; the larger root of each hooks to its smallest neighbour.
        hook = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        hook = durable(hook, "hooks")
        # Follow hooks to their end: they always go to smaller nodes, so there are no circles.
        while True:
            step = hook.alias("x").join(hook.alias("y"), F.col("x.to") == F.col("y.node"), "left")
            step = durable(step.select(F.col("x.node").alias("node"), F.coalesce("y.to", "x.to").alias("to"), F.col("y.to").isNotNull().alias("moved")), "hooks")
            hook = step.select("node", "to")
            if step.filter("moved").isEmpty():
                break
        moved = hook.withColumnRenamed("node", "root")
        root = durable(root.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        left = links.join(hook.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a", "left").join(hook.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b", "left")
        left = left.select(F.coalesce("a2", "a").alias("x"), F.coalesce("b2", "b").alias("y"))
        links = durable(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a <> b").distinct(), "links")
    return nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def linked_prints(prints: DataFrame, distance: int = 4, more: DataFrame | None = None) -> DataFrame:
    """_fp, _root: distinct fingerprints and the smallest (as a signed long) one of their component. ``prints``: durable;
    ``more``: links a, b of fingerprints that count whatever their distance."""
    n, both = bit_statistics(prints)
    nodes = prints.select(F.col("_fp").alias("node"))
    planned = plan(n, both, distance)
    shelf = filed(prints.select("_fp"), planned)
    centres = shelf.groupBy("_part", "_value").agg(F.min("_fp").alias("_centre"), F.count(F.lit(1)).alias("_n"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    stars = (
        probes(prints.select("_fp"), planned)
        .join(centres, ["_part", "_value"])
        .filter((F.col("_fp") != F.col("_centre")) & near("_fp", "_centre"))
        .select(F.col("_fp").alias("a"), F.col("_centre").alias("b"))
    )
    stars = stars.unionByName(more) if more is not None else stars
    rooted = durable(components(nodes, stars).select(F.col("node").alias("_fp"), F.col("root").alias("_root")), "star-roots")
    # Across components: under each value, the component with most fingerprints need not meet itself.
    by_root = filed(rooted, planned).groupBy("_part", "_value", "_root").agg(F.count(F.lit(1)).alias("_n"))
    largest = by_root.groupBy("_part", "_value").agg(F.max(F.struct("_n", "_root")).alias("_top"), F.ceil(F.sum("_n") / CELL).cast("int").alias("_cells")).select("_part", "_value", F.col("_top._root").alias("_most"), "_cells")
    largest = durable(largest, "largest-roots")
    # A value that many fingerprints share is dealt to cells: those filed go to one each, those that ask to all.
    place = ["_part", "_value", "_cell"]
    shelf = filed(rooted, planned).join(largest, ["_part", "_value"]).withColumn("_cell", F.pmod(F.xxhash64("_fp", F.lit(5)), F.col("_cells")).cast("int"))
    asked = probes(rooted, planned).join(largest, ["_part", "_value"]).withColumn("_cell", F.explode(F.sequence(F.lit(0), F.col("_cells") - 1)))
    asked = asked.select(F.col("_fp").alias("_other"), F.col("_root").alias("_other_root"), *place, F.col("_most").alias("_other_most"))
    differ = (F.col("_root") != F.col("_other_root")) & near("_fp", "_other")
    some = shelf.filter("_root <> _most").join(asked, place).filter(differ)
    more = shelf.filter("_root = _most").join(asked.filter("_other_root <> _other_most"), place).filter(differ)
    pairs = some.select(F.col("_root").alias("a"), F.col("_other_root").alias("b")).unionByName(more.select(F.col("_root").alias("a"), F.col("_other_root").alias("b")))
    roots = rooted.select(F.col("_root").alias("node")).distinct()
    above = components(roots, pairs)
    above = above.select(F.col("node").alias("_root"), "root")
    return dealt_join(rooted, above, "_root", ["_fp"]).select("_fp", F.col("root").alias("_root"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """Per row of ``docs``: key, fingerprint (16 hexadecimal digits), component_id, _body, _kept_body.

    component_id is the smallest key that is reachable over links of ``distance`` or fewer differing bits, the row's own
    key included. With ``similarity``, texts whose shingle sets overlap by that share are linked
    too (see resemblance). Null and blank texts have fingerprint zero, which links like any other; null keys are never smallest
    unless a component has no other (then component_id is null). Repeated rows are each returned; an empty table gives
    no rows; other columns are not read. _body is a hash of the text, _kept_body that of the component's first row (by
    key, then body), which a filter keeps.
    """
    rows = durable(fingerprints(docs, shingle, key, text, similarity is not None), "fingerprints")
    first_row = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col("_body"))).alias("_first")
    prints = durable(rows.groupBy("_fp").agg(first_row), "prints")
    more = None
    if similarity is not None:
        drawn = durable(rows.filter("_fp <> 0").drop(key).dropDuplicates(["_body"]), "sketches")
        nodes = lambda found: found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
        joined = lambda found: components(nodes(found), found).select(F.col("node").alias("_fp"), F.col("root").alias("_root"))
        more = resemblance.links(drawn, lambda bodies: shingle_sets(docs, bodies, shingle, text), joined, similarity)
    rooted = durable(linked_prints(prints, distance, more), "print-roots")
    first = rooted.join(prints, "_fp").groupBy("_root").agg(F.min("_first").alias("_first"))
    named = dealt_join(rooted, durable(first, "component-firsts"), "_root", ["_fp"])
    named = durable(named.select("_fp", F.col("_first.id").alias("component_id"), F.col("_first._body").alias("_kept_body")), "named-prints")
    found = dealt_join(rows.select(key, "_fp", "_body"), named, "_fp", [key, "_body"])
    return found.select(key, F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id", "_body", "_kept_body")


def keep_one(docs: DataFrame, distance: int = 4, shingle: int = 4, key: str = "doc_id", text: str = "text", similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near-duplicates, that with the smallest key; columns as they are.

    Rows equal in key and text count once; rows with a null key stay only where their group has no other; null and blank
    texts are one group; an empty table stays empty.
    """
    found = near_duplicates(docs, distance, shingle, key, text, similarity)
    stays = F.col(key).eqNullSafe(F.col("component_id")) & (F.col("_body") == F.col("_kept_body"))
    names = [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), F.col("_body").alias("_b")]
    told = found.groupBy(*names).agg(F.min(stays).alias("_stays"), F.count(F.lit(1)).alias("_n")).filter("NOT _stays OR _n > 1")
    told = durable(told, "near-duplicates")  # the rows that go, and those that stay but repeat
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_b"))
    kept = named.join(sized(told.select("_k", "_b"), 500_000), ["_k", "_b"], "left_anti")
    repeated = told.filter("_stays").select("_k", "_b")
    if not repeated.isEmpty():
        kept = kept.unionByName(named.join(sized(repeated, 500_000), ["_k", "_b"], "left_semi").dropDuplicates(["_k", "_b"]))
    return kept.select("_row.*")
