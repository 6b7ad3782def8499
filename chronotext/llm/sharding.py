"""Sharding into near-equal bytes by histogram sort.

Rows have a sort key of two 64-bit hashes: of the text, then of the document's key. Probes cut the key space into even
cells; one aggregation counts the exact bytes in the cells that still hold a wanted splitter; such cells are cut finer
until a cell boundary lies close enough to the wanted byte. Only then does each row go, once, to its shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.llm.common import durable, rank_in_groups, tasks_of

LOW, HIGH = -(1 << 63), (1 << 63) - 1
#: Bits of the key that one round resolves: at most 2**10 counts come back for each splitter that is still sought.
STEP = 10


@dataclass(frozen=True)
class Cell:
    """Keys that share their first ``bits`` bits; ``text`` is set once the first hash is fixed and the second is cut."""

    text: int | None
    prefix: int
    bits: int
    before: int  # bytes below the cell

    def children_bits(self) -> int:
        return min(64, self.bits + STEP)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key),
        (F.octet_length(body) + 16).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("_text"),
        F.xxhash64(F.col(key)).alias("_key"),
    )


def prefix(column: str, bits: int) -> Column:
    return F.shiftright(F.col(column), 64 - bits) if bits else F.lit(0).cast("long")


def splitters(rows: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """``shards - 1`` keys (text hash, key hash) in order; shard i holds the keys from splitter i to before i + 1."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    wanted = [total * i / shards for i in range(1, shards)]
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    open_cells: dict[Cell, list[int]] = {Cell(None, 0, 0, 0): list(range(len(wanted)))} if total else {}
    while open_cells:
        by_level: dict[tuple[bool, int], list[Cell]] = {}
        for cell in open_cells:
            by_level.setdefault((cell.text is None, cell.bits), []).append(cell)
        following: dict[Cell, list[int]] = {}
        for (on_text, bits), cells in by_level.items():
            column, finer = ("_text" if on_text else "_key"), cells[0].children_bits()
            if on_text:
                inside = prefix("_text", bits).isin([c.prefix for c in cells])
                outer = F.lit(0).cast("long")
            else:
                inside = F.lit(False)
                for c in cells:
                    inside |= (F.col("_text") == c.text) & (prefix("_key", bits) == c.prefix)
                outer = F.col("_text")
            counted = (
                rows.filter(inside)
                .groupBy(outer.alias("o"), prefix(column, finer).alias("p"))
                .agg(F.sum("size").alias("bytes"), F.min("_text").alias("t0"), F.max("_text").alias("t1"), F.min("_key").alias("k0"), F.max("_key").alias("k1"))
                .collect()
            )
            for cell in cells:
                up = finer - cell.bits
                mine = sorted(r for r in counted if (on_text or r["o"] == cell.text) and (r["p"] >> up if cell.bits else 0) == cell.prefix) if cell.bits or not on_text else sorted(counted)
                mine.sort(key=lambda r: r["p"])
                for target in open_cells[cell]:
                    low = cell.before
                    for r in mine:
                        if low + r["bytes"] >= wanted[target]:
                            break
                        low += r["bytes"]
                    high, at = low + r["bytes"], r["p"] << (64 - finer)
                    below = wanted[target] - low <= high - wanted[target]
                    near = min(wanted[target] - low, high - wanted[target])
                    one_text, one_key = r["t0"] == r["t1"], r["k0"] == r["k1"]
                    if near <= slack or (one_text and one_key):
                        edge = at if below else at + (1 << (64 - finer))
                        found[target] = (edge, LOW) if on_text else (cell.text, edge) if edge <= HIGH else (cell.text + 1, LOW)
                    elif one_text and on_text:
                        following.setdefault(Cell(r["t0"], 0, 0, low), []).append(target)
                    else:
                        following.setdefault(Cell(cell.text, r["p"], finer, low), []).append(target)
        open_cells = following
    return [found[i] for i in sorted(found)]


def shard_of(cuts: list[tuple[int, int]]) -> Column:
    """How many splitters are at or below a row's key: a balanced tree of comparisons."""

    def at_or_above(cut: tuple[int, int]) -> Column:
        text, key = cut
        if text > HIGH:
            return F.lit(False)
        return (F.col("_text") > text) | ((F.col("_text") == text) & (F.col("_key") >= key))

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(at_or_above(cuts[middle]), tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(cuts)).cast("int")


def assign_shards(docs: DataFrame, shards: int = 40, tolerance: float = 0.005, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, size, text_crc32, law (``bytes``), shard, slot, grown_shard (null under this law).

    Sizes (UTF-8 bytes of the text plus 16) are near equal between shards: each splitter misses its byte by at most
    ``tolerance`` of a shard or, where documents are larger than that, by half of the one document that lies across it.
    Documents of equal text are neighbours in the order and stay in one shard wherever the tolerance lets a cut go
    round them. Null text counts as empty. Rows equal in text and key stay together; null keys are keys like any other.
    With fewer rows than shards some shards are empty; an empty table gives no rows. Other columns are not read.
    """
    rows = durable(keyed(docs, key, text), "shard-keys")
    placed = rows.withColumn("shard", shard_of(splitters(rows, shards, tolerance)))
    ranked = rank_in_groups(placed, ["shard"], F.struct("_text", "_key"), ["_text", "_key"], "slot")
    return ranked.select(key, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 40, tolerance: float = 0.005, key: str = "doc_id", text: str = "text") -> None:
    """Write whole documents in one folder per shard, with one exchange that spreads each shard over many tasks."""
    cuts = splitters(durable(keyed(docs, key, text), "shard-keys"), shards, tolerance)
    named = docs.withColumns({"_text": F.xxhash64(F.coalesce(F.col(text), F.lit(""))), "_key": F.xxhash64(F.col(key))})
    spread = named.withColumns({"shard": shard_of(cuts), "_cell": F.pmod(F.col("_key"), F.lit(max(1, tasks_of(docs.sparkSession) // shards)))})
    spread.repartition("shard", "_cell").drop("_text", "_key", "_cell").write.partitionBy("shard").parquet(path)
