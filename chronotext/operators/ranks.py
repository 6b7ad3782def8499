"""Exact order statistics of groups of any size, by counts in cells that are refined around the wanted rank."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.session import ship, written


def at_share(share: float, last: bool = False) -> Callable[[Column], Column]:
    """The rank floor(share * n) of n values, at most n - 1 (``last``: floor(share * (n - 1)))."""
    return lambda n: (F.floor((n - 1) * share) if last else F.least(n - 1, F.floor(n * share))).cast("long")


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: dict[str, Callable[[Column], Column]], cells: int = 4096, few: int = 20_000) -> DataFrame:
    """Values at given ranks of each group's sorted values: keys, _n (values), and a column for each of ``wanted``.

    wanted: name -> rank (from 0) as a function of the number of values; no interpolation. A group's values between its
    least and its largest are counted in ``cells``, the counts combined before they move; the cell that holds the rank is
    cut anew until it holds ``few`` values or one value only, and only those are sorted. So one group may be most of the
    table, and no list of a group is made. Nulls are no values; a group of nulls alone gives no row. Null keys are a group.
    """
    given = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    own = [f"_k{i}" for i in range(len(keys))]
    values = df.select(*given, F.col(value).alias("_v")).filter("_v IS NOT NULL AND NOT isnan(CAST(_v AS DOUBLE))")
    whole = values.groupBy(*own).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).alias("rank")) for name, rank in wanted.items()])
    state = written(whole.withColumn("_total", F.col("_n")).select(*own, "_total", "_n", "_lo", "_hi", F.explode(ranks).alias("_w")).select(*own, "_total", "_n", "_lo", "_hi", "_w.name", "_w.rank"), "ranks")

    def inside(some: DataFrame) -> DataFrame:
        named = some.withColumnsRenamed({k: f"{k}_" for k in own})
        match = F.lit(True)
        for k in own:
            match &= F.col(k).eqNullSafe(F.col(f"{k}_"))
        return values.join(named, match).filter("_v >= _lo AND _v <= _hi")

    while True:
        wide = (F.col("_n") > few) & (F.col("_lo") < F.col("_hi"))
        if state.filter(wide).isEmpty():
            break
        place = F.least(F.lit(cells - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * cells)).cast("int")
        counted = inside(state.filter(wide)).groupBy(*own, "name", "rank", "_total", place.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        through = F.sum("_n").over(Window.partitionBy(*own, "name").orderBy("_cell"))
        held = counted.withColumn("_before", through - F.col("_n")).filter("rank >= _before AND rank < _before + _n").withColumn("rank", F.col("rank") - F.col("_before"))
        state = written(state.filter(~wide).unionByName(held.select(*state.columns)), "ranks")
    one = state.filter("_lo = _hi").select(*own, "_total", "name", F.col("_lo").alias("_v"))
    rest = inside(state.filter("_lo < _hi")).withColumn("_at", F.row_number().over(Window.partitionBy(*own, "name").orderBy("_v")) - 1)
    found = one.unionByName(rest.filter("_at = rank").select(*own, "_total", "name", "_v"))
    picked = [F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in wanted]
    out = found.groupBy(*own).agg(F.max("_total").alias("_n"), *picked)
    return out.withColumnsRenamed(dict(zip(own, keys, strict=True)))


def pair_counts(asked: DataFrame, prints: DataFrame, groups: int = 64, grid: int = 5_000_000, block: int = 1000) -> DataFrame:
    """Pairs of equal and of other labels by their dot product cut to a grid: cell (floor((s + 1) * grid)), pos, neg.

    asked: id, v, label; prints: id, v, label, asked (whether it asks too). A print is no pair with itself, two that ask
    are one. Prints are dealt to ``groups``, each of which meets all that ask, ``block`` by ``block``: products of matrices,
    counted before they leave, so what moves follows the prints and the grid, not the pairs. Null vectors and labels make
    no pair.
    """
    ship(prints.sparkSession)
    known = lambda d: d.filter("v IS NOT NULL AND label IS NOT NULL")
    a = known(asked).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_ga"), F.col("id").alias("_id"), F.col("v").alias("_v"), F.col("label").alias("_label")).repartition(groups, "_ga")
    b = known(prints).select(F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("_gb"), "id", "v", "label", "asked").repartition(groups, "_gb")

    def matrix(v: pa.ChunkedArray) -> np.ndarray:
        return v.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)

    def merged(cells: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(np.concatenate(cells), return_inverse=True)
        total = np.stack([np.bincount(at, weights=np.concatenate([c[k] for c in counts]), minlength=len(found)) for k in range(2)])
        return found, total.astype(np.int64)

    def fold(left: pa.Table, right: pa.Table) -> pa.Table:
        found, total = np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
        if left.num_rows and right.num_rows:
            x, y = matrix(left["_v"]), matrix(right["v"])
            i, j, k, m = (c.to_numpy() for c in (left["_id"], right["id"], left["_label"], right["label"]))
            asks = right["asked"].to_numpy()
            reach = int(np.ceil(np.sqrt((x * x).sum(1).max() * (y * y).sum(1).max()) * grid)) + 2
            dense = np.zeros((2, 2 * reach), np.uint32) if reach <= 2 * grid and len(x) * len(y) > reach // 16 else None
            for at, to in ((p, q) for p in range(0, len(x), block) for q in range(0, len(y), 2 * block)):
                rows, columns = slice(at, at + block), slice(to, to + 2 * block)
                cell = np.floor((x[rows] @ y[columns].T + 1) * grid).astype(np.int64)
                met = ~asks[columns][None, :] | (i[rows][:, None] < j[columns][None, :])
                same = k[rows][:, None] == m[columns][None, :]
                each = [cell[met & same], cell[met & ~same]]
                if dense is not None:
                    for kind, c in enumerate(each):
                        dense[kind] += np.bincount(c - grid + reach, minlength=2 * reach).astype(np.uint32)
                else:
                    parts = [np.unique(c, return_counts=True) for c in each]
                    found, total = merged([found, *(c for c, _ in parts)], [total, *(np.stack([n * (kind == 0), n * (kind == 1)]) for kind, (_, n) in enumerate(parts))])
            if dense is not None:
                held = np.flatnonzero(dense.any(0))
                found, total = held + grid - reach, dense[:, held].astype(np.int64)
        return pa.table({"cell": pa.array(found, pa.int64()), "pos": pa.array(total[0], pa.int64()), "neg": pa.array(total[1], pa.int64())})

    counted = a.groupBy("_ga").cogroup(b.groupBy("_gb")).applyInArrow(fold, "cell long, pos long, neg long")
    return counted.groupBy("cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
