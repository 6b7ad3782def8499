"""Merkle manifest of a dataset: a tree for each group of rows, a tree over the groups' roots, and a proof for each row.

A partition holds a fragment of the forest: unresolved nodes keyed by level and index. Fragments form a monoid: they
merge by union, and whenever all siblings of a run are there (its arity follows from the group's row count), the run
becomes its parent. A tree of merges, sixty-four fragments at a time, leaves one node of each group; the same fold
over those gives the dataset's root. Proofs go back down the same tree: a fragment's nodes hand their path to what they
were made of. No merge sees more than a few unresolved nodes a level of each fragment, so neither the driver nor a task
ever holds a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.llm.common import durable, prepare

#: A place is its partition times 2**33 plus its row there. The first fragments are 2**14 places, the next whole
#: partitions, then 2**FAN partitions, and so on.
ROW_BITS, LEAF_BITS, FAN = 33, 14, 6
NODES = "frag long, gid long, total long, level int, idx long, digest string, done boolean"
PATHS = "frag long, gid long, level int, idx long, path string, subroot string, root string"

#: (left siblings, right siblings, the parent's), ending in the path of a node of the merged fragment.
Linked = tuple[str, str, "Linked"] | str
Nodes = dict[int, dict[int, dict[int, str]]]  # level -> group -> index -> digest
Made = dict[tuple[int, int, int], list[str]]  # (level, group, index) of a parent -> its children's digests


def leaf(*columns: str | Column) -> Column:
    """Digest of a row: each field as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    parts = []
    for c in columns:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def siblings_digest(proof: str | Column) -> Column:
    """Digest of all siblings of a proof, from the leaf's level up, left to right."""
    return F.sha2(F.translate(proof, ".;", "").cast("binary"), 256)


def folded(digest: str | Column, proof: str | Column) -> Column:
    """The root that a leaf digest gives with the siblings of ``proof``: the leaf is unchanged if it is the root."""
    steps = F.filter(F.split(proof, ";"), lambda s: s != "")

    def up(d: Column, step: Column) -> Column:
        return F.sha2(F.concat(F.substring_index(step, ".", 1), d, F.substring_index(step, ".", -1)).cast("binary"), 256)

    return F.aggregate(steps, F.col(digest) if isinstance(digest, str) else digest, up)


def joined(digests: Iterable[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def width(total: int, level: int, arity: int) -> int:
    """How many nodes a group of ``total`` leaves has at a level."""
    for _ in range(level):
        total = -(-total // arity)
    return total


def resolve(nodes: Nodes, totals: dict[int, int], arity: int) -> Made:
    """Turn complete runs of ``nodes`` into their parents, level by level; the runs that were made, lower levels first."""
    made: Made = {}
    level = 0
    while level <= max(nodes, default=-1):
        for gid, held in nodes.get(level, {}).items():
            count = width(totals[gid], level, arity)
            if count == 1:
                continue
            for run in sorted({i // arity for i in held}):
                members = range(run * arity, min((run + 1) * arity, count))
                if all(i in held for i in members):
                    digests = [held.pop(i) for i in members]
                    made[level + 1, gid, run] = digests
                    nodes.setdefault(level + 1, {}).setdefault(gid, {})[run] = joined(digests)
        level += 1
    return made


def linked_paths(made: Made, known: dict[tuple[int, int, int], str], arity: int) -> dict[tuple[int, int, int], Linked]:
    """Paths of all nodes below the nodes whose paths are ``known``."""
    paths: dict[tuple[int, int, int], Linked] = dict(known)
    for (level, gid, run), digests in reversed(made.items()):
        above = paths[level, gid, run]
        for j in range(len(digests)):
            paths[level - 1, gid, run * arity + j] = ("".join(digests[:j]), "".join(digests[j + 1 :]), above)
    return paths


def spelled(path: Linked) -> str:
    """``left.right`` of each level, ``;`` between; the terminal path is that already."""
    steps = []
    while not isinstance(path, str):
        steps.append(f"{path[0]}.{path[1]}")
        path = path[2]
    return ";".join([*steps, path] if path else steps)


def held_leaves(rows: pa.Table, slices: pa.Table) -> tuple[Nodes, dict[int, int], list[tuple[int, int]]]:
    """Leaves of a fragment as nodes of level 0, the groups' totals, and (group, index) of each row of ``rows``."""
    order = np.argsort(rows["at"].to_numpy(), kind="stable")
    digests = rows["leaf"].to_pylist()
    place: list[tuple[int, int]] = [(0, 0)] * len(order)
    nodes: Nodes = {0: {}}
    totals: dict[int, int] = {}
    begin = 0
    for s in sorted(slices.to_pylist(), key=lambda s: s["first"]):
        held = nodes[0].setdefault(s["gid"], {})
        totals[s["gid"]] = s["total"]
        for i, row in enumerate(order[begin : begin + s["n"]].tolist()):
            held[s["start"] + i] = digests[row]
            place[row] = (s["gid"], s["start"] + i)
        begin += s["n"]
    return nodes, totals, place


def held_nodes(table: pa.Table) -> tuple[Nodes, dict[int, int]]:
    nodes: Nodes = {}
    totals: dict[int, int] = {}
    for r in table.to_pylist():
        nodes.setdefault(r["level"], {}).setdefault(r["gid"], {})[r["idx"]] = r["digest"]
        totals[r["gid"]] = r["total"]
    return nodes, totals


def node_rows(frag: int, nodes: Nodes, totals: dict[int, int], arity: int) -> pa.Table:
    rows = [
        (frag, gid, totals[gid], level, i, digest, width(totals[gid], level, arity) == 1)
        for level, groups in nodes.items()
        for gid, held in groups.items()
        for i, digest in held.items()
    ]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in NODES.split(", ")])


def known_paths(paths: pa.Table) -> tuple[dict[tuple[int, int, int], str], dict[int, tuple[str, str]]]:
    rows = paths.to_pylist()
    return {(r["level"], r["gid"], r["idx"]): r["path"] for r in rows}, {r["gid"]: (r["subroot"], r["root"]) for r in rows}


def placed(leaves: DataFrame, group: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in group and order with their place ``at``, and the slices of groups in fragments.

    Slices: frag, first (place), n, gid (the place of the group's first row, so groups sort by it), start (rank of the
    slice's first row in its group), total (rows of the group). Rows equal in all columns are dealt apart by their place
    in the input: a repeated row may be a third of the table.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*group, *order, "leaf"]]
    tied = durable(leaves, "merkle-digests").withColumn("_tie", F.monotonically_increasing_id())
    rows = tied.repartitionByRange(*keys, F.col("_tie").asc()).sortWithinPartitions(*keys).drop("_tie")
    rows = durable(rows.withColumn("at", F.monotonically_increasing_id()).withColumn("frag", F.shiftright("at", LEAF_BITS)), "merkle-leaves")
    slices = rows.groupBy(*group, "frag").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    mine = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    before = mine.orderBy("frag").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("frag", "first", "n", F.min("first").over(mine).alias("gid"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(mine).alias("total"))
    return rows, durable(slices, "merkle-slices")


class Forest:
    """The folded trees of ``leaves`` (a column ``leaf`` besides group and order columns), one for each group."""

    def __init__(self, leaves: DataFrame, group: list[str], order: list[str], arity: int) -> None:
        prepare(leaves.sparkSession)
        self.arity = arity
        self.rows, self.slices = placed(leaves, group, order)
        last = self.rows.agg(F.max("at")).first()[0] or 0
        self.shifts = [LEAF_BITS, ROW_BITS]
        while last >> self.shifts[-1]:
            self.shifts.append(self.shifts[-1] + FAN)

        def first(key: tuple, rows: pa.Table, slices: pa.Table) -> pa.Table:
            nodes, totals, _ = held_leaves(rows, slices)
            resolve(nodes, totals, arity)
            return node_rows(key[0].as_py(), nodes, totals, arity)

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            nodes, totals = held_nodes(table)
            resolve(nodes, totals, arity)
            return node_rows(key[0].as_py(), nodes, totals, arity)

        left, right = self.rows.select("frag", "at", "leaf").groupBy("frag"), self.slices.groupBy("frag")
        self.rounds = [durable(left.cogroup(right).applyInArrow(first, NODES), "merkle-nodes")]
        for i in range(1, len(self.shifts)):
            self.rounds.append(durable(self.merging(i).groupBy("frag").applyInArrow(merge, NODES), "merkle-nodes"))

    def merging(self, i: int) -> DataFrame:
        """Unresolved nodes before round i, by the fragment they merge into; ``was`` is the one they come from."""
        step = self.shifts[i] - self.shifts[i - 1]
        return self.rounds[i - 1].filter(~F.col("done")).withColumn("was", F.col("frag")).withColumn("frag", F.shiftright("frag", step))

    def roots(self) -> DataFrame:
        """One row a group: gid, total, digest."""
        found = self.rounds[0]
        for more in self.rounds[1:]:
            found = found.unionByName(more)
        return found.filter("done").select("gid", "total", "digest")

    def proven(self, above: DataFrame | None, row: Callable[[str, str, str], tuple], columns: list[str], added: str) -> DataFrame:
        """``columns`` of each row and what ``row`` makes of its proof, its group's root and the top root.

        above: gid, path, root of the trees' own roots, None if they are the top.
        """
        arity = self.arity

        def own(nodes: DataFrame) -> DataFrame:
            tops = nodes.filter("done").select("frag", "gid", "level", "idx", F.col("digest").alias("subroot"))
            tops = tops.join(above, "gid") if above is not None else tops.withColumns({"path": F.lit(""), "root": F.col("subroot")})
            return tops.select("frag", "gid", "level", "idx", "path", "subroot", "root")

        def down(key: tuple, nodes: pa.Table, paths: pa.Table) -> pa.Table:
            held, totals = held_nodes(nodes)
            made = resolve(held, totals, arity)
            known, roots = known_paths(paths)
            found = linked_paths(made, known, arity)
            rows = [(r["was"], r["gid"], r["level"], r["idx"], spelled(found[r["level"], r["gid"], r["idx"]]), *roots[r["gid"]]) for r in nodes.to_pylist()]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.table([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names=[c.split()[0] for c in PATHS.split(", ")])

        paths = own(self.rounds[-1])
        for i in range(len(self.rounds) - 1, 0, -1):
            lower = self.merging(i).groupBy("frag").cogroup(paths.groupBy("frag")).applyInArrow(down, PATHS)
            paths = lower.unionByName(own(self.rounds[i - 1]))
        hand = durable(paths, "merkle-paths")

        def last(key: tuple, both: pa.Table, paths: pa.Table) -> pa.Table:
            rows, slices = both.filter(pc.is_valid(both["at"])), both.filter(pc.is_null(both["at"]))
            nodes, totals, place = held_leaves(rows, slices)
            made = resolve(nodes, totals, arity)
            known, roots = known_paths(paths)
            found = linked_paths(made, known, arity)
            out = [row(spelled(found[0, gid, i]), *roots[gid]) for gid, i in place]
            return pa.table([rows[c] for c in columns] + [pa.array(c, pa.string()) for c in (zip(*out, strict=True) if out else [()] * len(added.split(", ")))], names=[*columns, *(c.split()[0] for c in added.split(", "))])

        both = self.rows.select(*columns, "frag", "at", *[c for c in ["leaf"] if c not in columns]).unionByName(self.slices, allowMissingColumns=True)
        schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in self.rows.select(*columns).schema), added])
        return both.groupBy("frag").cogroup(hand.groupBy("frag")).applyInArrow(last, schema)


def manifest(rows: DataFrame, fields: list[str | Column], group: str, order: str, keep: list[str] | None = None, arity: int = 3) -> DataFrame:
    """Per row: ``order``, the columns of ``keep``, leaf, subroot, root, proof.

    fields: what a leaf's digest covers. Leaves of a group ascend by ``order`` (null first, ties by digest); runs of
    ``arity`` become their digest until one node is left, the group's subroot; subroots ascend by group (null first,
    UTF-8 bytewise) and give the root in the same way. proof: the siblings of each level, ``left.right`` with ``;``
    between levels, for ``folded`` and ``siblings_digest``; an empty text for a table of one row. Repeated rows are
    leaves each. An empty table gives no rows. Other columns, names that clash with ours included, are not read.
    """
    keep = keep or []
    leaves = rows.select(F.col(order).alias("_order"), F.col(group).alias("_group"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], leaf(*fields).alias("leaf"))
    trees = Forest(leaves, ["_group"], ["_order"], arity)
    tops = Forest(trees.roots().select("gid", F.col("digest").alias("leaf")), [], ["gid"], arity)
    above = durable(tops.proven(None, lambda proof, subroot, root: (proof, root), ["gid"], "path string, root string"), "merkle-tops")
    columns = ["_order", *(f"_keep{i}" for i in range(len(keep))), "leaf"]
    proven = trees.proven(above, lambda proof, subroot, root: (subroot, root, proof), columns, "subroot string, root string, proof string")
    return proven.withColumnsRenamed({"_order": order, **{f"_keep{i}": c for i, c in enumerate(keep)}})


def subroots(rows: DataFrame, fields: list[str | Column], group: str, order: str, arity: int = 3) -> DataFrame:
    """One row a group, without proofs: group, total (rows), subroot. Two tables are equal where these are."""
    leaves = rows.select(F.col(order).alias("_order"), F.col(group).alias("_group"), leaf(*fields).alias("leaf"))
    trees = Forest(leaves, ["_group"], ["_order"], arity)
    named = trees.rows.join(trees.roots(), F.col("at") == F.col("gid"))
    return named.select(F.col("_group").alias(group), "total", F.col("digest").alias("subroot"))
