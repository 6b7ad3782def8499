"""Helpers of the training-data operators: durable cuts, checked broadcasts, ranks without hot tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from chronotext.session import shared_path, ship

Batches = Iterator[pa.RecordBatch]
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from that table.

    It cuts the lineage, survives lost executors, and lets later reads take single columns.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Before Python runs on texts: the package goes to the executors, and Arrow batches are kept to 1000 rows and about
    8 MB unless the session asks for other sizes than Spark's defaults, since a row may be a long document."""
    ship(spark)
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(8 << 20))
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def spread(df: DataFrame, few: int = 8) -> DataFrame:
    """Deal the rows to all cores where the input is only a ``few`` files, which one task each would read; else ``df``.

    A table of so few files is small. Larger inputs stay as Spark splits them, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 0 < len(df.inputFiles()) < min(few, cores) else df


def tidy(step: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``step``, after which Arrow gives back what it no longer uses: a worker outlives its task, and its memory would
    stand beside that of all later steps."""

    def run(batches: Batches) -> Batches:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return run


def arrow_map(df: DataFrame, step: Callable[[Batches], Batches], schema: T.StructType | str) -> DataFrame:
    """Run ``step`` over Arrow batches; the executors have this package."""
    prepare(df.sparkSession)
    return df.mapInArrow(tidy(step), schema)


def sized(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` if it has at most ``max_rows`` rows (counted), else leave the join to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def tasks_of(spark: SparkSession) -> int:
    """How many tasks a shuffle is dealt to."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def hot_keys(df: DataFrame, key: str, least: int = 200) -> list[tuple]:
    """(value, cells) for the values of a column that hold more than a quarter of an even task's rows: at most four times
    as many as there are tasks, whatever the table's size."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    limit = max(least, df.count() // (4 * tasks_of(df.sparkSession)))
    return [(r[0], math.ceil(r[1] / limit)) for r in counts.filter(F.col(key).isNotNull() & (F.col("_n") > limit)).collect()]


def dealt_join(many: DataFrame, one: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    """Inner join on ``key``, where ``one`` has one row for each key and ``many`` may have any number.

    Rows of a frequent key are dealt to cells by a hash of ``spread_by``, and the key's row of ``one`` is copied to each.
    ``many`` must be cheap to read twice (a durable table).
    """
    found = hot_keys(many, key)
    if not found:
        return many.join(one, key)
    hot = F.broadcast(many.sparkSession.createDataFrame(found, T.StructType([T.StructField("_hot", many.schema[key].dataType), T.StructField("_cells", T.IntegerType())])))
    cells = F.coalesce("_cells", F.lit(1))
    left = many.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_cell", F.pmod(F.xxhash64(*spread_by), cells).cast("int")).drop("_hot", "_cells")
    right = one.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_cell", F.explode(F.sequence(F.lit(0), cells - 1))).drop("_hot", "_cells")
    return left.join(right, [key, "_cell"]).drop("_cell")


def rank_in_groups(df: DataFrame, group: list[str], spread: Column, order: list[str], rank: str) -> DataFrame:
    """Add ``rank``: 0, 1, 2, ... without gaps inside each group, in no promised order.

    A group may hold most of the rows, so it is numbered in cells: rows are dealt to cells by a hash of ``spread``,
    numbered inside their cell, and moved up by what the group's earlier cells hold. ``df`` must be cheap to read
    twice (a durable table). Rows of a group that are equal in ``spread`` share a cell.
    """
    spark = df.sparkSession
    n = 4 * tasks_of(spark)
    cells = df.withColumn("_cell", F.pmod(F.xxhash64(spread, F.lit(17)), F.lit(n)).cast("int"))
    counts = cells.groupBy(*group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        F.col("_cell").alias("_c"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    inside = Window.partitionBy(*group, "_cell").orderBy(*order)
    numbered = cells.withColumn("_row", F.row_number().over(inside) - 1)
    match = F.col("_cell") == F.col("_c")
    for i, g in enumerate(group):
        match &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return numbered.join(starts, match).withColumn(rank, (F.col("_start") + F.col("_row")).cast("long")).select(*df.columns, rank)


def share_of(column: Column, bound: int, rows: int) -> Column:
    """A filter that keeps about ``bound`` of ``rows`` rows, chosen by a hash of ``column`` alone."""
    if rows <= bound:
        return F.lit(True)
    return F.pmod(F.xxhash64(column, F.lit(23)), F.lit(1 << 30)) < math.ceil(bound / rows * (1 << 30))


def text_slices(texts: list[str | None], limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of a batch that hold about ``limit`` characters, so that memory follows that and the longest text."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= limit:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
