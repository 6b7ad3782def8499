"""URL filters: allow and block rules on host suffixes and path prefixes, by a sort-merge range join.

A host is written label by label from its end (``com.example.www.``), so a host and its subdomains share a prefix. A url
is looked up once at each depth that rules have: its key at depth d is its last d labels, then its path. At one depth a
rule is the interval of all keys that begin with it, and such intervals nest. Urls and the intervals' ends are sorted
together; each end carries the innermost rule that holds from there on, the top of the stack of rules that are open
there, and a url takes what the last end before it carries. No pair of a url and a rule that does not fit is ever made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.llm.common import durable, sized, tasks_of

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A host name has at most 127 labels; rules of more are refused.
MAX_LABELS = 127
#: No UTF-8 text holds this byte, and it sorts after all that do occur.
END = b"\xff"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def labels(host: Column) -> Column:
    """Labels from the last to the first; none of an empty host."""
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.reverse(F.split(host, r"\.")))


def block(parts: Column, depth: Column) -> Column:
    return F.concat(F.array_join(F.slice(parts, F.lit(1), depth), "."), F.lit("."))


def intervals(rules: DataFrame) -> DataFrame:
    """Ends of the rules' intervals: _block, _at, _last, _rule, _action; what holds from that place in a block on.

    Inside a block rules are path prefixes. An opening end carries its own rule; a closing end carries the nearest rule
    around it, which is the longest other rule of the block whose path it begins with (none: no rule).
    """
    own = (
        rules.select(F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("_path"), F.col("action").alias("_action"))
        .withColumn("_parts", labels(F.col("host")))
        .select(block(F.col("_parts"), F.size("_parts")).alias("_block"), F.size("_parts").alias("_depth"), "_path", F.concat("host", "_path").alias("_rule"), "_action")
        .groupBy("_block", "_depth", "_path")
        .agg(F.min("_rule").alias("_rule"), F.max("_action").alias("_action"))
    )
    outer = own.select(F.col("_block").alias("_b"), F.col("_path").alias("_p"), F.struct(F.length("_path").alias("n"), F.col("_rule"), F.col("_action")).alias("_outer"))
    shorter = own.filter(F.length("_path") > 0).withColumn("_prefix", F.explode(F.transform(F.sequence(F.lit(0), F.length("_path") - 1), lambda n: F.substring(F.col("_path"), F.lit(1), n))))
    around = (
        shorter.join(outer, (F.col("_block") == F.col("_b")) & (F.col("_prefix") == F.col("_p")))
        .groupBy("_block", "_path")
        .agg(F.max("_outer").alias("_outer"))
    )
    opened = own.select("_block", "_depth", F.col("_path").cast("binary").alias("_at"), F.lit(0).alias("_order"), F.struct("_rule", "_action").alias("_top"))
    closed = own.join(around, ["_block", "_path"], "left").select(
        "_block",
        "_depth",
        F.concat(F.col("_path").cast("binary"), F.lit(END)).alias("_at"),
        F.lit(2).alias("_order"),
        F.struct(F.col("_outer._rule").alias("_rule"), F.col("_outer._action").alias("_action")).alias("_top"),
    )
    return opened.unionByName(closed)


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """Per row of ``pages``: key, host, path, rule, verdict.

    rules: host, path, action (``allow`` or ``block``). A rule fits its host and all subdomains if the url's path starts
    with the rule's path; an empty host fits every url. Of the rules that fit, the one longest as text (host and path)
    wins, of equally long ones the one with more labels; the same host and path given twice counts once, ``block`` before
    ``allow``. A url that no rule fits gets a null rule and ``default``. Null urls and urls without ``://`` have an empty
    host and path. Each distinct host and path is judged once, so repeated urls cost a join row each; null keys stay;
    an empty table gives no rows; other columns are not read.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ends = durable(intervals(rules), "url-rules")
    depths = sorted(r[0] for r in ends.select("_depth").distinct().collect())
    if depths and depths[-1] > MAX_LABELS:
        raise ValueError(f"a rule's host has more than {MAX_LABELS} labels")
    places = rows.select("host", "path").distinct().withColumn("_parts", labels(F.col("host")))
    looked = (
        places.withColumn("_depth", F.explode(F.array(*map(F.lit, depths)) if depths else F.array().cast("array<int>")))
        .filter(F.col("_depth") <= F.size("_parts"))
        .select("host", "path", F.col("_depth"), block(F.col("_parts"), F.col("_depth")).alias("_block"))
    )
    # Blocks are salted by their share of the lookups, so that none of them is one task's work.
    blocks = ends.select("_block").distinct()
    looked = durable(looked.join(sized(blocks, 100_000), "_block", "left_semi"), "url-lookups")
    held = looked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    total = max(1, looked.count())
    salted = held.select("_block", F.ceil(F.col("_n") * 4 * tasks_of(spark) / total).cast("int").alias("_salts"))
    salted = sized(durable(salted, "url-blocks"), 100_000)
    left = looked.join(salted, "_block").select(
        "_block", F.pmod(F.xxhash64("host", "path"), F.col("_salts")).cast("int").alias("_salt"), F.col("path").cast("binary").alias("_at"), F.lit(1).alias("_order"),
        F.lit(None).cast(ends.schema["_top"].dataType).alias("_top"), "host", "path", "_depth",
    )
    right = ends.join(salted, "_block").select(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "_at", "_order", "_top",
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "_depth",
    )
    sweep = Window.partitionBy("_block", "_salt").orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    swept = left.unionByName(right).withColumn("_held", F.last("_top", ignorenulls=True).over(sweep))
    hits = swept.filter((F.col("_order") == 1) & F.col("_held._rule").isNotNull())
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("_held._rule").alias("n"), F.col("_depth"), F.col("_held"))).alias("_best"))
    judged = rows.join(best, ["host", "path"], "left")
    return judged.select(key, "host", "path", F.col("_best._held._rule").alias("rule"), F.coalesce("_best._held._action", F.lit(default)).alias("verdict"))
