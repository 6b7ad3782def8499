"""Queries over names, shows and glossaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.operators import names
from chronotext.queries.registry import query
from chronotext.session import table


@query()
def show_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of feed addresses by two mixed 32-bit hashes; tests hold it against plain Python."""
    return table(spark, sf_dir, "pages").select("page_id", names.show_id(F.col("url")).alias("show_id"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Anna Berg' ELSE 'Ezra Klein' END AS host FROM part""")
def show_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts named in titles."""
    title = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(" with Anna Berg"))).otherwise("The Ezra Klein Show")
    return table(spark, sf_dir, "part").select("p_partkey", names.host_from_show(title).alias("host"))


@query()
def name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings of one name among frequent capitalised words, by language."""
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}{4,}"), F.lit(0))).alias("term"))
    return names.name_groups(words.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4"), "lang")


@query()
def glossary_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with near spellings of two terms put right."""
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return names.corrected(docs, "text", ["threading", "Tidewater"], {"the the": "the"}, "corrected").select("conv_id", "turn", "corrected")
