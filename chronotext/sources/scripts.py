"""Speaker turns from published transcripts, whatever way they label who speaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.functions import fixed
from chronotext.functions import text as tx

NAME = r"[A-Z][\p{L}.'’-]*(?: [A-Z][\p{L}.'’-]*){0,3}"
#: Ways to label a line, the first that fits holds: a name and a time, a name before a colon, a name alone on its line.
STAMPED = rf"^({NAME})\s*[(\[]?(\d{{1,2}}:\d{{2}}(?::\d{{2}})?)[)\]]?\s*(.*)$"
COLON = rf"^({NAME}|[A-Z][A-Z.'’ -]{{1,30}})(?:, [^:]{{1,40}})?:\s+(.+)$"
ALONE = rf"^({NAME})$"
#: A label in capitals inside a run of text begins a line of its own.
RUN_ON = r"(?<=[.?!\]\"”)…])\s+(?=[A-Z][A-Z.'’ -]{2,40}(?:, [A-Z][A-Z ,.'’-]{1,40})?:\s)"


def transcript_lines(html: Column) -> Column:
    """Lines of a page's text: blocks, line breaks and labels in capitals begin them; scripts and the like are left out."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"(?i)<br\s*/?>|</(p|div|li|h\d|section|article|blockquote)>", "\n")
    out = F.regexp_replace(tx.decode_entities(F.regexp_replace(out, "<[^>]+>", " ")), RUN_ON, "\n")
    return F.filter(F.transform(F.split(out, "\n"), tx.clean), lambda x: x != "")


def label_key(who: Column) -> Column:
    """A label for comparison: capitals, no stops or apostrophes."""
    return tx.clean(F.regexp_replace(F.upper(who), r"[.'’]", ""))


def surname(label: Column) -> Column:
    return F.substring_index(label, " ", -1)


def transcript_turns(pages: DataFrame, key: str, html: str = "html", least: int = 4, long: int = 25) -> DataFrame:
    """Turns of transcripts in pages: key, turn (from 0), speaker, text.

    A label counts if its surname labels ``least`` lines or more of the page, so a sentence that begins "Note:" speaks
    nothing; its text and the lines after it, of three words or more, are the turn. A surname alone stands for the fuller
    label with it. What comes before the first turn of ``long`` words is the page's furniture; so are turns about somebody
    and turns without text. Pages without labels, null and empty ones give no rows. Lines are counted and joined by page
    and surname; one page's turns are one window.
    """
    lines = pages.select(key, F.posexplode(transcript_lines(F.col(html))).alias("at", "line"))
    line = F.col("line")
    way = F.when(line.rlike(STAMPED), 1).when(line.rlike(COLON), 2).when(line.rlike(ALONE), 3)
    who = F.when(way == 1, F.regexp_extract(line, STAMPED, 1)).when(way == 2, F.regexp_extract(line, COLON, 1)).when(way == 3, line)
    said = F.when(way == 1, F.regexp_extract(line, STAMPED, 3)).when(way == 2, F.regexp_extract(line, COLON, 2)).when(way == 3, "")
    labelled = lines.withColumns({"label": F.when(way.isNotNull(), label_key(who)), "said": said}).withColumn("_last", surname(F.col("label")))
    often = labelled.filter("label IS NOT NULL").groupBy(key, "_last").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= least)
    marked = labelled.join(often, [key, "_last"], "left").withColumn("label", F.when(F.col("_n").isNotNull() & ~F.col("label").rlike(f"^({fixed.NO_LABELS})$"), F.col("label")))
    # A line starts a turn or belongs to the one before it; lines before the first label belong to none.
    order = Window.partitionBy(key).orderBy("at")
    numbered = marked.withColumn("_turn", F.count("label").over(order)).filter("_turn > 0")
    part = F.when(F.col("label").isNotNull(), F.col("said")).when(F.size(F.split(line, " ")) >= 3, line)
    turns = numbered.groupBy(key, "_turn").agg(F.max("label").alias("speaker"), F.array_sort(F.collect_list(F.struct("at", part.alias("t")))).alias("_p"))
    text = F.array_join(F.filter("_p.t", lambda t: t.isNotNull() & (t != "")), " ")
    turns = turns.select(key, "_turn", "speaker", F.trim(text).alias("text"), surname(F.col("speaker")).alias("_last"))
    full = turns.filter(F.col("speaker").contains(" ")).groupBy(key, "_last").agg(F.min_by("speaker", "_turn").alias("_full"))
    named = turns.join(full, [key, "_last"], "left").withColumn("speaker", F.when(F.col("speaker").contains(" "), F.col("speaker")).otherwise(F.coalesce("_full", "speaker")))
    whole = Window.partitionBy(key)
    begins = F.coalesce(F.min(F.when(tx.word_count(F.col("text")) >= long, F.col("_turn"))).over(whole), F.lit(0))
    kept = named.withColumn("_from", begins).filter((F.col("_turn") >= F.col("_from")) & (F.col("text") != "") & ~F.col("speaker").startswith("ABOUT "))
    return kept.select(key, (F.row_number().over(whole.orderBy("_turn")) - 1).alias("turn"), "speaker", "text")
