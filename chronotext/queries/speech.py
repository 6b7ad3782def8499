"""Queries over segments: who talks when, turns, paragraphs, intervals, subtitles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.functions import text as tx
from chronotext.functions import times as tm
from chronotext.operators import folds, intervals, sequence, speech
from chronotext.queries.registry import query
from chronotext.queries.views import SEGMENTS, segments


@query(f"""WITH {SEGMENTS}, talk AS (SELECT episode_id, speaker, sum("end" - start) AS s FROM segments WHERE text <> '' AND "end" > start GROUP BY ALL)
SELECT episode_id, speaker, round(s, 3) AS seconds, round(s / sum(s) OVER (PARTITION BY episode_id), 4) AS fraction FROM talk""")
def talk_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2: seconds and share of each voice in an episode."""
    talk = segments(spark, sf_dir).filter((F.col("text") != "") & (F.col("end") > F.col("start"))).groupBy("episode_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("s"))
    return talk.select("episode_id", "speaker", F.round("s", 3).alias("seconds"), F.round(F.col("s") / F.sum("s").over(Window.partitionBy("episode_id")), 4).alias("fraction"))


@query(f"""WITH {SEGMENTS}, talk AS (SELECT episode_id, speaker, sum("end" - start) AS s FROM segments WHERE "end" > start GROUP BY ALL), whole AS (SELECT *, sum(s) OVER (PARTITION BY episode_id) AS total FROM talk)
SELECT episode_id, speaker, round(s, 3) AS seconds FROM whole WHERE total >= 100 AND s < least(60, total * 0.4) AND NOT (episode_id % 3 = 0 AND speaker = 1)""")
def minor_voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: voices with little to say and no name (shares set for these short episodes; every third names its second voice;
    whether one without a key does is not known, so it is left out)."""
    segs = segments(spark, sf_dir)
    named = segs.filter("episode_id % 3 = 0 AND speaker = 1")
    found = speech.minor_voices(segs, "episode_id", named, 0.4, 60.0, 100.0).filter("episode_id IS NOT NULL OR speaker <> 1")
    return found.select("episode_id", "speaker", F.round("seconds", 3).alias("seconds"))


@query(f"""WITH {SEGMENTS}, runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY episode_id ORDER BY seq) AS island FROM (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY episode_id ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM segments WHERE "end" > start))
SELECT episode_id, speaker, min(start) AS start, max("end") AS "end", count(*) AS n FROM runs GROUP BY episode_id, speaker, island""")
def speaker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One voice without a longer pause is one turn."""
    return sequence.joined_turns(segments(spark, sf_dir).filter(F.col("end") > F.col("start")), ["episode_id"], "speaker")


TURNS = """turns AS (SELECT episode_id, speaker, min(start) AS start, max("end") AS "end" FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY episode_id ORDER BY seq) AS island FROM (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY episode_id ORDER BY seq) THEN 0 ELSE 1 END AS fresh FROM segments WHERE "end" > start)
) GROUP BY episode_id, speaker, island)"""


@query(f"""WITH {SEGMENTS}, {TURNS}, t AS (SELECT *, CAST(floor(start * 10 + 0.5) AS BIGINT) AS a, CAST(floor("end" * 10 + 0.5) AS BIGINT) AS b FROM turns)
SELECT episode_id, speaker, a - coalesce(lag(b) OVER (PARTITION BY episode_id ORDER BY start), 0) AS gap, b - a AS len FROM t""")
def turns_delta_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in tenths of seconds as gaps and lengths."""
    return sequence.delta_code(speaker_turns(spark, sf_dir), ["episode_id"]).select("episode_id", "speaker", "gap", "len")


@query(f"""WITH {SEGMENTS}, {TURNS} SELECT episode_id, speaker, floor(start * 10 + 0.5) / 10 AS "from", floor("end" * 10 + 0.5) / 10 AS "to" FROM turns""")
def turns_delta_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was coded comes back, by running sums."""
    coded = sequence.delta_code(speaker_turns(spark, sf_dir), ["episode_id"])
    return sequence.delta_decode(coded, ["episode_id"], "start").select("episode_id", "speaker", "from", "to")


@query(f"""WITH {SEGMENTS}, cells AS (
  SELECT episode_id, speaker, unnest(range(CAST(floor(start / 30) AS BIGINT), CAST(ceil("end" / 30) AS BIGINT))) AS cell, start, "end" FROM segments WHERE "end" > start)
SELECT episode_id, speaker, cell, round(least(1.0, sum(least("end", (cell + 1) * 30.0) - greatest(start, cell * 30.0)) / 30), 4) AS share FROM cells GROUP BY episode_id, speaker, cell""")
def speaker_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each half minute that each voice talks."""
    s = segments(spark, sf_dir).filter(F.col("end") > F.col("start"))
    cells = s.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / 30), F.ceil(F.col("end") / 30) - 1)))
    share = F.sum(F.least(F.col("end"), (F.col("cell") + 1) * 30.0) - F.greatest(F.col("start"), F.col("cell") * 30.0)) / 30
    return cells.groupBy("episode_id", "speaker", "cell").agg(F.round(F.least(F.lit(1.0), share), 4).alias("share"))


@query(f"""WITH {SEGMENTS}, s AS (SELECT *, lead(start) OVER (PARTITION BY episode_id ORDER BY seq) AS nxt FROM segments)
SELECT a.episode_id, a.seq, b.speaker, round(sum(least(a."end", b."end") - greatest(a.start, b.start)), 3) AS seconds
FROM (SELECT episode_id, seq, start - 5 AS start, "end" + 5 AS "end" FROM segments) a JOIN segments b ON a.episode_id = b.episode_id AND a.start < b."end" AND b.start < a."end"
GROUP BY a.episode_id, a.seq, b.speaker""")
def overlap_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long each voice talks within a segment widened by five seconds; a bucketed interval join."""
    s = segments(spark, sf_dir)
    wide = s.select("episode_id", "seq", (F.col("start") - 5).alias("start"), (F.col("end") + 5).alias("end"))
    turns = s.select("episode_id", "speaker", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return intervals.overlap_join(wide, turns, ["episode_id"], 60.0).groupBy("episode_id", "seq", "speaker").agg(F.round(F.sum("overlap"), 3).alias("seconds"))


@query(f"""WITH {SEGMENTS} SELECT episode_id, min(start) AS "from", max("end") AS "to", count(*) AS n FROM segments WHERE "end" > 60 AND start < 120 GROUP BY episode_id""")
def selected_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a selection from one to two minutes touches."""
    return intervals.selection(segments(spark, sf_dir), ["episode_id"], F.lit(60), F.lit(120))


@query(f"""WITH {SEGMENTS}, marks AS (SELECT episode_id, seq, start FROM segments WHERE speaker = 0)
SELECT s.episode_id, s.seq, m.seq AS asked FROM segments s ASOF LEFT JOIN marks m ON s.episode_id = m.episode_id AND s.start + 0.3::DOUBLE >= m.start""")
def asof_question(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest user turn at each segment, with the slack chapters have."""
    s = segments(spark, sf_dir)
    marks = s.filter("speaker = 0").select("episode_id", "start", F.col("seq").alias("asked"))
    return intervals.asof_last(s, marks, ["episode_id"], "start", ["asked"], 0.3).select("episode_id", "seq", "asked")


@query(f"""WITH {SEGMENTS} SELECT episode_id, seq,
  max(speaker) FILTER (speaker <> 1) OVER (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS one_back,
  last_value(CASE WHEN speaker <> 1 THEN speaker END IGNORE NULLS) OVER (PARTITION BY episode_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried
FROM segments""")
def carried_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest known voice before a segment."""
    s = segments(spark, sf_dir).withColumn("known", F.when(F.col("speaker") != 1, F.col("speaker")))
    w = Window.partitionBy("episode_id").orderBy("seq")
    return sequence.carry_forward(s, ["episode_id"], "seq", "known", "carried").withColumn("one_back", F.lag("known").over(w)).select("episode_id", "seq", "one_back", "carried")


@query(f"""WITH {SEGMENTS} SELECT episode_id, seq, (SELECT min_by(b.speaker, b.seq) FROM segments b WHERE b.episode_id = a.episode_id AND b.seq > a.seq AND b.speaker <> a.speaker) AS next_speaker FROM segments a""")
def next_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next voice that is another one."""
    return sequence.next_other(segments(spark, sf_dir), ["episode_id"], "seq", "speaker", "next_speaker").select("episode_id", "seq", "next_speaker")


@query(f"""WITH {SEGMENTS} SELECT episode_id, speaker, min(seq) AS first, max(seq) AS last, CAST(sum(n_words) AS BIGINT) AS words FROM segments GROUP BY episode_id, speaker""")
def voice_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last segment and words of each voice."""
    return segments(spark, sf_dir).groupBy("episode_id", "speaker").agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.sum("n_words").alias("words"))


@query(f"""WITH {SEGMENTS} SELECT a.episode_id, a.seq, max(b."end") FILTER (b."end" <= a.start) AS before_end, min(b.start) FILTER (b.start >= a."end") AS after_start
FROM segments a JOIN segments b ON a.episode_id = b.episode_id WHERE a.speaker = 1 GROUP BY a.episode_id, a.seq""")
def neighbours_of_break(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of what is said before a stretch and the start of what comes after."""
    s = segments(spark, sf_dir)
    w = Window.partitionBy("episode_id").orderBy("seq")
    # Segments do not overlap, so the nearest are the neighbours that have a length.
    around = s.withColumns({"before_end": F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), "after_start": F.min("start").over(w.rowsBetween(1, Window.unboundedFollowing))})
    return around.filter("speaker = 1").select("episode_id", "seq", "before_end", "after_start")


@query()
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs, an array fold in the JVM; tests hold it against plain Python."""
    return folds.paragraphs(segments(spark, sf_dir), "episode_id")


def stamp_sql(x: str, mark: str) -> str:
    ms = f"CAST(floor(greatest({x}, 0) * 1000 + 0.5) AS BIGINT)"
    return f"printf('%02d:%02d:%02d{mark}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


@query(f"""WITH {SEGMENTS}, s AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY seq) AS k, lag(speaker) OVER (PARTITION BY episode_id ORDER BY seq) AS was FROM segments WHERE trim(text) <> '')
SELECT episode_id, string_agg(k || chr(10) || {stamp_sql('start', ',')} || ' --> ' || {stamp_sql('"end"', ',')} || chr(10) || CASE WHEN was IS DISTINCT FROM speaker THEN 'Speaker ' || (speaker + 1) || ': ' ELSE '' END || trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY k) AS srt
FROM s GROUP BY episode_id""")
def subtitles_srt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SubRip text of each episode; a name where the voice changes."""
    w = Window.partitionBy("episode_id").orderBy("seq")
    s = segments(spark, sf_dir).filter(F.trim("text") != "").withColumns({"k": F.row_number().over(w), "was": F.lag("speaker").over(w)})
    who = F.when(~F.col("was").eqNullSafe(F.col("speaker")), F.concat(F.lit("Speaker "), F.col("speaker") + 1, F.lit(": "))).otherwise("")
    cue = F.concat(F.col("k"), F.lit("\n"), tm.stamp(F.col("start")), F.lit(" --> "), tm.stamp(F.col("end")), F.lit("\n"), who, tx.clean(F.col("text")))
    return s.groupBy("episode_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("k", cue.alias("c")))).getField("c"), "\n\n").alias("srt"))


@query(f"""WITH {SEGMENTS} SELECT episode_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({stamp_sql('start', '.')} || ' --> ' || {stamp_sql('"end"', '.')} || chr(10) || '<v Speaker ' || (speaker + 1) || '>' || replace(trim(text), '-->', '->') || chr(10), chr(10) ORDER BY seq) AS vtt
FROM segments WHERE trim(text) <> '' GROUP BY episode_id""")
def subtitles_vtt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WebVTT text of each episode, the voice in each cue."""
    cue = F.concat(tm.stamp(F.col("start"), "."), F.lit(" --> "), tm.stamp(F.col("end"), "."), F.lit("\n<v Speaker "), F.col("speaker") + 1, F.lit(">"), F.replace(F.trim("text"), F.lit("-->"), F.lit("->")), F.lit("\n"))
    cues = F.array_sort(F.collect_list(F.struct("seq", cue.alias("c")))).getField("c")
    return segments(spark, sf_dir).filter(F.trim("text") != "").groupBy("episode_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(cues, "\n")).alias("vtt"))


@query(f"""WITH {SEGMENTS}, s AS (SELECT *, CAST(floor(start + 0.5) AS BIGINT) AS t FROM segments WHERE trim(text) <> '')
SELECT episode_id, string_agg('[' || CASE WHEN t >= 3600 THEN printf('%d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) ELSE printf('%d:%02d', t // 60, t % 60) END || '] ' || trim(regexp_replace(text, '\\s+', ' ', 'g')), chr(10) || chr(10) ORDER BY seq) AS plain
FROM s GROUP BY episode_id""")
def transcript_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transcript as text with times."""
    line = F.concat(F.lit("["), tm.clock(F.col("start")), F.lit("] "), tx.clean(F.col("text")))
    return segments(spark, sf_dir).filter(F.trim("text") != "").groupBy("episode_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seq", line.alias("c")))).getField("c"), "\n\n").alias("plain"))


@query()
def transcript_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: a transcript as Markdown, a paragraph each; escapes need back-references, so tests hold literal cases."""
    s = segments(spark, sf_dir)
    joined = s.join(paragraphs(spark, sf_dir), ["episode_id", "seq"])
    text = F.array_join(F.array_sort(F.collect_list(F.struct("seq", F.trim("text").alias("t")))).getField("t"), " ")
    paras = joined.groupBy("episode_id", "paragraph").agg(F.min("start").alias("start"), text.alias("t"))
    line = F.concat(F.lit("`"), tm.clock(F.col("start")), F.lit("` "), tx.escape_markdown(F.col("t")))
    return paras.groupBy("episode_id").agg(F.concat(F.lit("# Transcript\n\n"), F.array_join(F.array_sort(F.collect_list(F.struct("paragraph", line.alias("c")))).getField("c"), "\n\n"), F.lit("\n")).alias("markdown"))


@query()
def viterbi_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of segments by the cheapest path over who talks in each, widened by five seconds."""
    s = segments(spark, sf_dir)
    talk = overlap_seconds(spark, sf_dir).select("episode_id", "seq", F.col("speaker").alias("voice"), "seconds")
    return folds.label_path(s.select("episode_id", "seq", "start", "end", "text"), talk, "episode_id")


@query(f"""WITH {SEGMENTS}, kept AS (SELECT * FROM segments WHERE NOT ("end" - 0.05::DOUBLE > 30.0 AND start + 0.05::DOUBLE < 60.0 AND "end" > 30.05 AND start < 59.95))
SELECT episode_id, seq, start, "end" FROM kept UNION ALL SELECT DISTINCT episode_id, -1 AS seq, 30.0 AS start, 60.0 AS "end" FROM segments""")
def window_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One new segment takes the place of what overlaps the second half minute."""
    s = segments(spark, sf_dir).select("episode_id", "seq", "start", "end")
    ids = s.select("episode_id").distinct()
    new = ids.select("episode_id", F.lit(-1).cast("long").alias("seq"), F.lit(30.0).alias("start"), F.lit(60.0).alias("end"))
    window = ids.select("episode_id", F.lit(30.0).alias("w_start"), F.lit(60.0).alias("w_end"))
    return intervals.replace_window(s, new, window, ["episode_id"])
