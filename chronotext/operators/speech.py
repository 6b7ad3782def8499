"""Operators on recognised speech: sentences, breaks for sponsors, choices between attempts, languages, settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.functions import fixed
from chronotext.functions import text as tx
from chronotext.functions.times import half_up
from chronotext.operators.intervals import islands, merge_spans
from chronotext.operators.voices import nobody, pairs_of, settled

SENTENCE_GAP = r"(?<=[.!?…])\s+(?=[\"“‘(]?[\p{Lu}\d])"


def sentence_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Timed parts cut into sentences, the time shared by their lengths: keys, seq, k, start, end, text."""
    texts = F.filter(F.transform(F.split("text", SENTENCE_GAP), lambda x: F.trim(x)), lambda x: x != "")
    total = F.aggregate(F.transform("_x", lambda x: F.length(x)), F.lit(0), lambda a, n: a + n)
    rows = parts.withColumn("_x", texts).withColumn("_total", total).select(*keys, "seq", "start", "end", "_total", F.posexplode("_x").alias("k", "_t"))
    w = Window.partitionBy(*keys, "seq").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    through = F.sum(F.length("_t")).over(w)
    span = F.col("end") - F.col("start")
    return rows.select(*keys, "seq", "k", (F.col("start") + span * (through - F.length("_t")) / F.col("_total")).alias("start"), (F.col("start") + span * through / F.col("_total")).alias("end"), F.col("_t").alias("text"))


def sponsor_breaks(
    paragraphs: DataFrame, key: str, strong: tuple[str, ...] = fixed.STRONG_CUES, weak: tuple[str, ...] = fixed.WEAK_CUES, same_voice: float = 45.0, other_voice: float = 12.0, shortest: float = 8.0, longest: float = 360.0, longest_many: float = 600.0
) -> DataFrame:
    """Stretches with reads for sponsors: key, start, end, reads. paragraphs: key, start, end, speaker, text.

    Paragraphs with cues are joined while the gap to the one before stays under the bridge of its voice; a stretch of one
    read may last ``longest`` seconds, of several ``longest_many``; stretches within a second of each other are one.
    """
    ads = paragraphs.filter(tx.is_ad(F.col("text"), strong, weak))
    w = Window.partitionBy(key).orderBy("start")
    same = F.coalesce(F.lag("speaker").over(w) == F.col("speaker"), F.lit(True))
    fresh = F.col("start") - F.lag("end").over(w) > F.when(same, same_voice).otherwise(other_voice)
    found = islands(ads, [key], ["start"], fresh).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("reads"))
    length = F.col("end") - F.col("start")
    kept = found.filter((length >= shortest) & (length <= F.when(F.col("reads") > 1, longest_many).otherwise(longest)))
    return merge_spans(kept.select(key, half_up(F.col("start"), 1).alias("start"), half_up(F.col("end"), 1).alias("end")), [key], touch=1.0).withColumnRenamed("n", "reads")


LOOP = r"(?<!\S)((?:\S+ ){0,7}?\S+)(?: \1){2,}+(?!\S)"


def spoken_only(text: Column) -> Column:
    """Lower-case letters and digits with single spaces."""
    return tx.clean(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", ""))


def loops(text: Column, left: float) -> Column:
    """Whether cutting the loops of one to eight words to two copies leaves less than a share of the words' letters."""
    plain = spoken_only(text)
    return F.length(F.regexp_replace(plain, LOOP, "$1 $1")) < F.length(plain) * left


def trouble(text: Column, seconds: Column) -> Column:
    """How many signs of a failed recognition a text shows: a stuck letter, loops, few different sentences, too few words.

    A null text has none but the last; null seconds count as none.
    """
    text = F.trim(F.coalesce(text, F.lit("")))
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), spoken_only), lambda x: F.length(x) > 3)
    stuck = text.rlike(r"(\p{L})\1{4}")
    same = (F.size(sentences) >= 3) & (F.size(F.array_distinct(sentences)) <= 0.6 * F.size(sentences))
    sparse = F.coalesce((seconds >= 10) & (tx.word_count(text) < 0.6 * seconds), F.lit(False))
    return stuck.cast("int") + loops(text, 0.75).cast("int") + same.cast("int") + sparse.cast("int")


def echoed(text: Column, prompt: Column) -> Column:
    """Whether a text only repeats its prompt (more than 12 letters that stand in it) or falls below 70 % without its loops."""
    plain = spoken_only(text)
    return (plain != "") & (((F.length(plain) > 12) & F.contains(spoken_only(prompt), plain)) | loops(text, 0.7))


def token_parts(tokens: DataFrame, keys: list[str], first_stamp: int, duration: float, tick: float = 0.02) -> DataFrame:
    """Timed parts of recognised windows: keys, part, start, end, tokens, open. tokens: keys, pos, token.

    Tokens from ``first_stamp`` on are times in ticks. Each run of words between two of them is a part: from the time before
    it (0 if none) to the one after it, which is never before its start; a run that nothing closes is open and ends with
    the window. Null tokens are words without a value and are left out; times alone make no part.
    """
    stamp = F.when(F.col("token") >= first_stamp, F.least(F.lit(duration), (F.col("token") - first_stamp) * tick))
    rows = tokens.filter("token IS NOT NULL").withColumn("_t", stamp)
    rows = rows.withColumn("part", F.count("_t").over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(*keys, "part").agg(F.max("_t").alias("_t"), F.sort_array(F.collect_list(F.when(F.col("_t").isNull(), F.struct("pos", "token")))).alias("_w"))
    following = F.lead("_t").over(Window.partitionBy(*keys).orderBy("part"))
    timed = runs.withColumn("start", F.coalesce("_t", F.lit(0.0))).withColumn("_next", following)
    end = F.when(F.col("_next").isNull(), F.lit(duration)).otherwise(F.greatest("start", "_next"))
    return timed.filter(F.size("_w") > 0).select(*keys, "part", "start", end.alias("end"), F.col("_w.token").alias("tokens"), F.col("_next").isNull().alias("open"))


def tail_to_rerun(parts: DataFrame, tails: DataFrame, keys: list[str], duration: float, least: float = 2.0, quiet: float = 0.0025) -> DataFrame:
    """Windows whose parts stop more than ``least`` seconds early although the rest is not quiet: keys, until.

    parts: keys, part, end; tails: keys, rms (of the samples after the last part). Windows without parts are left out.
    """
    until = parts.groupBy(*keys).agg(F.max_by("end", "part").alias("until"))
    return until.filter(F.lit(duration) - F.col("until") > least).join(tails.filter(F.col("rms") > quiet).select(*keys).distinct(), keys, "left_semi")


def speech_seconds(samples: DataFrame, keys: list[str], rate: int, floor: float = 0.005) -> DataFrame:
    """Seconds above a quiet floor, by whole frames of a tenth of a second: keys, seconds. samples: keys, pos (from 0), x."""
    size = rate // 10
    frames = samples.groupBy(*keys, F.floor(F.col("pos") / size).alias("_f")).agg(F.sum(F.col("x") * F.col("x")).alias("_e"), F.count(F.lit(1)).alias("_n"))
    return frames.groupBy(*keys).agg((F.count_if((F.col("_n") == size) & (F.sqrt(F.col("_e") / size) > floor)) / 10).alias("seconds"))


def best_attempt(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """Of several attempts at a window the one with fewest troubles, then most words, then the first: keys, attempt."""
    return attempts.groupBy(*keys).agg(F.min_by("attempt", F.struct("troubles", (-F.col("n_words")).alias("w"), "attempt")).alias("attempt"))


def attempts_made(attempts: DataFrame, keys: list[str], patience: int = 3) -> DataFrame:
    """Which attempts a recogniser makes at each window of a recording, and which it keeps: keys, window, tried, attempt.

    attempts: keys, window, attempt (in the order in which they would be made), troubles, n_words. A window is tried again
    while its attempts have troubles; once ``patience`` windows kept troubles after several attempts, later ones are tried
    once only. Kept is the attempt with fewest troubles, then most words, then the first. Null troubles count as none. All
    windows of a recording are one array that is folded in the JVM.
    """
    item = F.struct("attempt", F.coalesce("troubles", F.lit(0)).cast("long").alias("troubles"), F.coalesce("n_words", F.lit(0)).cast("long").alias("words"))
    windows = attempts.groupBy(*keys, "window").agg(F.array_sort(F.collect_list(item)).alias("tries"))
    rows = windows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("window", "tries"))).alias("_w"))
    kinds = dict(attempts.dtypes)
    out = f"array<struct<window:{kinds['window']},tried:int,attempt:{kinds['attempt']}>>"

    def step(a: Column, w: Column) -> Column:
        clean = F.array_position(F.transform(w["tries"], lambda t: t["troubles"] == 0), F.lit(True)).cast("int")
        tried = F.when(a["useless"] >= patience, 1).when(clean > 0, clean).otherwise(F.size(w["tries"]))
        ranked = F.transform(F.slice(w["tries"], F.lit(1), tried), lambda t: F.struct(t["troubles"].alias("troubles"), (-t["words"]).alias("minus"), t["attempt"].alias("attempt")))
        best = F.array_min(ranked)
        useless = a["useless"] + F.when((tried > 1) & (best["troubles"] > 0), 1).otherwise(0)
        return F.struct(useless.alias("useless"), F.array_append(a["out"], F.struct(w["window"].alias("window"), tried.alias("tried"), best["attempt"].alias("attempt"))).alias("out"))

    fold = F.aggregate("_w", F.struct(F.lit(0).alias("useless"), F.array().cast(out).alias("out")), step)
    return rows.select(*keys, F.explode(fold["out"]).alias("_o")).select(*keys, "_o.window", "_o.tried", "_o.attempt")


def minor_voices(segments: DataFrame, key: str, named: DataFrame | None = None, share: float = 0.03, most: float = 60.0, least_total: float = 300.0) -> DataFrame:
    """Voices with little to say and no name: key, speaker, seconds. segments: key, speaker, start, end; named: key, speaker.

    An episode counts from ``least_total`` seconds of talk on; a voice is minor below ``most`` seconds and below a ``share``
    of the talk. Segments without a speaker or of no length are left out. Seconds are added as they are said, voices by
    their first words, so that a sum on a threshold does not hang on how rows are dealt out.
    """
    rows = segments.filter(F.col("speaker").isNotNull() & (F.col("end") > F.col("start")))
    said = Window.partitionBy(key, "speaker").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = rows.select(key, "speaker", "start", F.sum(F.col("end") - F.col("start")).over(said).alias("seconds"))
    talk = summed.groupBy(key, "speaker").agg(F.max("seconds").alias("seconds"), F.min("start").alias("_first"))
    voices = Window.partitionBy(key).orderBy("_first", "speaker").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = talk.withColumn("_total", F.sum("seconds").over(voices))
    found = whole.filter((F.col("_total") >= least_total) & (F.col("seconds") < F.least(F.lit(most), F.col("_total") * share)))
    found = found if named is None else found.join(named.select(key, "speaker").distinct(), [key, "speaker"], "left_anti")
    return found.select(key, "speaker", "seconds")


def lag_consensus(lags: DataFrame, keys: list[str], most: float = 0.02) -> DataFrame:
    """The lag several probes agree on: none if they spread over more than ``most``, else the upper median: keys, lag."""
    grouped = lags.groupBy(*keys).agg(F.array_sort(F.collect_list("lag")).alias("_l"))
    return grouped.filter(F.array_max("_l") - F.array_min("_l") <= most).select(*keys, F.get("_l", F.floor(F.size("_l") / 2).cast("int")).alias("lag"))


# Language families whose members are easily taken for one another, and the languages an app may offer.
FAMILIES = [["no", "nn", "sv", "da"], ["es", "ca", "gl", "pt"], ["de", "nl", "lb"], ["fr", "oc"], ["it", "la"]]
OFFERED = ["en", "no", "nn", "da", "fr", "de", "es", "it"]


def foreign_language(scores: DataFrame, keys: list[str], own: list[str], least: float = 0.4, most_own: float = 0.2) -> DataFrame:
    """Windows clearly in another language: keys, code, prob. scores: keys, lang, prob (a row for each language).

    The own languages together have at most ``most_own``, and one family at least ``least``. Its likeliest member names
    it, but one of OFFERED does if it is at least half as likely. Equal probabilities take the later code; a window
    without scores, or with null probabilities only, is not foreign.
    """
    family = F.create_map(*[F.lit(x) for members in FAMILIES for lang in members for x in (lang, members[0])])
    rows = scores.withColumns({"_own": F.col("lang").isin(own), "_f": F.coalesce(family[F.col("lang")], F.col("lang"))})
    other = F.when(~F.col("_own"), F.struct("prob", F.col("lang").alias("code")))
    offered = F.when(F.col("lang").isin(OFFERED), other)
    pooled = rows.groupBy(*keys, "_f").agg(
        F.sum(F.when(F.col("_own"), F.col("prob")).otherwise(0.0)).alias("_mine"), F.sum(F.when(~F.col("_own"), F.col("prob")).otherwise(0.0)).alias("prob"), F.max(other).alias("_top"), F.max(offered).alias("_offered")
    )
    named = F.when(F.col("_offered.prob") >= 0.5 * F.col("_top.prob"), F.col("_offered.code")).otherwise(F.col("_top.code"))
    best = pooled.withColumn("code", named).groupBy(*keys).agg(F.sum("_mine").alias("_mine"), F.max(F.struct("prob", "code")).alias("_b"))
    return best.filter((F.col("_mine") <= most_own) & (F.col("_b.prob") >= least)).select(*keys, F.col("_b.code").alias("code"), F.col("_b.prob").alias("prob"))


def assign_names(votes: DataFrame, key: str, least: float = 2.0) -> DataFrame:
    """Names for voices, each used once: key, voice, name. votes: key, voice, name, weight.

    The greedy assignment by weight (summed, ``least`` or more), ties by voice, then name. All votes of a key, an episode,
    are one array that is folded in the JVM. No votes give no rows.
    """
    kind = votes.schema["voice"].dataType.simpleString()
    enough = F.filter("pairs", lambda p: p["minus"] <= -least)
    done = settled(enough, nobody(kind), lambda s, p: F.lit(True))["done"]
    return pairs_of(votes, key).select(key, F.explode(done).alias("_d")).select(key, "_d.voice", "_d.name")


def suggested_repairs(stats: DataFrame) -> DataFrame:
    """Which repairs a voice's statistics call for: an array column ``repairs`` and an amount of noise reduction."""
    snr = F.coalesce("level", F.lit(-20.0)) - F.coalesce("noise_db", F.lit(-140.0))
    denoise = (F.col("noise_db") > -58) | (snr < 40)
    dull = F.col("cutoff_hz").isNotNull() & (F.col("cutoff_hz") > 0) & (F.col("cutoff_hz") < 14000)
    drops = F.col("dropouts_per_min") >= 3
    rules = [("highpass", F.col("rumble")), ("dehum", F.col("hum_hz").isNotNull()), ("dropouts", drops), ("denoise", denoise), ("highs", dull), ("eq", dull), ("compress", (F.col("gated_share") > 0.04) | drops)]
    names = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    amount = F.least(F.lit(18), F.greatest(F.lit(6), half_up((50 - snr) * 0.6 + 8)))
    return stats.withColumns({"repairs": names, "denoise_amount": F.when(F.coalesce(denoise, F.lit(False)), amount).cast("int")})


def merge_glossary(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Glossary lines: a new line takes the place of old lines with the same left side. Both: key, line."""
    left = F.lower(F.trim(F.regexp_extract("line", r"^(.*?)\s*(?:=|->|→|$)", 1)))
    kept = old.withColumn("_l", left).join(new.select(key, left.alias("_l")).distinct(), [key, "_l"], "left_anti").drop("_l")
    return kept.unionByName(new).distinct()


def shifted(timeline: DataFrame, offset: Column) -> DataFrame:
    """A timeline from an offset on: what ended is dropped, what runs starts at zero."""
    return timeline.filter(F.col("end") > offset).withColumns({"start": F.greatest(F.col("start") - offset, F.lit(0.0)), "end": F.col("end") - offset})
