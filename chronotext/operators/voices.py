"""Names for voices from what is said: votes from introductions, guests, welcomes and addresses, and their assignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.functions import fixed
from chronotext.operators.intervals import islands
from chronotext.session import written

NAME = r"\p{Lu}[\p{L}'’-]+"
WELCOME = rf"(?<![\p{{L}}])(?:{'|'.join(fixed.WELCOMES)})"


def any_of(words: tuple[str, ...]) -> str:
    return rf"(?<![\p{{L}}])(?:{'|'.join(words)})"


def no_person(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(\w+)$", 1)).isin(fixed.NOT_PERSONS)


def with_turns(segments: DataFrame, key: str) -> DataFrame:
    """Add turn_end, next_speaker, next_start: where the turn of a segment ends, and the voice that speaks then.

    A segment without a speaker goes on with the turn before it. The last turn has no next.
    """
    w = Window.partitionBy(key).orderBy("seq")
    turned = islands(segments, [key], ["seq"], F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(F.lag("speaker").over(w)) | F.lag("seq").over(w).isNull(), "_turn")
    last = F.coalesce(F.lead("_turn").over(w) != F.col("_turn"), F.lit(True))
    ends = turned.withColumns({"_end": F.when(last, F.col("end")), "_next": F.when(F.lead("_turn").over(w) != F.col("_turn"), F.struct(F.lead("speaker").over(w).alias("speaker"), F.lead("start").over(w).alias("start")))})
    on = w.rowsBetween(0, Window.unboundedFollowing)
    found = ends.withColumns({"turn_end": F.first("_end", ignorenulls=True).over(on), "_n": F.first("_next", ignorenulls=True).over(on)})
    return found.withColumns({"next_speaker": F.col("_n.speaker"), "next_start": F.col("_n.start")}).drop("_turn", "_end", "_next", "_n")


def reply(within: float) -> Column:
    """The voice that answers a segment, if it begins soon enough after it."""
    return F.when(F.col("next_start") - F.col("end") <= within, F.col("next_speaker"))


def known_names(people: DataFrame, hosts: DataFrame, key: str) -> DataFrame:
    """Names of two or three words that may be persons: key, name, first and surname in lower case, pos (their order)."""
    both = people.select(key, "name", "pos").unionByName(hosts.select(key, F.col("host").alias("name"), F.lit(1 << 30).cast(people.schema["pos"].dataType).alias("pos")))
    named = both.filter(F.col("name").rlike(f"^{fixed.PERSON}$") & ~no_person(F.col("name"))).groupBy(key, "name").agg(F.min("pos").alias("pos"))
    return named.select(key, "name", "pos", F.lower(F.substring_index("name", " ", 1)).alias("first"), F.lower(F.regexp_replace("name", r"^\S+\s", "")).alias("surname"))


def introductions(segs: DataFrame, names: DataFrame, people: DataFrame, key: str) -> DataFrame:
    """Who names themselves, by segment: the columns of ``segs`` and ``said``.

    A known name with this first name, by its surname or one spelled much like it, or the only one where no surname is
    said; else the words themselves, if the people are known by that first name alone.
    """
    pattern = rf"{any_of(fixed.INTRODUCES)}\s+({NAME})(?:\s+({NAME}))?"
    rows = segs.withColumns({"_first": F.regexp_extract("text", pattern, 1), "_last": F.regexp_extract("text", pattern, 2)}).filter("_first <> ''")
    last = F.lower("_last")
    known = rows.select(key, "seq", "_last", F.lower("_first").alias("first")).join(names, [key, "first"]).groupBy(key, "seq").agg(
        F.min_by(F.when(F.col("surname") == last, F.col("name")), F.when(F.col("surname") == last, F.col("pos"))).alias("_exact"),
        F.min(F.when(F.levenshtein("surname", last) <= F.ceil(F.length("surname") / 2), F.struct("pos", "name"))).alias("_near"),
        F.when(F.count(F.lit(1)) == 1, F.min("name")).alias("_only"),
    )
    singles = people.filter(F.col("name").rlike(f"^{NAME}$")).select(key, F.lower("name").alias("_single")).distinct()
    found = rows.join(known, [key, "seq"], "left").withColumn("_f", F.lower("_first")).join(singles.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & (F.col("_f") == F.col("_single")), "left")
    hit = F.when(F.col("_last") != "", F.coalesce("_exact", "_near.name")).otherwise(F.col("_only"))
    own = F.when(F.col("_single").isNotNull() & ~no_person(F.col("_last")), F.concat_ws(" ", "_first", F.nullif("_last", F.lit(""))))
    return found.withColumn("said", F.coalesce(hit, own)).filter("said IS NOT NULL").select(*segs.columns, "said")


def quoted(name: Column) -> Column:
    return F.concat(F.lit(r"\Q"), name, F.lit(r"\E"))


def name_votes(segments: DataFrame, people: DataFrame, hosts: DataFrame, key: str) -> DataFrame:
    """Votes for names: key, voice, name, weight. segments: key, seq, speaker, start, end, text; people: key, name, pos
    (order of preference); hosts: key, host.

    "I'm <name>" counts three for the voice that says it, or for the next one where the same voice named itself otherwise
    within eight seconds; a guest that is announced two for the next voice, and two for the host's voice; a welcome one or
    two for who replies; the host's name or a welcome to the show two for the host's voice; a first name at a question
    near a turn's end one for who answers. A host's voice has a minute of talk. Null and empty texts are left out, and
    votes for an unknown voice; repeated names of an episode count once. Wordings are looked for before any join, and all
    joins are on the episode.
    """
    host = hosts.filter(F.col("host").isNotNull()).groupBy(key).agg(F.min("host").alias("host"))
    names = known_names(people, host, key)
    some = names.select(key).distinct()
    segs = with_turns(segments.filter(F.col("text") != "").join(some, key, "left_semi").withColumn("end", F.coalesce("end", "start")), key).select(key, "seq", "speaker", "start", "end", "text", "turn_end", "next_speaker", "next_start")
    length = F.greatest(F.col("end") - F.col("start"), F.lit(0.0))
    segs = segs.withColumn("talk", F.when(F.col("speaker").isNotNull(), F.sum(length).over(Window.partitionBy(key, "speaker")))).join(host, key, "left")
    segs = written(segs, "spoken")  # six kinds of votes read it
    order = Window.partitionBy(key).orderBy("seq")

    said = introductions(segs, names, people, key)
    second = F.lag("speaker").over(order).eqNullSafe(F.col("speaker")) & (F.lag("said").over(order) != F.col("said")) & (F.col("start") - F.lag("start").over(order) <= 8)
    intro = said.withColumn("_second", F.coalesce(second, F.lit(False))).select(key, F.when(F.col("_second"), reply(30)).otherwise(F.col("speaker")).alias("voice"), F.col("said").alias("name"), F.lit(3.0).alias("weight"))

    text, name = F.col("text"), F.col("name")
    hosting = any_of(fixed.HOSTS)
    announced = segs.filter(text.rlike(f"(?iu){hosting}")).join(names.select(key, "name"), key)
    announced = announced.filter(F.rlike(text, F.concat(F.lit(rf"(?iu){hosting}\s+(?:the\s+\p{{L}}+\s+)?"), quoted(name), F.lit(r"(?![\p{L}])"))) & ~name.eqNullSafe(F.col("host")))
    guest = announced.select(key, F.col("next_speaker").alias("voice"), "name", F.lit(2.0).alias("weight"))
    asker = announced.filter("host IS NOT NULL AND talk >= 60").select(key, F.col("speaker").alias("voice"), F.col("host").alias("name"), F.lit(2.0).alias("weight"))

    either = F.concat(F.lit("(?:"), quoted(name), F.lit("|"), quoted(F.substring_index(name, " ", 1)), F.lit(")"))
    after = rf"(?: (?:{fixed.WELCOME_BACK}))?(?:{'|'.join(' ' + p for p in fixed.WELCOME_PLACE)})?,?\s+"
    met = segs.filter(text.rlike(f"(?iu){WELCOME}")).join(names.select(key, "name"), key)
    met = met.filter(F.rlike(text, F.concat(F.lit(r"(?iu)(?<![\p{L}])"), either, F.lit(rf",?\s+{WELCOME}(?![\p{{L}}])|{WELCOME}{after}"), either, F.lit(r"(?![\p{L}])"))))
    welcomed = met.select(key, reply(45).alias("voice"), "name", F.when(reply(5).isNotNull(), 2.0).otherwise(1.0).alias("weight"))

    hosts_it = text.rlike(rf"(?iu){WELCOME}(?: back)? to the (?:show|program|podcast)|{WELCOME},?\s+\p{{L}}") | F.contains(F.lower(text), F.lower("host"))
    house = segs.filter((F.col("talk") >= 60) & F.col("host").isNotNull() & hosts_it).select(key, F.col("speaker").alias("voice"), F.col("host").alias("name"), F.lit(2.0).alias("weight"))

    opening = rf"(?:^|[.?!]\s+)[\"“]?(?:(?:{fixed.ADDRESS_OPENERS}) )?({NAME}),\s"
    closing = rf",\s*({NAME})[?.!]?[\"”]?$"
    called = segs.filter(F.col("turn_end") - F.col("end") <= 20).withColumn("_words", F.concat(F.regexp_extract_all(text, F.lit(opening), F.lit(1)), F.regexp_extract_all(text, F.lit(closing), F.lit(1))))
    called = called.select(key, "seq", reply(30).alias("voice"), F.posexplode("_words").alias("_at", "_w")).filter("voice IS NOT NULL").withColumn("_w", F.lower("_w")).join(names.select(key, "name", "first"), key)
    alike = (F.length("first") >= 4) & (F.left("_w", F.lit(1)) == F.left("first", F.lit(1))) & (F.levenshtein("_w", "first") <= F.when(F.length("first") >= 6, 2).otherwise(1))
    single = called.filter((F.col("first") == F.col("_w")) | alike).groupBy(key, "seq", "voice", "_at").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("_n")).filter("_n = 1")
    asked = single.groupBy(key, "seq", "voice").agg(F.min_by("name", "_at").alias("name")).select(key, "voice", "name", F.lit(1.0).alias("weight"))

    votes = intro
    for more in (guest, asker, welcomed, house, asked):
        votes = votes.unionByName(more)
    return votes.filter("voice IS NOT NULL AND name IS NOT NULL")


def settled(pairs: Column, state: Column, may: Callable[[Column, Column], Column]) -> Column:
    """Go through pairs (voice, name) in order and settle each whose voice and name are free and that ``may`` (state, pair).

    state: voices, names (both used) and done (voice, name).
    """

    def step(s: Column, p: Column) -> Column:
        free = ~F.array_contains(s["voices"], p["voice"]) & ~F.array_contains(s["names"], p["name"]) & may(s, p)
        more = F.struct(F.array_append(s["voices"], p["voice"]).alias("voices"), F.array_append(s["names"], p["name"]).alias("names"), F.array_append(s["done"], F.struct(p["voice"].alias("voice"), p["name"].alias("name"))).alias("done"))
        return F.when(free, more).otherwise(s)

    return F.aggregate(pairs, state, step)


def nobody(voice: str) -> Column:
    return F.struct(F.array().cast(f"array<{voice}>").alias("voices"), F.array().cast("array<string>").alias("names"), F.array().cast(f"array<struct<voice:{voice},name:string>>").alias("done"))


def pairs_of(votes: DataFrame, key: str) -> DataFrame:
    """Per key its pairs by weight, then voice, then name: key, pairs (minus, voice, name)."""
    summed = votes.groupBy(key, "voice", "name").agg(F.sum("weight").alias("c"))
    return summed.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("minus"), "voice", "name"))).alias("pairs"))


def guess_names(segments: DataFrame, people: DataFrame, hosts: DataFrame, key: str, least: float = 2.0, minute: float = 60.0) -> DataFrame:
    """Names for voices, each voice and each name once: key, voice, name. Inputs as for ``name_votes``.

    First pairs of weight ``least`` or more, heaviest first (ties by voice, then name); then lighter ones of voices with a
    ``minute`` of talk, where the name is the only free one that anybody gave the voice; last the host, for the voice that
    asks three questions or more and half as many again as any other. All of an episode is one array, folded in the JVM.
    """
    kind = segments.schema["speaker"].dataType.simpleString()
    votes = name_votes(segments, people, hosts, key)
    said = segments.filter((F.col("text") != "") & F.col("speaker").isNotNull())
    asks = F.count_if(F.trim("text").rlike(r"\?[\"”]?$"))
    voices = said.groupBy(key, "speaker").agg(F.sum(F.greatest(F.coalesce("end", "start") - F.col("start"), F.lit(0.0))).alias("talk"), asks.alias("asks"))
    per = voices.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("speaker", "talk"))).alias("talk"), F.array_sort(F.collect_list(F.struct((-F.col("asks")).alias("minus"), F.col("speaker").alias("voice")))).alias("asks"))
    host = hosts.filter(F.col("host").isNotNull()).groupBy(key).agg(F.min("host").alias("host"))
    names = known_names(people, host, key).select(key, "name")
    rows = per.join(pairs_of(votes, key), key, "left").join(host, key, "left").join(names.select(key).distinct(), key, "left_semi")
    rows = rows.withColumn("pairs", F.coalesce("pairs", F.array().cast(f"array<struct<minus:double,voice:{kind},name:string>>")))
    rows = rows.withColumn("_one", settled(F.filter("pairs", lambda p: p["minus"] <= -least), nobody(kind), lambda s, p: F.lit(True)))
    talk, pairs = F.col("talk"), F.col("pairs")

    def alone(s: Column, p: Column) -> Column:
        open_ = F.filter(pairs, lambda q: (q["voice"] == p["voice"]) & ~F.array_contains(s["names"], q["name"]))
        return (F.coalesce(F.try_element_at(talk, p["voice"]), F.lit(0.0)) >= minute) & (F.size(open_) == 1)

    rows = rows.withColumn("_two", settled(pairs, F.col("_one"), alone))
    top, second = F.get("asks", 0), F.coalesce(-F.get("asks", 1)["minus"], F.lit(0))
    most = (-top["minus"] >= 3) & (-top["minus"] >= 1.5 * second) & (F.coalesce(F.try_element_at(talk, top["voice"]), F.lit(0.0)) >= minute)
    free = F.col("host").isNotNull() & ~F.array_contains("_two.names", F.col("host")) & ~F.array_contains("_two.voices", top["voice"])
    done = F.when(F.coalesce(most & free, F.lit(False)), F.array_append("_two.done", F.struct(top["voice"].alias("voice"), F.col("host").alias("name")))).otherwise(F.col("_two.done"))
    return rows.select(key, F.explode(done).alias("_d")).select(key, "_d.voice", "_d.name")
