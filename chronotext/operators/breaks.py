"""Breaks for sponsors in full: which paragraphs belong to a break, and where it begins and ends.

Wordings, names and paragraphs are found by column functions over all segments; only the growing of a break, whose every
step depends on how far it has come, folds over the paragraphs of one episode.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.functions import fixed
from chronotext.functions import text as tx
from chronotext.operators.folds import paragraphs
from chronotext.session import ship


def names_in(text: Column) -> Column:
    """Capitalised words that may be names of what is sold, as often as they stand there."""
    found = F.regexp_extract_all(text, F.lit(fixed.SOLD_NAME), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(fixed.NOT_SOLD))


def named_sentences(text: Column, strong: tuple[str, ...] = fixed.STRONG_CUES, weak: tuple[str, ...] = fixed.WEAK_CUES) -> Column:
    """(name, cued) of each name in a text; cued where its sentence is worded as a read for a sponsor."""

    def of(sentence: Column) -> Column:
        cued = (tx.strong_cues(sentence, strong) > 0) | (tx.weak_cues(sentence, weak) > 0)
        return F.transform(names_in(sentence), lambda w: F.struct(w.alias("name"), cued.alias("cued")))

    return F.flatten(F.transform(F.split(text, r"(?<=[.!?])\s+"), of))


def sold_names(paragraphs: DataFrame, reads: DataFrame, key: str, away: float = 150.0, least: int = 2) -> DataFrame:
    """Names that a read sells under: key, read, name, n.

    paragraphs: key, start, end, text; reads: key, read, start, end. A name counts if it is said ``least`` times or more
    in the paragraphs inside the read, once in a sentence worded as one, and in no paragraph of the episode that ends
    more than ``away`` seconds before the read or begins that long after it. Null texts say nothing; a paragraph in
    several reads counts for each. All joins are on the episode, and names are reduced before they meet.
    """
    said = paragraphs.select(key, "start", "end", F.explode(named_sentences(F.col("text"))).alias("_w")).select(key, "start", "end", "_w.name", "_w.cued")
    per = said.groupBy(key, "start", "end", "name").agg(F.count(F.lit(1)).alias("n"), F.max("cued").alias("cued"))
    spans = reads.select(key, "read", F.col("start").alias("_from"), F.col("end").alias("_to"))
    inside = per.join(spans, key).filter("start >= _from AND end <= _to")
    found = inside.groupBy(key, "read", "_from", "_to", "name").agg(F.sum("n").alias("n"), F.max("cued").alias("cued")).filter((F.col("n") >= least) & F.col("cued"))
    heard = per.groupBy(key, "name").agg(F.min("end").alias("_first"), F.max("start").alias("_last"))
    kept = found.join(heard, [key, "name"]).filter((F.col("_first") >= F.col("_from") - away) & (F.col("_last") <= F.col("_to") + away))
    return kept.select(key, "read", "name", "n")


@dataclass
class Limits:
    """Seconds: gaps that a break may bridge, lengths it may have, and what counts as right beside it."""

    same_voice: float = 45.0
    named: float = 150.0
    other_voice: float = 12.0
    shortest: float = 8.0
    longest: float = 360.0
    longest_many: float = 600.0
    pause: float = 1.5
    edge: float = 20.0
    beside: float = 3.0
    after: float = 5.0
    passing: float = 90.0
    sign_off: float = 12.0
    tail: float = 15.0
    lead: float = 8.0


@dataclass
class Episode:
    """The paragraphs of one episode in order, each a dict: start, end, speaker, ad, adish, minor, back, names (name and
    cued, as often as said), segs (start, end, cue, opener, back, names)."""

    paras: list[dict]
    limits: Limits = field(default_factory=Limits)

    def __post_init__(self) -> None:
        self.extent: dict = {}
        for k, p in enumerate(self.paras):
            if p["speaker"] is not None:
                low, _ = self.extent.get(p["speaker"], (k, k))
                self.extent[p["speaker"]] = (low, k)
        self.segs = [s for p in self.paras for s in p["segs"]]

    def gap(self, a: int, b: int) -> float:
        return self.paras[b]["start"] - self.paras[a]["end"]

    def length(self, k: int) -> float:
        return self.paras[k]["end"] - self.paras[k]["start"]

    def said(self, k: int) -> set[str]:
        return {n["name"] for n in self.paras[k]["names"]}

    def sold(self, first: int, last: int) -> set[str]:
        """Names that paragraphs ``first`` to ``last`` sell under."""
        times: Counter[str] = Counter()
        cued: set[str] = set()
        for k in range(first, last + 1):
            for n in self.paras[k]["names"]:
                times[n["name"]] += 1
                if n["cued"]:
                    cued.add(n["name"])
        wanted = {w for w in cued if times[w] > 1}
        low, high = self.paras[first]["start"] - self.limits.named, self.paras[last]["end"] + self.limits.named
        for k, p in enumerate(self.paras):
            if wanted and (p["end"] < low or p["start"] > high):
                wanted -= self.said(k)
        return wanted

    def next_read(self, first: int, last: int) -> int | None:
        """The next read that belongs to the break: as near as its voice allows, farther if what lies between names the brand."""
        here, one_voice, named = self.paras[last]["speaker"], True, False
        names = self.sold(first, last)
        for k in range(last + 1, len(self.paras)):
            speaker = self.paras[k]["speaker"]
            one_voice = one_voice and (here is None or speaker is None or here == speaker)
            bridge = self.limits.other_voice if not one_voice else self.limits.named if named else self.limits.same_voice
            if self.gap(last, k) > max(bridge, self.limits.same_voice):
                return None
            if self.paras[k]["ad"]:
                return k if self.gap(last, k) <= bridge else None
            named = one_voice and (named or not names.isdisjoint(self.said(k)))
        return None

    def spot(self, k: int) -> bool:
        """A paragraph with one weak cue, or a short one in a passing voice."""
        return self.paras[k]["adish"] or self.paras[k]["minor"] and self.length(k) <= self.limits.passing

    def grown(self, i: int) -> tuple[int, int]:
        """First and last paragraph of the break around the read ``i``."""
        lim, n = self.limits, len(self.paras)
        first = last = i
        while True:
            if (found := self.next_read(first, last)) is not None:
                last = found
            elif last + 1 < n and self.gap(last, last + 1) <= lim.after and self.spot(last + 1):
                last += 1
            else:
                break
        if first and self.gap(first - 1, first) <= lim.beside and not self.paras[first - 1]["ad"] and self.spot(first - 1):
            first -= 1
        if last + 1 < n:
            p = self.paras[last + 1]
            near = p["speaker"] == self.paras[last]["speaker"] and self.gap(last, last + 1) <= lim.beside and self.length(last + 1) <= lim.sign_off
            if near and not p["back"] and not self.sold(first, last).isdisjoint(self.said(last + 1)):
                last += 1
        voices = {p["speaker"] for p in self.paras[first : last + 1] if p["ad"]} - {None}
        # Voices that read here and are heard nowhere else: all they say beside it, until nothing more joins.
        while True:
            low = first and self.gap(first - 1, first) <= lim.beside and self.only_here(first - 1, first, voices, first - 1, last)
            first -= bool(low)
            high = last + 1 < n and self.gap(last, last + 1) <= lim.beside and self.only_here(last + 1, last, voices, first, last + 1)
            last += bool(high)
            if not low and not high:
                return first, last

    def only_here(self, k: int, edge: int, voices: set, low: int, high: int) -> bool:
        voice = self.paras[k]["speaker"]
        if voice not in voices or voice != self.paras[edge]["speaker"]:
            return False
        begins, ends = self.extent[voice]
        return begins >= low and ends <= high

    def begins(self, first: int) -> float:
        """Where the break begins inside its first paragraph: at a sentence that opens a read, well into it or after a pause."""
        p = self.paras[first]
        at = next((k for k, s in enumerate(p["segs"]) if s["opener"]), 0) if p["ad"] else 0
        s = p["segs"]
        if at and (s[at]["start"] - p["start"] >= self.limits.lead or s[at]["start"] - s[at - 1]["end"] >= self.limits.pause):
            return s[at]["start"]
        return p["start"]

    def ends(self, first: int, last: int) -> float:
        """Where it ends inside its last: a little after the last cue up to a pause, else at the cue; never at words that
        bring the show back, but on to a line that names what was sold."""
        segs, lim = self.paras[last]["segs"], self.limits
        cue = max((k for k, s in enumerate(segs) if s["cue"]), default=None)
        if cue is None:
            return segs[-1]["end"]
        paused = [k + 1 == len(segs) or segs[k + 1]["start"] - segs[k]["end"] >= lim.pause for k in range(len(segs))]  # behind k
        at = cue
        while at + 1 < len(segs) and not paused[at] and segs[at + 1]["end"] - segs[cue]["end"] < lim.tail:
            at += 1
        if not paused[at]:
            at = cue
        back = next((k for k in range(cue + 1, len(segs)) if segs[k]["back"]), len(segs))
        at = min(at, back - 1)
        sold = self.sold(first, last)
        while at + 1 < len(segs) and segs[at + 1]["end"] - segs[cue]["end"] <= lim.tail and not segs[at + 1]["back"] and not sold.isdisjoint(segs[at + 1]["names"]):
            at += 1
        return segs[at]["end"]

    def breaks(self) -> Iterator[tuple[float, float, int]]:
        """(start, end, reads) in order, out to the words on either side."""
        lim, held = self.limits, None
        i = 0
        while i < len(self.paras):
            if not self.paras[i]["ad"]:
                i += 1
                continue
            first, last = self.grown(i)
            start, end = self.begins(first), self.ends(first, last)
            before = max((s["end"] for s in self.segs if s["end"] <= start + 0.01), default=0.0)
            after = next((s["start"] for s in self.segs if s["start"] >= end - 0.01), None)
            if start - before <= lim.edge:
                start = before + 0.3 if before else 0.0
            if after is not None and after - end <= lim.edge:
                end = max(end, after - 0.3)
            reads = sum(p["ad"] for p in self.paras[first : last + 1])
            if lim.shortest <= end - start <= (lim.longest_many if reads > 1 else lim.longest):
                if held and start - held[1] <= 1:
                    held = (held[0], max(held[1], end), held[2] + reads)
                else:
                    if held:
                        yield held
                    held = (start, end, reads)
            i = last + 1
        if held:
            yield held


def break_paragraphs(segments: DataFrame, key: str, minor: DataFrame | None = None, strong: tuple[str, ...] = fixed.STRONG_CUES, weak: tuple[str, ...] = fixed.WEAK_CUES) -> DataFrame:
    """The paragraphs of each episode with what the growing of breaks looks at; see ``Episode``. All by column functions."""
    numbered = segments.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).join(paragraphs(segments, key), [key, "seq"])
    text = F.col("text")
    cue = (tx.strong_cues(text, strong) > 0) | (tx.weak_cues(text, weak) > 0)
    seg = F.struct("seq", "start", "end", cue.alias("cue"), tx.opens_ad(text).alias("opener"), text.rlike(fixed.RESUMES).alias("back"), names_in(text).alias("names"), F.trim(text).alias("text"), "speaker")
    rows = numbered.groupBy(key, "paragraph").agg(F.array_sort(F.collect_list(seg)).alias("segs"))
    rows = rows.withColumn("text", F.array_join("segs.text", " "))
    speaker = F.get(F.filter("segs.speaker", lambda s: s.isNotNull()), 0)
    rows = rows.select(key, "paragraph", F.get("segs.start", 0).alias("start"), F.element_at("segs.end", -1).alias("end"), speaker.alias("speaker"), "text", "segs")
    rows = rows.withColumns({
        "ad": tx.is_ad(F.col("text"), strong, weak),
        "adish": tx.weak_cues(F.col("text"), weak) > 0,
        "back": F.col("text").rlike(fixed.RESUMES),
        "names": named_sentences(F.col("text"), strong, weak),
        "segs": F.transform("segs", lambda s: s.dropFields("text", "speaker", "seq")),
    })
    if minor is None:
        return rows.withColumn("minor", F.lit(False))
    passing = minor.select(F.col(key).alias("_k"), F.col("speaker").alias("_s")).distinct().withColumn("_m", F.lit(True))
    joined = rows.join(passing, (F.col(key) == F.col("_k")) & (F.col("speaker") == F.col("_s")), "left")
    return joined.withColumn("minor", F.coalesce("_m", F.lit(False))).drop("_k", "_s", "_m")


def ad_breaks(segments: DataFrame, key: str, minor: DataFrame | None = None, strong: tuple[str, ...] = fixed.STRONG_CUES, weak: tuple[str, ...] = fixed.WEAK_CUES, limits: Limits | None = None) -> DataFrame:
    """Breaks for sponsors: key, start, end (to tenths), reads.

    segments: key, seq, start, end, speaker, text, w; minor: key, speaker of voices heard in passing. A break grows from a
    read over further reads (nearer ones in other voices, farther ones in the same, farther still if what lies between
    names what is sold), a passing spot beside it, a sign-off and all that a voice says which is heard only there; it
    begins and ends inside paragraphs where cues and pauses say, and reaches out to the words on either side. Empty and
    null texts are left out; an episode without reads gives no rows. One episode is one group: hours of speech.
    """
    ship(segments.sparkSession)
    limits = limits or Limits()
    rows = break_paragraphs(segments, key, minor, strong, weak).drop("text")
    kind = rows.schema[key].dataType.simpleString()

    def fold(table: pa.Table) -> pa.Table:
        paras = sorted(table.to_pylist(), key=lambda p: p["paragraph"])
        found = list(Episode(paras, limits).breaks())
        keys = table[key].slice(0, 1).combine_chunks().take(pa.array([0] * len(found), pa.int64()))
        half_up = [[int(x * 10 + 0.5) / 10 for x in column] for column in ([b[0] for b in found], [b[1] for b in found])]
        return pa.table([keys, pa.array(half_up[0], pa.float64()), pa.array(half_up[1], pa.float64()), pa.array([b[2] for b in found], pa.int64())], names=[key, "start", "end", "reads"])

    return rows.groupBy(key).applyInArrow(fold, f"{key} {kind}, start double, end double, reads long")
