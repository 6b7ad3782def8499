"""Search for words and phrases that are said close together.

A query is parsed on the driver. Episodes that lack a term fall away in a filter on their folded text; only for those
that are left are the places of all terms found and the shortest runs of at most three segments chosen.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.functions import fixed
from chronotext.functions.text import clean, fold
from chronotext.operators.records import top_per
from chronotext.session import ship

MAX_TERMS, MAX_QUERY, SPAN, MAX_HITS, MAX_EPISODES = 8, 200, 3, 5, 30


@dataclass(frozen=True)
class Term:
    text: str
    exact: bool

    @property
    def pattern(self) -> str:
        body = r"[^\p{L}\p{N}]{1,4}".join(map(re.escape, self.text.split(" ")))
        return rf"(?<![\p{{L}}\p{{N}}]){body}" + (r"(?![\p{L}\p{N}])" if self.exact else r"[\p{L}\p{N}]*")


def fold_query(text: str) -> str:
    """The fold of the segments, for the query string."""
    out = []
    for c in text.lower():
        bare = c if c in "æøå" else "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        out.append(" " if c.isspace() else "'" if c in "‘’ʼ′`" else '"' if c in "“”„«»" else bare if len(bare) == 1 else c)
    return "".join(out)


def parse_query(text: str) -> list[Term]:
    """Terms of a query: quoted phrases, and words. Phrases and words under three letters match whole, others as a prefix."""
    terms: list[Term] = []
    for quoted, bare in re.findall(fixed.QUERY_PART, fold_query(text[:MAX_QUERY])):
        found = [w for w in regex.split(fixed.NO_WORD, quoted or bare) if w]
        term = " ".join(found)
        if term and term not in {t.text for t in terms} and len(terms) < MAX_TERMS:
            terms.append(Term(term, bool(quoted) or len(found) > 1 or len(term) < 3))
    return terms


def runs_of(lines: list[str], patterns: list[regex.Pattern]) -> tuple[int, list[tuple[int, int, list[tuple[int, int]]]]]:
    """How many runs of segments hold every pattern, and the shortest of them with the places to mark.

    Runs end where some match ends, take the latest match of each pattern up to there, and do not overlap.
    """
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    text = " ".join(lines)
    where = pd.Series(range(len(lines)), index=starts)
    segment = lambda p: int(where.iloc[where.index.searchsorted(p, side="right") - 1])
    places = [[(m.start(), m.end(), segment(m.start()), segment(m.end() - 1)) for m in p.finditer(text)] for p in patterns]
    runs, last = [], -1
    for end in sorted({x[3] for p in places for x in p}):
        latest = [max((x for x in p if x[3] <= end), default=None) for p in places]
        if None in latest:
            continue
        begin = min([end, *(x[2] for x in latest)])
        if end - begin < SPAN and begin > last:
            runs.append((begin, end))
            last = end
    best = sorted(sorted(runs, key=lambda r: (r[1] - r[0], r[0]))[:MAX_HITS])
    hits = []
    for begin, end in best:
        low, high = starts[begin], starts[end] + len(lines[end])
        marks: list[list[int]] = []
        for a, b in sorted((x[0] - low, x[1] - low) for p in places for x in p if x[0] >= low and x[1] <= high):
            if marks and a <= marks[-1][1]:
                marks[-1][1] = max(marks[-1][1], b)
            else:
                marks.append([a, b])
        hits.append((begin, end, [tuple(m) for m in marks]))
    return len(runs), hits


def search(segments: DataFrame, query: str, key: str = "episode_id") -> DataFrame:
    """Hits of a query: key, runs, hit, from_seq, to_seq, marks (0-based code point ranges of the run's folded text).

    segments: key, seq, text. An episode gives at most MAX_HITS hits, in the order they are said. An empty query finds
    nothing; null texts count as empty, and segments without a key belong to no episode.
    """
    ship(segments.sparkSession)
    terms = parse_query(query)
    lines = segments.filter(F.col(key).isNotNull()).select(key, "seq", fold(clean(F.coalesce("text", F.lit("")))).alias("_line"))
    holds = F.lit(bool(terms))
    for t in terms:
        holds &= F.col("_whole").rlike(t.pattern)
    episodes = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "_line"))).alias("_s"))
    left = episodes.withColumn("_whole", F.array_join(F.col("_s._line"), " ")).filter(holds).select(key, F.explode("_s").alias("_s")).select(key, "_s.seq", "_s._line")
    seq = dict(segments.dtypes)["seq"]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        count, hits = runs_of(list(rows["_line"]), [regex.compile(t.pattern) for t in terms])
        seqs = rows["seq"].tolist()
        out = [(rows[key].iloc[0], count, k, seqs[a], seqs[b], [{"a": x, "b": y} for x, y in marks]) for k, (a, b, marks) in enumerate(hits)]
        return pd.DataFrame(out, columns=[key, "runs", "hit", "from_seq", "to_seq", "marks"])

    return left.groupBy(key).applyInPandas(run, f"{key} {dict(segments.dtypes)[key]}, runs int, hit int, from_seq {seq}, to_seq {seq}, marks array<struct<a:int,b:int>>")


def listed(hits: DataFrame, newest: DataFrame, key: str = "episode_id", at: str = "created_at", most: int = MAX_EPISODES) -> DataFrame:
    """Hits of the ``most`` newest episodes; newest: key, at. The rest is rest_count()'s."""
    episodes = hits.select(key).distinct().join(newest.select(key, at), key)
    shown = episodes.orderBy(F.desc(at), key).limit(most)
    return hits.join(F.broadcast(shown), key)


def rest_count(hits: DataFrame, most: int = MAX_EPISODES, key: str = "episode_id") -> DataFrame:
    """One row: how many episodes have hits, and how many are not listed."""
    return hits.agg(F.count_distinct(key).alias("episodes")).withColumn("rest", F.greatest(F.col("episodes") - most, F.lit(0)))


def word_hits(segments: DataFrame, word: str, key: str = "episode_id") -> DataFrame:
    """Search for one word without Python: a run is a segment that has it; key, runs, hit, seq of the first MAX_HITS."""
    pattern = parse_query(word)[0].pattern
    found = segments.filter(fold(clean(F.col("text"))).rlike(pattern)).select(key, "seq")
    counted = found.groupBy(key).agg(F.count(F.lit(1)).alias("runs"))
    return top_per(found, [key], [F.col("seq")], MAX_HITS, "hit").withColumn("hit", F.col("hit") - 1).join(counted, key)
