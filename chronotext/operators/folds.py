"""Folds whose next step depends on their own last answer; each key's rows are one group of bounded size (an episode)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotext.session import ship


def paragraphs(segments: DataFrame, key: str, soft: int = 150) -> DataFrame:
    """Add ``paragraph`` (from 0) to non-empty segments: key, seq, speaker, w, text.

    A new voice starts one; so does a new window after a finished sentence; from ``soft`` words on also the next sentence
    or window, and in any case 1.5 times as many words. An array fold, so it stays inside the JVM.
    """
    text = F.trim("text")
    item = F.struct("seq", "speaker", "w", text.alias("t"), F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")).alias("n"), text.rlike(r"[.!?…][\"'”’»)\]]*$").alias("ends"), text.rlike(r"^[\"'“‘«„¿¡(\[]*\p{Ll}").alias("lower"))
    rows = segments.filter(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    grouped = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("_s"))

    def step(a, s):  # noqa: ANN001, ANN202
        first = a["last"].isNull()
        voice = a["last"]["speaker"].isNotNull() & s["speaker"].isNotNull() & (a["last"]["speaker"] != s["speaker"])
        carries = s["lower"] | ~a["last"]["ends"]
        same = F.coalesce(a["last"]["w"] == s["w"], F.lit(False))
        long = a["count"] >= soft
        fresh = F.coalesce(first | voice | F.when(long, ~carries | ~same | (a["count"] >= soft * 1.5)).otherwise(~same & ~carries), F.lit(True))
        k = a["k"] + F.when(fresh, 1).otherwise(0)
        return F.struct(
            F.concat(a["out"], F.array(F.struct(s["seq"].alias("seq"), k.alias("paragraph")))).alias("out"),
            k.alias("k"),
            (F.when(fresh, 0).otherwise(a["count"]) + s["n"]).alias("count"),
            s.alias("last"),
        )

    kind = rows.select(item.alias("i")).schema["i"].dataType.simpleString()
    seq = dict(rows.dtypes)["seq"]
    zero = F.struct(F.array().cast(f"array<struct<seq:{seq},paragraph:int>>").alias("out"), F.lit(-1).alias("k"), F.lit(0).alias("count"), F.lit(None).cast(kind).alias("last"))
    return grouped.select(key, F.explode(F.aggregate("_s", zero, step)["out"]).alias("_p")).select(key, "_p.seq", "_p.paragraph")


def online_voices(prints: DataFrame, key: str, threshold: float = 0.5, cap: float = 30.0, shortest: float = 2.5) -> DataFrame:
    """Voices of prints in order: key, seq, voice. prints: key, seq, v (array), seconds.

    A print joins the voice it is most like if the cosine reaches ``threshold``, and moves that voice's mean; a shorter
    print never starts a voice, but joins one from 0.7 times the threshold on. Prints without a vector are left out.
    """
    ship(prints.sparkSession)
    prints = prints.filter(F.col("v").isNotNull())
    out = f"{key} {dict(prints.dtypes)[key]}, seq {dict(prints.dtypes)['seq']}, voice int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        centres, weights, found = [], [], []
        for v, weight in zip(rows["v"], rows["seconds"], strict=True):
            v = np.asarray(v, dtype=float)
            v = v / (np.linalg.norm(v) or 1)
            like = np.array([c @ v for c in centres])
            best = int(np.argmax(like)) if len(like) else -1
            if best >= 0 and like[best] >= threshold:
                mixed = centres[best] * min(weights[best], cap) + v * weight
                centres[best] = mixed / (np.linalg.norm(mixed) or 1)
                weights[best] += weight
            elif weight < shortest:
                best = best if best >= 0 and like[best] >= 0.7 * threshold else None
            else:
                best = len(centres)
                centres.append(v)
                weights.append(weight)
            found.append(best)
        return pd.DataFrame({key: rows[key], "seq": rows["seq"], "voice": pd.array(found, dtype="Int32")})

    return prints.groupBy(key).applyInPandas(run, out)


def window_cuts(frames: DataFrame, key: str, earliest: float = 18.0, latest: float = 29.5, frame: float = 0.1) -> DataFrame:
    """Where to cut a recording: after each cut the quietest frame between ``earliest`` and ``latest`` seconds on: key, n, cut.

    frames: key, at (seconds), e (energy).
    """
    out = f"{key} {dict(frames.dtypes)[key]}, n int, cut double"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        at, e = rows["at"].to_numpy(), rows["e"].to_numpy()
        end, start, cuts = at[-1] + frame, 0.0, []
        while end - start > latest:
            lo, hi = np.searchsorted(at, [start + earliest, start + latest - frame])
            start = float(at[lo + int(np.argmin(e[lo:hi]))] + frame / 2) if hi > lo else start + latest
            cuts.append(start)
        named = rows[[key]].iloc[[0] * len(cuts)].reset_index(drop=True)
        return named.assign(n=np.arange(len(cuts), dtype="int32"), cut=np.array(cuts, dtype=float))

    return frames.groupBy(key).applyInPandas(run, out)


def label_path(parts: DataFrame, talk: DataFrame, key: str, change: float = 0.8) -> DataFrame:
    """Speakers of text parts by the cheapest path: key, seq, speaker.

    parts: key, seq, start, end, text; talk: key, seq, voice, seconds (how long each voice talks in the part). A part
    costs its length times the share that others talk in; a change of voice costs ``change`` seconds, half after a
    question.
    """
    heard = talk.groupBy(key, "seq").agg(F.map_from_entries(F.collect_list(F.struct(F.col("voice").cast("string"), "seconds"))).alias("talk"))
    out = f"{key} {dict(parts.dtypes)[key]}, seq {dict(parts.dtypes)['seq']}, speaker int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        told = [dict(t) if t is not None else {} for t in rows["talk"]]
        voices = sorted({int(v) for t in told for v in t})
        if not voices:
            return pd.DataFrame({key: rows[key], "seq": rows["seq"], "speaker": pd.array([None] * len(rows), dtype="Int32")})
        lengths = (rows["end"] - rows["start"]).to_numpy()
        total = np.array([sum(t.values()) for t in told])
        share = np.array([[t.get(str(v), 0.0) for v in voices] for t in told]) / np.where(total, total, 1)[:, None]
        own = np.where(total[:, None] > 0, lengths[:, None] * (1 - share), 0)
        asked = np.r_[False, rows["text"].str.strip().str.contains(r"[?¿][\"”’)]?$").to_numpy()[:-1]]
        cost, back = own[0], []
        for i in range(1, len(rows)):
            step = np.full((len(voices), len(voices)), change / 2 if asked[i] else change)
            np.fill_diagonal(step, 0)
            through = cost[:, None] + step
            back.append(through.argmin(axis=0))
            cost = through.min(axis=0) + own[i]
        path = [int(cost.argmin())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return pd.DataFrame({key: rows[key], "seq": rows["seq"], "speaker": pd.array([voices[k] for k in reversed(path)], dtype="Int32")})

    return parts.join(heard, [key, "seq"], "left").groupBy(key).applyInPandas(run, out)


def collapse_loops(df: DataFrame, text: str, name: str, longest: int = 8) -> DataFrame:
    """Add ``name``: runs of one to ``longest`` words that repeat more than twice are cut to two copies."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: None if t is None else loops_out(t, longest))

    return df.withColumn(name, run(F.col(text)))


def loops_out(text: str, longest: int = 8) -> str:
    """The text with each run of a repeated unit cut to two copies; at each place the shortest unit counts.

    For each unit length one pass over the words' numbers says how far every word agrees with the word one unit later.
    """
    words = text.split()
    places = np.arange(len(words))
    names: dict[str, int] = {"": 0}
    ids = np.array([names.setdefault("".join(filter(str.isalnum, w.lower())), len(names)) for w in words], dtype=np.int64)
    period, reach = np.zeros(len(words), dtype=np.int64), np.ones(len(words), dtype=np.int64)
    for n in range(min(longest, len(words) // 3), 0, -1):
        breaks = np.append(np.flatnonzero((ids[:-n] != ids[n:]) | (ids[n:] == 0)), len(words) - n)
        agree = np.maximum(breaks[np.minimum(np.searchsorted(breaks, places), len(breaks) - 1)] - places, 0)
        looped = agree >= 2 * n
        period[looped], reach[looped] = n, (agree[looped] // n + 1) * n
    kept, at = [], 0
    while at < len(words):
        kept += words[at : at + max(1, 2 * period[at])]
        at += int(reach[at])
    return " ".join(kept)


def clusters(prints: DataFrame, key: str, threshold: float = 0.5) -> DataFrame:
    """Average-link clusters of a key's vectors (key, seq, v): key, seq, cluster (smallest seq of its cluster). Null vectors
    are left out."""
    prints = prints.filter(F.col("v").isNotNull())
    out = f"{key} {dict(prints.dtypes)[key]}, seq {dict(prints.dtypes)['seq']}, cluster {dict(prints.dtypes)['seq']}"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        x = np.stack([np.asarray(v, dtype=float) for v in rows["v"]])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        like = x @ x.T
        groups = [[i] for i in range(len(x))]
        np.fill_diagonal(like, -np.inf)
        size = np.ones(len(x))
        while len(groups) > 1:
            a, b = sorted(divmod(int(np.argmax(like)), len(like)))
            if like[a, b] < threshold:
                break
            like[a] = (like[a] * size[a] + like[b] * size[b]) / (size[a] + size[b])
            like[:, a] = like[a]
            like[a, a] = -np.inf
            like = np.delete(np.delete(like, b, 0), b, 1)
            size[a] += size[b]
            size = np.delete(size, b)
            groups[a] += groups.pop(b)
        seqs = rows["seq"].to_numpy()
        found = np.empty(len(x), dtype=seqs.dtype)
        for g in groups:
            found[g] = seqs[g].min()
        return pd.DataFrame({key: rows[key], "seq": seqs, "cluster": found})

    return prints.groupBy(key).applyInPandas(run, out)
