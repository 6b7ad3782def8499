"""Quality rules: plain text statistics, and robust multivariate outliers among them.

Statistics become transformed vectors. For each language and source a minimum-covariance-determinant estimate gives the
centre and spread of the undisturbed majority: concentration steps take the three quarters of the rows that lie nearest
to the current estimate and estimate again, until the determinant falls no more, from several starts, of which the least
determinant wins. Every step is an aggregation of sums and quantile sketches over all rows; a group's estimate from one
start is a row of a table, never a group of rows in one task. A document is rejected whose squared Mahalanobis distance
from its group's centre exceeds a chi-square quantile, if it lies on the worse side of that centre: only then do its
statistics, each in units of its spread, add up to more than the centre's.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotext.llm.common import arrow_map, durable, prepare, sized, spread

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
COUNTED = (*STATS, "n_lines")
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The vector's parts, each the larger the worse, with the least spread each is granted: a statistic that is zero in
#: nearly all documents must not turn a single symbol or a single repeated line into an outlier. Beside an undisturbed
#: majority without spread, cutoff(0.99999) lets each part reject alone: from about 2.7 % symbols, 50 % repeated lines,
#: 36 % repeated words, or words 2.3 times as long as usual.
PARTS = {"symbols": 0.03, "dup_lines": 0.13, "repeats": 0.11, "long_words": 0.15}
WIDTH = len(PARTS)


def repeated_words(ids: np.ndarray) -> int:
    """Words that lie in a 3-word window which occurs twice or more (all its occurrences count)."""
    if len(ids) < 4:
        return 0
    words = int(ids.max()) + 1
    if words < 1 << 20:
        key = (ids[:-2] * words + ids[1:-1]) * words + ids[2:]
    else:
        pair = np.unique(ids[:-2] * words + ids[1:-1], return_inverse=True)[1]
        key = pair * words + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for shift in range(3):
        covered[shift : shift + len(key)] |= twice
    return int(covered.sum())


def counted(text: str | None) -> tuple[int, int, int, int, int, int]:
    """COUNTED of a whole text; all zero for null. Words lie between space and the characters 9 to 13."""
    body = (text or "").encode("utf-8", "surrogatepass")
    words = body.split()
    if not words:
        return 0, 0, len(body) - len(body.translate(None, SYMBOLS)), 0, 0, 0
    joined = b"".join(words)
    points = len(joined) - len(joined.translate(None, bytes(set(range(256)) - set(range(0x80, 0xC0)))))
    lines = [line for line in body.split(b"\n") if line.strip(b" \t\r\v\f")]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), dtype=np.int64, count=len(words))
    return len(words), points, len(body) - len(body.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids), len(lines)


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    """STATS of a whole text."""
    return counted(text)[: len(STATS)]


STRUCT = T.StructType([T.StructField(n, T.LongType()) for n in COUNTED])


def stats_column(text: str) -> Column:
    """COUNTED as a struct column, computed in Arrow batches.

    Declared as not deterministic, though it is, so that Spark neither copies it into filters nor runs it twice.
    """

    @F.pandas_udf(STRUCT)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counted(t) for t in texts], columns=list(COUNTED), dtype="int64")

    return run.asNondeterministic()(F.col(text))


def failed(s: str = "") -> Column:
    return (F.col(f"{s}n_words") < MIN_WORDS) | (100 * F.col(f"{s}n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{s}n_words"))


def vector(s: str = "") -> list[Column]:
    """Transformed statistics: square roots of shares tame their long tails, a logarithm the length of words."""
    words = F.greatest(F.col(f"{s}n_words"), F.lit(1))
    return [
        F.sqrt(F.col(f"{s}n_symbols") / F.greatest(F.col(f"{s}word_chars"), F.lit(1))),
        F.sqrt(F.col(f"{s}n_dup_lines") / F.greatest(F.col(f"{s}n_lines"), F.lit(1))),
        F.sqrt(F.col(f"{s}n_repeat_words") / words),
        F.log(F.greatest(F.col(f"{s}word_chars"), F.lit(1)) / words),
    ]


def chi_square(x: float, width: int) -> float:
    """The distribution function of chi-square for an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(width // 2))


def cutoff(share: float) -> float:
    """The chi-square quantile of WIDTH degrees of freedom, by halving."""
    low, high = 0.0, 1000.0
    while high - low > 1e-9:
        low, high = ((low + high) / 2, high) if chi_square((low + high) / 2, WIDTH) < share else (low, (low + high) / 2)
    return high


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal rows is to be multiplied by to be that of all of them."""
    return share / chi_square(cutoff(share), WIDTH + 2)


FIELDS = [f"x{i}" for i in range(WIDTH)]
PAIRS = [(i, j) for i in range(WIDTH) for j in range(i, WIDTH)]
PRECISION = [f"p{i}{j}" for i, j in PAIRS]
GROUP = ["_lang", "_source"]


def squared_distance() -> Column:
    """Mahalanobis distance squared from columns x*, c*, p**."""
    d = [F.col(f"x{i}") - F.col(f"c{i}") for i in range(WIDTH)]
    terms = [(1 if i == j else 2) * F.col(f"p{i}{j}") * d[i] * d[j] for i, j in PAIRS]
    return sum(terms[1:], terms[0])


def worse() -> Column:
    """Whether the deviations from the centre, each in units of its spread, add up to more than zero; columns x*, c*, v**."""
    terms = [(F.col(f"x{i}") - F.col(f"c{i}")) / F.sqrt(F.col(f"v{i}{i}") + least**2) for i, least in enumerate(PARTS.values())]
    return sum(terms[1:], terms[0]) > 0


CENTRE = [f"c{i}" for i in range(WIDTH)]
SPREAD = [f"v{i}{j}" for i, j in PAIRS]
#: Starts beside the medians: the moments of all rows, and of three small draws.
DRAWS, DRAWN = 3, 10


def matrices(rows: dict[str, list], prefix: str) -> np.ndarray:
    """The symmetric matrices of a batch from the columns of their upper triangles."""
    out = np.zeros((len(rows["_n"]), WIDTH, WIDTH))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = rows[f"{prefix}{i}{j}"]
    return out


def with_precision(model: DataFrame, keys: list[str]) -> DataFrame:
    """keys, _n, c*, v**, p**, _det from centres and covariances: the floors are added, p** is the inverse, _det the
    determinant's logarithm."""
    floor = np.diag(np.array(list(PARTS.values())) ** 2)
    names = [*CENTRE, *SPREAD, *PRECISION, "_det"]
    kinds = {f.name: f.dataType for f in model.schema.fields}
    schema = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("_n", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.to_pydict()
            cov = matrices(rows, "v") + floor
            inverse = np.linalg.inv(cov)
            new = {f"p{i}{j}": inverse[:, i, j] for i, j in PAIRS} | {"_det": np.linalg.slogdet(cov)[1]}
            columns = [*keys, "_n", *CENTRE, *SPREAD]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns] + [pa.array(new[n], pa.float64()) for n in (*PRECISION, "_det")]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, *PRECISION, "_det"])

    return arrow_map(model.select(*keys, "_n", *CENTRE, *SPREAD), run, schema)


def moments() -> list[Column]:
    return [*(F.avg(f).alias(f"c{i}") for i, f in enumerate(FIELDS)), *(F.avg(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS)]


def covariances(table: DataFrame, factor: float = 1.0) -> DataFrame:
    """v** from the second moments s** and the centres."""
    least = {(i, j): F.greatest(F.lit(0.0), F.col(f"s{i}{j}") - F.col(f"c{i}") * F.col(f"c{j}")) if i == j else F.col(f"s{i}{j}") - F.col(f"c{i}") * F.col(f"c{j}") for i, j in PAIRS}
    return table.withColumns({f"v{i}{j}": least[i, j] * factor for i, j in PAIRS})


def starts(held: DataFrame) -> DataFrame:
    """First estimates of each group: _start 0 by coordinates' medians and their spreads by the median distance from
    them, 1 by the moments of all its rows, the others by those of about DRAWN rows. held: GROUP, _n, x*."""
    middle = durable(held.groupBy(*GROUP).agg(F.first("_n").alias("_n"), *(F.percentile_approx(f, 0.5, 1000).alias(f"c{i}") for i, f in enumerate(FIELDS))), "rule-medians")
    off = held.join(sized(middle.drop("_n"), 50_000), GROUP).groupBy(*GROUP).agg(*(F.percentile_approx(F.abs(F.col(f) - F.col(f"c{i}")), 0.5, 1000).alias(f"d{i}") for i, f in enumerate(FIELDS)))
    zero = {f"v{i}{j}": F.pow(1.4826 * F.col(f"d{i}"), 2) if i == j else F.lit(0.0) for i, j in PAIRS}
    first = middle.join(off, GROUP).withColumn("_start", F.lit(0)).withColumns(zero)
    place = [F.pmod(F.xxhash64(*FIELDS, F.lit(k)), F.lit(1 << 30)) * F.col("_n") < F.lit(DRAWN << 30) for k in range(DRAWS)]
    lots = F.filter(F.array(F.lit(1), *(F.when(p, F.lit(k + 2)) for k, p in enumerate(place))), lambda k: k.isNotNull())
    drawn = covariances(held.select("*", F.explode(lots).alias("_start")).groupBy(*GROUP, "_start").agg(F.first("_n").alias("_n"), *moments()))
    columns = [*GROUP, "_start", "_n", *CENTRE, *SPREAD]
    return first.select(columns).unionByName(drawn.select(columns))


def fit(rows: DataFrame, share: float = 0.75, fall: float = 0.001) -> DataFrame:
    """Estimates for each language and source: _lang, _source, _n, c*, v**, p**. rows: durable, GROUP and x*.

    Concentration steps go on from every start while they lower the determinant's logarithm by more than ``fall``; of the
    starts, the one with the least determinant stays. It is bounded below by the floors, so the steps end.
    Every group has an estimate, however small, and so have each language and all rows (_source, or _lang and _source, of
    one null character); shrunken() weighs them. A row counts at each of these levels.
    """
    levels = F.explode(F.array(F.struct("_lang", "_source"), F.struct(F.col("_lang"), F.lit("\x00").alias("_source")), F.struct(F.lit("\x00").alias("_lang"), F.lit("\x00").alias("_source"))))
    wide = rows.select(levels.alias("_g"), *FIELDS).select("_g.*", *FIELDS)
    sizes = durable(wide.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n")), "rule-groups")
    held = wide.join(sized(sizes, 50_000), GROUP)
    keys = [*GROUP, "_start"]

    def step(model: DataFrame) -> DataFrame:
        near = held.drop("_n").join(sized(model.select(*keys, "_n", *CENTRE, *PRECISION), 50_000), GROUP).withColumn("_d", squared_distance())
        limit = sized(durable(near.groupBy(*keys).agg(F.percentile_approx("_d", share, 2000).alias("_limit")), "rule-limits"), 50_000)
        core = near.join(limit, keys).filter("_d <= _limit").groupBy(*keys).agg(F.first("_n").alias("_n"), *moments())
        return durable(with_precision(covariances(core, consistency(share)), keys), "rule-model")

    # Starts differ in how many rows they count, so determinants are compared from the first step on.
    active = step(durable(with_precision(starts(held), keys), "rule-model"))
    ended = []
    while True:
        after = step(active)
        both = active.join(after.select(*keys, F.col("_det").alias("_after")), keys)
        still = F.col("_after") < F.col("_det") - fall
        ended.append(durable(both.filter(~still).drop("_after"), "rule-ended"))
        active = durable(after.join(both.filter(still).select(*keys), keys, "left_semi"), "rule-active")
        if active.isEmpty():
            break
    every = ended[0]
    for more in ended[1:]:
        every = every.unionByName(more)
    best = every.groupBy(*GROUP).agg(F.min_by(F.struct("_n", *CENTRE, *SPREAD, *PRECISION), F.struct("_det", "_start")).alias("_best"))
    return durable(best.select(*GROUP, "_best.*"), "rule-best")


def shrunken(model: DataFrame, halfway: float = 50.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Estimates of the groups, the languages and all rows, each but the last shrunk towards the wider one.

    A centre and covariance of n rows has the weight n / (n + ``halfway``), the wider level's the rest, so that an
    estimate moves smoothly with n; a group without rows would have its language's.
    """
    values = [*CENTRE, *SPREAD]
    whole = F.col("_lang") == "\x00"
    any_source = ~whole & (F.col("_source") == "\x00")
    own_share = F.col("_n") / (F.col("_n") + halfway)

    def mixed(narrow: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
        both = narrow.join(wide.select(*keys, *(F.col(v).alias(f"_{v}") for v in values)), keys) if keys else narrow.crossJoin(F.broadcast(wide.select(*(F.col(v).alias(f"_{v}") for v in values))))
        return both.select("_lang", "_source", "_n", *((own_share * F.col(v) + (1 - own_share) * F.col(f"_{v}")).alias(v) for v in values))

    every = model.filter(whole)  # one row
    language = durable(with_precision(mixed(model.filter(any_source), every, []), GROUP), "rule-languages")
    own = durable(with_precision(mixed(model.filter(~whole & ~any_source), sized(language, 50_000), ["_lang"]), GROUP), "rule-own")
    return own, language, every


def judged(rows: DataFrame, model: DataFrame, sure: float) -> DataFrame:
    """Add _outlier, distance (squared) and group_rows to rows with GROUP and x*, by their group's shrunken estimate; where
    no row of the group was estimated (group_rows null), by its language's, which is then the whole weight."""
    groups, languages, everything = shrunken(model)
    estimate_of = F.struct(*CENTRE, *(f"v{i}{i}" for i in range(WIDTH)), *PRECISION)
    own = groups.select(F.col("_lang").alias("_l"), F.col("_source").alias("_o"), F.col("_n").alias("group_rows"), estimate_of.alias("_m1"))
    language = languages.select(F.col("_lang").alias("_l"), estimate_of.alias("_m2"))
    every = everything.select(F.lit(1).alias("_one"), estimate_of.alias("_m3"))
    out = rows.join(sized(own, 50_000), (F.col("_lang") == F.col("_l")) & (F.col("_source") == F.col("_o")), "left").drop("_l", "_o")
    out = out.join(sized(language, 50_000), F.col("_lang") == F.col("_l"), "left").drop("_l")
    out = out.withColumn("_one", F.lit(1)).join(F.broadcast(every), "_one", "left")  # one row
    out = out.withColumn("_m", F.coalesce("_m1", "_m2", "_m3")).select(*rows.columns, "group_rows", "_m.*").withColumn("distance", squared_distance())
    far = (F.col("distance") > cutoff(sure)) & worse()
    return out.withColumn("_outlier", F.coalesce(far, F.lit(False))).select(*rows.columns, "_outlier", "distance", "group_rows")


def vectors(counted: DataFrame, s: str = "") -> DataFrame:
    return counted.withColumns(dict(zip(FIELDS, vector(s), strict=True)))


def group_columns(lang: str, source: str) -> list[Column]:
    return [F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source")]


def measured(docs: DataFrame, named: list[Column], text: str, lang: str, source: str) -> DataFrame:
    """``named`` columns, GROUP, COUNTED and x* of each row: a durable table, so that texts are read and counted once."""
    prepare(docs.sparkSession)
    narrow = docs.select(*named, *group_columns(lang, source), stats_column(text).alias("_s"))
    return durable(vectors(narrow.select("*", "_s.*").drop("_s")), "rule-rows")


def quality_rules(docs: DataFrame, sure: float = 0.99999, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row of ``docs``: key, STATS, base_failed, kept, distance (squared), group_rows.

    kept is false where the plain rules fail (fewer than MIN_WORDS words, or more than MAX_REPEAT_PERCENT % of them in
    repeated windows) or where the squared distance of the vector of transformed statistics from its group's centre
    exceeds the chi-square quantile ``sure`` on the worse side (see worse). group_rows is how many rows the group's own
    estimate counts (null: none passed the plain rules, its language's estimate judges). Null text counts as empty
    (fails); null language or source is a group of its own. Estimates use the documents that pass the plain rules; with
    none of them nothing is an outlier and distance is null. Repeated rows each count; an empty table gives no rows;
    other columns are not read.
    """
    rows = measured(spread(docs.select(F.col(key).alias("_key"), text, lang, source)), [F.col("_key")], text, lang, source)
    model = fit(rows.filter(~failed()).select(*GROUP, *FIELDS))
    out = judged(rows.withColumn("base_failed", failed()), model, sure)
    return out.select(F.col("_key").alias(key), *STATS, "base_failed", (~F.col("base_failed") & ~F.col("_outlier")).alias("kept"), "distance", "group_rows")


def keep_good(docs: DataFrame, sure: float = 0.99999, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of ``docs`` that quality_rules keeps, with their columns as they are.

    Rows equal in key, text, language and source stay or go together; null keys are told apart by the rest; an empty
    table stays empty. Only the rows to drop, by hashes, meet the texts again.
    """
    named = [F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_k"), F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in (text, lang, source))).alias("_b")]
    rows = measured(spread(docs.select(*dict.fromkeys((key, text, lang, source)))), named, text, lang, source)
    model = fit(rows.filter(~failed()).select(*GROUP, *FIELDS))
    out = judged(rows, model, sure).filter(failed() | F.col("_outlier"))
    dropped = durable(out.select("_k", "_b").distinct(), "rule-dropped")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *named)
    return whole.join(sized(dropped, 500_000), ["_k", "_b"], "left_anti").select("_row.*")
