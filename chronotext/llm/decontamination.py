"""Benchmark decontamination by templates: finds benchmark items in documents, also with numbers, names or units changed.

Texts become tokens in which numbers, names and units carry a mark of their type; without its value such a token is a
typed placeholder. Every window of an item is indexed and every window of a document is looked up. A window is known by
its words, whatever their case, and where it has enough plain tokens also by its template: a row of placeholders alone
says nothing. Documents with a hit are then aligned in full: windows that lie on one diagonal of document and item, or a
few tokens beside it, count together. The longest stretch of covered tokens decides whose slots map the item's values to
the document's consistently, so more text of an item never loses a pair. Every diagonal is tested and the best is
reported. All steps are DataFrame expressions; exact positions and words are compared after the hash join, so hash
collisions cannot pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chronotext.llm.common import durable, sized, spread

#: Private characters that mark a token's type.
NUMBER, NAME, UNIT = "\ue000", "\ue001", "\ue002"
MARKS = f"{NUMBER}{NAME}{UNIT}"
#: Unit words that count as a unit directly after a number.
UNITS = "km|m|cm|mm|mi|miles?|ft|feet|inch(?:es)?|kg|g|mg|lbs?|oz|pounds?|tons?|l|ml|cl|liters?|litres?|gallons?|s|sec|seconds?|min|minutes?|h|hrs?|hours?|days?|weeks?|months?|years?|dollars?|cents?|euros?|usd|eur|percent|degrees?|mph|kmh|kw|kwh|w|v|hz|mb|gb|tb"
#: Words that often begin a sentence and are no names (English, German, French, Spanish).
OPENERS = (
    "The|An|This|That|These|Those|There|What|Which|Who|Whose|Whom|When|Where|Why|How|If|In|On|At|By|For|From|To|Of|And|Or|But|So|As|It|Its|He|She|They|We|You|"
    "His|Her|Their|Our|My|Your|Is|Are|Was|Were|Do|Does|Did|Can|Could|Will|Would|Should|May|Let|Find|Given|Each|Every|All|Some|Then|After|Before|During|While|"
    "Der|Die|Das|Ein|Eine|Und|Wie|Was|Wer|Wo|Wenn|Es|Er|Sie|Wir|Im|Am|Zu|Le|La|Les|Un|Une|Des|Du|Et|Il|Elle|Ils|Nous|Vous|Que|Qui|Quel|Quelle|Dans|"
    "El|Los|Las|Una|De|En|Y|Si|Se|Con|Por|Para|Como"
)
#: Possessive, so that long runs of figures are passed in one step.
VALUE = r"\p{N}++(?:[.,]\p{N}++)*+"


def tokens(text: Column) -> Column:
    """Tokens of a text, lower-cased; numbers, names and units begin with their mark.

    A name is a capitalised word, wherever it stands, unless it is one of OPENERS, so a passage has the same tokens
    whatever is around it. A unit follows a number directly.
    """
    out = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?i)(?=\p{{N}})(?<!\p{{N}}[.,]?)({VALUE}\s?)((?:{UNITS})(?![\p{{L}}\p{{M}}\p{{N}}]))", f"$1{UNIT}$2")
    out = F.regexp_replace(out, VALUE, f"{NUMBER}$0")
    out = F.regexp_replace(out, rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{M}}{UNIT}])(?!(?:{OPENERS})(?![\p{{L}}\p{{M}}]))\p{{Lu}}[\p{{Ll}}\p{{M}}]++(?!\p{{L}})", f"{NAME}$0")
    return F.regexp_extract_all(F.lower(out), F.lit(rf"{NUMBER}{VALUE}|[{NAME}{UNIT}]?[\p{{L}}\p{{M}}]+"), F.lit(0))


def is_slot(token: Column) -> Column:
    return F.left(token, F.lit(1)).isin(*MARKS)


def templates(values: str) -> Column:
    """The tokens without the values of their slots."""
    return F.transform(values, lambda v: F.when(is_slot(v), F.left(v, F.lit(1))).otherwise(v))


def word(token: Column) -> Column:
    """The token without its mark."""
    return F.when(is_slot(token), F.substr(token, F.lit(2))).otherwise(token)


def words(values: str) -> Column:
    return F.transform(values, word)


def hashed(df: DataFrame, values: str, sizes: list[int]) -> DataFrame:
    """Replace the tokens ``values`` by ``_h``, the hashes of their windows of all ``sizes``, with no places: those of the
    templates, and those of the words where these differ.

    A window's hash is made of its halves' hashes, so that each takes few steps; sizes may be up to 15. Read ``_h`` with
    explode_outer: for explode, Spark infers a filter on the array's size and makes the array once more for it.
    """
    rest = [c for c in df.columns if c != values]
    marked = lambda v: F.xxhash64(F.when(is_slot(v), F.left(v, F.lit(1))).otherwise(v))
    out = df.select(*rest, F.transform(values, marked).alias("_t1"), F.transform(values, lambda v: F.xxhash64(word(v))).alias("_w1"))
    from_ = lambda p, at, n: F.slice(p, F.lit(at + 1), F.greatest(n, F.lit(0)))
    both = lambda a, b: F.xxhash64(a, b)
    powers = [k for k in (1, 2, 4, 8) if k <= max(sizes)]
    for k in powers[1:]:
        n = F.size("_t1") - k + 1
        out = out.select("*", *[F.zip_with(from_(f"_{p}{k // 2}", 0, n), from_(f"_{p}{k // 2}", k // 2, n), both).alias(f"_{p}{k}") for p in "tw"])
    made = {"t": [], "w": []}
    for size in sizes:
        for p in made:
            n, at, whole = F.size("_t1") - size + 1, 0, None
            for k in [k for k in reversed(powers) if size & k]:
                part = from_(f"_{p}{k}", at, n)
                whole, at = part if whole is None else F.zip_with(whole, part, both), at + k
            made[p].append(whole)
    out = out.select(*rest, F.concat(*made["t"]).alias("_t"), F.concat(*made["w"]).alias("_w"))
    other = F.filter(F.zip_with("_t", "_w", lambda t, w: F.when(t != w, w)), lambda w: w.isNotNull())
    return out.select(*rest, F.concat("_t", other).alias("_h"))


def windows(tokens: str, size: int) -> Column:
    """Array of (at, n, hash) of all windows of ``size`` tokens; empty for shorter texts."""
    last = F.size(tokens) - size
    each = F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.lit(size).alias("n"), F.xxhash64(F.slice(F.col(tokens), i + 1, size)).alias("hash")))
    return F.when(last >= 0, each).otherwise(F.array().cast("array<struct<at:int,n:int,hash:bigint>>"))


def known_by(templates: str, words: str, size: int, least: int) -> Column:
    """windows() by template where ``least`` tokens are plain, and by words where some token is a slot."""
    plain = lambda w: F.size(F.filter(F.slice(F.col(templates), w["at"] + 1, size), lambda t: ~is_slot(t)))
    by_words = lambda w: F.struct(w["at"].alias("at"), w["n"].alias("n"), F.xxhash64(F.slice(F.col(words), w["at"] + 1, size)).alias("hash"))
    return F.concat(F.filter(windows(templates, size), lambda w: plain(w) >= min(least, size)), F.transform(F.filter(windows(templates, size), lambda w: plain(w) < size), by_words))


def consistent(slots: Column, agree: float) -> Column:
    """Whether at least ``agree`` of the distinct item values of ``slots`` (mark, iv, dv) meet one document value each,
    and names no other name's.
    """
    pairs = F.array_distinct(F.transform(slots, lambda s: F.struct(s["mark"].alias("mark"), s["iv"].alias("iv"), s["dv"].alias("dv"))))
    clash = lambda a, b: (a["mark"] == b["mark"]) & (((a["iv"] == b["iv"]) & (a["dv"] != b["dv"])) | ((a["mark"] == NAME) & (a["iv"] != b["iv"]) & (a["dv"] == b["dv"])))
    values = lambda ps: F.size(F.array_distinct(F.transform(ps, lambda p: F.struct(p["mark"], p["iv"]))))
    single = lambda ps: F.size(F.filter(ps, lambda p: ~F.exists(ps, lambda q: clash(p, q))))
    return F.get(F.transform(F.array(pairs), lambda ps: single(ps) >= agree * values(ps)), F.lit(0))


def best_stretch(slots: str, n: str, need: Column, agree: float) -> Column:
    """The longest stretch of at least ``need`` of the ``n`` covered tokens whose slots are consistent, as (n, i, j): its
    slots are those from ``i`` to before ``j``; of equally long ones the last. n is 0 where there is none.

    slots: array of (k, mark, iv, dv), k counting the covered tokens. Stretches reach from slot to slot, since plain
    tokens never spoil one; they are tried from the longest, so that only bands that need it pay for more than one.
    """
    s, k = F.col(slots), lambda i: F.get(F.col(slots), i)["k"]
    one = lambda i, j: F.struct((F.coalesce(k(j), F.col(n)) - F.when(i == 0, F.lit(0)).otherwise(k(i - 1) + 1)).cast("int").alias("n"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.transform(F.sequence(i, F.size(s)), lambda j: one(i, j))))
    tried = F.sort_array(F.filter(every, lambda x: (x["n"] >= need) & (x["n"] > 0)), asc=False)
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    whole = F.struct(F.col(n).cast("int").alias("n"), F.lit(0).alias("i"), F.size(s).alias("j"))
    ok = lambda x: consistent(F.slice(F.col(slots), x["i"] + 1, x["j"] - x["i"]), agree)
    longest = F.aggregate(tried, none, lambda best, x: F.when(best["n"] > 0, best).when(ok(x), x).otherwise(best))
    return F.when(consistent(s, agree), whole).otherwise(longest)


def items_of(benchmark: DataFrame, key: str, text: str) -> DataFrame:
    """_item, _class (of equal template and equal pattern of equal slot values), _it, _iw, _iv (templates, words and values), _all (hash of the words)."""
    rows = benchmark.filter(F.col(text).isNotNull()).select(F.col(key).alias("_item"), tokens(F.col(text)).alias("_iv"))
    rows = rows.withColumns({"_it": templates("_iv"), "_iw": words("_iv")})
    pattern = F.transform("_iv", lambda v: F.when(is_slot(v), F.array_position(F.col("_iv"), v)).otherwise(F.lit(0)).cast("string"))
    return rows.withColumns({"_class": F.sha1(F.concat_ws(" ", F.col("_it"), pattern)), "_all": F.xxhash64("_iw")})


def members(benchmark: DataFrame, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item, class_item: which items contaminated() treats as one class, each named by its smallest item; null texts have none."""
    rows = items_of(benchmark, item, item_text)
    first = rows.groupBy("_class").agg(F.min("_item").alias("class_item"))
    return rows.join(first, "_class").select(F.col("_item").alias(item), "class_item")


def text_key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("string"), F.lit(""))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 8, literals: int = 4, least: int = 13, share: float = 0.8, agree: float = 0.75, drift: int = 3, shortest: int = 3,
    key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Pairs of a document and an item that it holds: key, item, matched_tokens, item_tokens, n_slots, reparameterised,
    n_items, _body.

    The windows on a diagonal and on those up to ``drift`` tokens beside it (words put in or left out) cover tokens of
    the item; a pair counts if a stretch of ``least`` of these, or of ``share`` of a shorter item, is consistent: at
    least ``agree`` of the item's distinct slot values there meet a single document value each, and names no other
    name's (two numbers may become one). The longest such stretch of any diagonal is matched_tokens, and n_slots its
    slots. A window with fewer than ``literals`` plain tokens must agree in its words; words agree in any case of
    letters. An item of fewer than ``window`` tokens is one window and must be held whole; half of its tokens, and at
    least three, must be plain where values differ. Items of fewer than ``shortest`` tokens, and null texts, match
    nothing.

    Items with the same template and slot pattern are one class (n_items: its size; members() lists them). A pair names
    the class's smallest item, or the smallest whose values the document repeats as they are over the whole item;
    reparameterised is true if values of the stretch differ from the named item's. Documents equal in key and text give
    one row, null keys stay null (_body, a hash of the text, tells such documents apart); empty and null document texts
    match nothing; empty tables give no rows; other columns are not read.
    """
    all_items = durable(items_of(benchmark, item, item_text).filter(F.size("_iv") >= shortest), "benchmark-items")
    items = durable(all_items.groupBy("_class").agg(F.min(F.struct("_item", "_it", "_iw", "_iv")).alias("_r"), F.count(F.lit(1)).alias("n_items")).select("_class", "_r.*", "n_items"), "benchmark-classes")
    sizes = sorted({r[0] for r in items.select(F.least(F.size("_it"), F.lit(window))).distinct().collect()}) or [window]
    every = lambda made: F.concat(*[made(n) for n in sizes])  # noqa: E731  one size unless items are short
    plain_least = lambda n: literals if n == window else max(3, -(-n // 2))
    fitting = F.filter(every(lambda n: known_by("_it", "_iw", n, plain_least(n))), lambda w: w["n"] == F.least(F.size("_it"), F.lit(window)))
    index = durable(items.select("_class", F.size("_it").alias("_length"), F.explode_outer(fitting).alias("_w")).select("_class", "_length", F.col("_w.at").alias("_ipos"), F.col("_w.n").alias("_n"), F.col("_w.hash").alias("_hash")), "benchmark-windows")
    keyed = spread(docs.select(key, text)).select(F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_body"), F.col(text).alias("_text"))
    # Which documents share a window's template with the benchmark at all; by template alone, which costs less to look up.
    plain = items.select(F.least(F.size("_it"), F.lit(window)).alias("_n"), "_iv")
    sized_windows = [hashed(plain.filter(F.col("_n") == n).select("_iv"), "_iv", [n]) for n in sizes]
    known = sized_windows[0]
    for more in sized_windows[1:]:
        known = known.unionByName(more)
    known = sized(durable(known.select(F.explode_outer("_h").alias("_hash")).distinct(), "benchmark-templates"), 500_000)
    looked = hashed(keyed.select("_key", "_body", tokens(F.col("_text")).alias("_dv")), "_dv", sizes).select("_key", "_body", F.explode_outer("_h").alias("_hash"))
    hit = durable(looked.join(known, "_hash", "left_semi").select("_key", "_body").distinct(), "benchmark-hits")
    # These documents in full: which diagonals they share with which items.
    named = hit.select(text_key("_key").alias("_k"), F.col("_body").alias("_b"))
    whole = keyed.join(sized(named, 500_000), (text_key("_key") == F.col("_k")) & (F.col("_body") == F.col("_b")), "left_semi")
    whole = durable(whole.dropDuplicates(["_key", "_body"]).select("_key", "_body", tokens(F.col("_text")).alias("_dv")).withColumns({"_dt": templates("_dv"), "_dw": words("_dv")}).drop("_dv"), "benchmark-documents")
    placed = whole.select("_key", "_body", F.explode_outer(every(lambda n: known_by("_dt", "_dw", n, plain_least(n)))).alias("_w"))
    placed = placed.select("_key", "_body", F.col("_w.at").alias("_dpos"), F.col("_w.n").alias("_n"), F.col("_w.hash").alias("_hash"))
    met = placed.join(sized(index, 500_000), ["_n", "_hash"]).withColumn("_shift", F.col("_dpos") - F.col("_ipos"))
    pair = ["_key", "_body", "_class", "_length", "_n"]
    lines = met.groupBy(*pair, "_shift").agg(F.collect_set("_ipos").alias("_at"))
    # Each diagonal with those up to drift beside it; a place of the item that several cover counts once, by the first.
    beside = Window.partitionBy(*pair).orderBy("_shift").rangeBetween(0, drift)
    covers = F.flatten(F.transform("_near", lambda x: F.flatten(F.transform(x["_at"], lambda p: F.transform(F.sequence(p, p + F.col("_n") - 1), lambda q: F.struct(q.alias("p"), x["_shift"].alias("shift")))))))
    bands = lines.withColumn("_near", F.collect_list(F.struct("_shift", "_at")).over(beside)).select(*pair, "_shift", F.array_sort(F.array_distinct(covers)).alias("_cover"))
    first = lambda out, c: F.when((F.size(out) == 0) | (F.element_at(out, -1)["p"] != c["p"]), F.array_append(out, c)).otherwise(out)
    bands = bands.withColumn("_spots", F.aggregate("_cover", F.array().cast("array<struct<p:int,shift:int>>"), first))
    # Tables between the steps keep a filter from repeating the steps before it inside its own.
    bands = durable(bands.drop("_cover"), "benchmark-bands").withColumn("matched_tokens", F.size("_spots"))
    enough = bands.filter((F.col("matched_tokens") >= least) | (F.col("matched_tokens") >= F.ceil(share * F.col("_length")))).select(*pair, "_shift", "_spots", "matched_tokens")
    both = enough.join(whole.withColumnRenamed("_key", "_k").withColumnRenamed("_body", "_b"), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_body") == F.col("_b"))).join(sized(items, 20_000), "_class")
    # Slots at the covered places, as item word and document word; tokens there must agree in template or word.
    there = lambda s: s["p"] + s["shift"]
    cells = F.transform("_spots", lambda s, k: F.struct(
        k.alias("k"), F.left(F.get("_it", s["p"]), F.lit(1)).alias("mark"), F.get("_iw", s["p"]).alias("iv"), F.get("_dw", there(s)).alias("dv"),
        ((F.get("_it", s["p"]) == F.get("_dt", there(s))) | (F.get("_iw", s["p"]) == F.get("_dw", there(s)))).alias("fits"),
    ))
    own = F.xxhash64(F.slice("_dw", F.greatest(F.col("_shift"), F.lit(0)) + 1, F.col("_length"))).alias("_all")
    told = durable(both.select(*pair, "_item", "n_items", "_shift", "matched_tokens", own, cells.alias("_cells")), "benchmark-cells")
    slots = F.transform(F.filter("_cells", lambda c: c["mark"].isin(*MARKS)), lambda c: c.dropFields("fits"))
    told = durable(told.filter(F.forall("_cells", lambda c: c["fits"])).withColumn("_slots", slots).drop("_cells"), "benchmark-slots")
    need = F.when(F.col("_length") < window, F.col("_length")).otherwise(F.least(F.lit(least), F.ceil(share * F.col("_length")).cast("int")))
    held = durable(told.withColumn("_stretch", best_stretch("_slots", "matched_tokens", need, agree)), "benchmark-stretches").filter(F.col("_stretch.n") > 0)
    inside = F.slice("_slots", F.col("_stretch.i") + 1, F.col("_stretch.j") - F.col("_stretch.i"))
    held = held.withColumns({"matched_tokens": F.col("_stretch.n"), "n_slots": F.col("_stretch.j") - F.col("_stretch.i"), "_other": F.exists(inside, lambda m: m["iv"] != m["dv"])})
    # A document's own values over the whole item may be those of another member of the class.
    same = all_items.groupBy("_class", "_all").agg(F.min("_item").alias("_same"))
    exact = held.join(sized(same, 500_000), ["_class", "_all"], "left")
    whole_copy = F.col("_same").isNotNull() & (F.col("matched_tokens") == F.col("_length"))
    exact = exact.withColumns({"_named": F.when(whole_copy, F.col("_same")).otherwise(F.col("_item")), "_new": F.col("_other") & ~whole_copy})
    best = exact.groupBy("_key", "_body", "_class").agg(
        F.max_by(F.struct("_named", "matched_tokens", "_length", "n_slots", "_new", "n_items"), F.struct("matched_tokens", ~F.col("_new"), -F.col("_shift"))).alias("_b")
    )
    return best.select(
        F.col("_key").alias(key), F.col("_b._named").alias(item), F.col("_b.matched_tokens").alias("matched_tokens"), F.col("_b._length").alias("item_tokens"),
        F.col("_b.n_slots").alias("n_slots"), F.col("_b._new").alias("reparameterised"), F.col("_b.n_items").alias("n_items"), "_body",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **settings: object) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns as they are.

    Repeated rows stay or go together, null keys and texts included; rows without text stay; an empty benchmark keeps all.
    """
    found = contaminated(docs, benchmark, key=key, text=text, **settings)
    leaks = durable(found.select(text_key(key).alias("_k"), F.col("_body").alias("_b")).distinct(), "benchmark-leaks")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), text_key(key).alias("_k"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_b"))
    return named.join(sized(leaks, 500_000), ["_k", "_b"], "left_anti").select("_row.*")
