"""What a page says about an episode: structured data of any depth, declared audio, the one bare address, a feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.functions import text as tx
from chronotext.session import written

#: Deeper nesting than pages have; a walk ends as soon as no level is left.
DEPTH = 32
OBJECT, LIST = "map<string,variant>", "array<variant>"


def json_blocks(html: Column) -> Column:
    """The structured-data scripts of a page, as variants; what is no JSON is left out."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script"), F.lit(1))
    return F.filter(F.transform(found, F.try_parse_json), lambda v: v.isNotNull())


def is_object(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))


def is_list(v: Column) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit("ARRAY"))


def texts(v: Column, path: str) -> Column:
    """The strings at a path: of a string, of each string of a list; an empty list for anything else."""
    many, one = F.try_variant_get(v, path, "array<string>"), F.try_variant_get(v, path, "string")
    return F.filter(F.coalesce(many, F.array(one)), lambda x: x.isNotNull())


def json_objects(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Every object in the structured data of pages, of any depth: key, place (its way from the top), value.

    Level by level: each round opens the objects and lists of the one before, in all pages at once, from a table that it
    wrote, until none are left.
    place: array of numbers that sorts scripts and lists as they stand and the fields of an object by name, an object
    before what it holds. Null pages and broken scripts have none.
    """
    level = written(pages.select(key, F.posexplode(json_blocks(F.col(html))).alias("_i", "value")).select(key, F.array("_i").alias("place"), "value"), "level")
    found = None
    for _ in range(DEPTH):
        objects = level.filter(is_object(F.col("value")))
        found = objects if found is None else found.unionByName(objects)
        of_object = F.map_values(F.try_variant_get("value", "$", OBJECT))
        of_list = F.try_variant_get("value", "$", LIST)
        inner = F.coalesce(F.when(is_object(F.col("value")), of_object), F.when(is_list(F.col("value")), of_list))
        level = level.select(key, "place", F.posexplode(inner).alias("_i", "value")).select(key, F.array_append("place", F.col("_i")).alias("place"), "value")
        level = written(level.filter(is_object(F.col("value")) | is_list(F.col("value"))), "level")
        if level.isEmpty():
            break
    return found


def named(v: Column, path: str) -> Column:
    """A name at a path: a text, or the text ``name`` of an object there; empty if neither."""
    return F.trim(F.coalesce(F.try_variant_get(v, f"{path}.name", "string"), F.when(~F.coalesce(is_object(F.try_variant_get(v, path, "variant")), F.lit(False)), F.try_variant_get(v, path, "string")), F.lit("")))


def structured_episodes(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """The first episode or audio object in a page's structured data that has an audio address, or a title and a show:
    key, url, title, show.

    An address is a medium's ``contentUrl`` or ``url``, or the medium itself where it is a text, of the first that is
    http and no page. Title and show may be empty; pages without such an object give no row.
    """
    objects = json_objects(pages, key, html)
    v = F.col("value")
    kinds = F.array_join(texts(v, "$['@type']"), " ")
    media = F.coalesce(F.try_variant_get(v, "$.associatedMedia", "variant"), F.try_variant_get(v, "$.audio", "variant"))
    each = F.when(is_list(media), F.try_variant_get(media, "$", LIST)).when(media.isNotNull(), F.array(media)).otherwise(F.array().cast(LIST))
    each = F.concat(each, F.when(kinds.contains("AudioObject"), F.array(v)).otherwise(F.array().cast(LIST)))

    def address(m: Column) -> Column:
        return F.when(is_object(m), F.coalesce(F.nullif(F.try_variant_get(m, "$.contentUrl", "string"), F.lit("")), F.try_variant_get(m, "$.url", "string"))).otherwise(F.try_variant_get(m, "$", "string"))

    urls = F.filter(F.transform(each, address), lambda u: u.rlike("^https?:") & ~u.rlike(r"\.html?($|\?)"))
    title = F.coalesce(F.nullif(named(v, "$.name"), F.lit("")), named(v, "$.headline"))
    show = F.coalesce(F.nullif(named(v, "$.partOfSeries"), F.lit("")), named(v, "$.partOfSeason.partOfSeries"))
    rows = objects.filter(kinds.rlike("Episode|AudioObject")).select(key, "place", F.get(urls, 0).alias("url"), title.alias("title"), show.alias("show"))
    good = rows.filter(F.col("url").isNotNull() | (F.col("title") != "") & (F.col("show") != ""))
    first = good.groupBy(key).agg(F.min_by(F.struct("url", "title", "show"), "place").alias("_e"))
    return first.select(key, "_e.url", "_e.title", "_e.show")


def absolute(link: Column, base: Column) -> Column:
    """A link as an address of its own, seen from the page ``base``."""
    root = F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(link.rlike(r"^[a-zA-Z][\w+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^[a-zA-Z][\w+.-]*:", 0), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(root != "", F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(root, F.lit("/"))), link))
    )


# Fixed value: an audio address in the source of a page, slashes escaped or not.
BARE_AUDIO = r"(?i)https?:\\?/\\?/[^\"'\s<>()]+?\.(?:mp3|m4a|aac|ogg|opus|wav|m4b)(?:\?[^\"'\s<>()]*)?(?=[\"'\s<>()]|$)"


def attribute(tag: Column, name: str) -> Column:
    return tx.decode_entities(F.coalesce(F.nullif(F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*\"([^\"]*)\"", 1), F.lit("")), F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*'([^']*)'", 1)))


def tag_with(html: Column, tag: str, condition: str, wanted: str) -> Column:
    """Attribute ``wanted`` of the first tag that has it and meets a condition on its text; null if there is none."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>"), F.lit(0))
    values = F.transform(F.filter(tags, lambda t: t.rlike(condition)), lambda t: attribute(t, wanted))
    return F.get(F.filter(values, lambda x: x != ""), 0)


def page_audio(pages: DataFrame, key: str, html: str = "html", url: str = "url") -> DataFrame:
    """Where a page's audio is: key, kind (audio or feed), url, title, show; no row for pages that have neither.

    In this order: an address that the page declares or plays, its structured data, the only bare audio address in the
    source, a feed that it links to. Links are made absolute from the page's own address.
    """
    h = F.col(html)
    declared = [tag_with(h, "meta", rf"(?is)property\s*=\s*[\"']{p}[\"']", "content") for p in ("og:audio", "og:audio:url", "og:audio:secure_url")]
    declared += [tag_with(h, "meta", r"(?is)name\s*=\s*[\"']twitter:player:stream[\"']", "content"), tag_with(h, "audio", r"(?is)\ssrc\s*=", "src"), tag_with(h, "source", r"(?is)\ssrc\s*=", "src")]
    bare = F.array_distinct(F.transform(F.regexp_extract_all(h, F.lit(BARE_AUDIO), F.lit(0)), lambda u: F.replace(F.regexp_replace(F.replace(u, F.lit("\\/"), F.lit("/")), r"(?i)\\u0026", "&"), F.lit("&amp;"), F.lit("&"))))
    feed = tag_with(h, "link", r"(?is)type\s*=\s*[\"']application/(?:rss|atom)\+xml[\"']", "href")
    title = F.coalesce(tag_with(h, "meta", r"(?is)property\s*=\s*[\"']og:title[\"']", "content"), tx.clean(tx.decode_entities(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title", 1))))
    own = pages.filter(h.isNotNull()).select(key, F.col(url).alias("_base"), F.coalesce(*declared).alias("_declared"), F.when(F.size(bare) == 1, F.get(bare, 0)).alias("_bare"), feed.alias("_feed"), title.alias("_title"))
    told = structured_episodes(pages, key, html).select(key, F.col("url").alias("_told"), F.col("title").alias("_name"), "show")
    rows = own.join(told, key, "left")
    by_told = F.col("_declared").isNull() & F.col("_told").isNotNull()
    found = F.coalesce(absolute(F.col("_declared"), F.col("_base")), F.col("_told"), F.col("_bare"), absolute(F.col("_feed"), F.col("_base")))
    kind = F.when(F.coalesce("_declared", "_told", "_bare").isNotNull(), "audio").otherwise("feed")
    out = rows.select(key, kind.alias("kind"), found.alias("url"), F.when(by_told & (F.col("_name") != ""), F.col("_name")).otherwise(F.col("_title")).alias("title"), F.when(by_told, F.nullif("show", F.lit(""))).alias("show"))
    return out.filter("url IS NOT NULL")


def repaired_link(raw: Column) -> Column:
    """A pasted text as a link: the first address in it without closing marks, or a bare domain with https; else empty."""
    t = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "^<|>$", "")
    found = F.regexp_replace(F.regexp_extract(t, r"(?i)https?://\S+", 0), r"[)\].,;!?'\"»”]+$", "")
    bare = t.rlike(r"(?i)^[\w-]+(\.[\w-]+)+\.?(:\d+)?(/\S*)?$") & t.rlike(r"(?i)\.[a-z]{2,}(:\d+)?(/|$)")
    return F.when(found != "", found).when(bare, F.concat(F.lit("https://"), t)).otherwise("")


def looks_like_feed(text: Column) -> Column:
    """A feed by its beginning: ``rss`` or ``feed`` opens in the first 2,000 characters, and there is an item or an entry."""
    return F.coalesce(F.substring(text, 1, 2000).rlike(r"(?i)<(rss|feed)[\s>]") & text.rlike(r"(?i)<(item|entry)[\s>]"), F.lit(False))
