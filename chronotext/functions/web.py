"""Web addresses and pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1)


# Names and ranges of private networks.
PRIVATE = r"^(localhost|.*\.local|.*\.internal|0\..*|10\..*|127\..*|169\.254\..*|192\.168\..*|172\.(1[6-9]|2\d|3[01])\..*|\[?::1\]?|\[?f[cd][0-9a-f]{2}:.*)$"


def is_private(host_name: Column) -> Column:
    return host_name.rlike(PRIVATE)


def canonical_feed(url: Column) -> Column:
    """A feed's address without fragment and trailing slashes, always https."""
    out = F.regexp_replace(F.trim(url), r"#.*$", "")
    return F.regexp_replace(F.regexp_replace(out, r"(?i)^http:", "https:"), r"/+$", "")


def youtube_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"(?:youtu\.be/|youtube(?:-nocookie)?\.com/(?:watch\?(?:.*&)?v=|(?:shorts|live|embed|v|e)/))([\w-]{11})", 1), F.lit(""))


def dropbox_direct(url: Column) -> Column:
    """A shared file's download address, on the host that lets pages download it and without ``dl``; null for others."""
    there = F.regexp_replace(url, r"^([a-zA-Z][\w+.-]*://)[^/?#]*", "$1dl.dropboxusercontent.com")
    bare = F.regexp_replace(F.regexp_replace(there, r"([?&])dl=[^&#]*&", "$1"), r"[?&]dl=[^&#]*(?=#|$)", "")
    return F.when(host(url).rlike(r"(^|\.)dropbox\.com$") & path(url).rlike("^/(s|scl|sh)/"), bare)


def slug_hints(url: Column) -> Column:
    """Words of a path's last part that may name an episode."""
    last = F.element_at(F.filter(F.split(path(url), "/"), lambda s: s != ""), -1)
    return F.filter(F.split(F.regexp_replace(F.lower(last), r"\.[a-z0-9]{2,4}$", ""), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)


def episode_id(guid: Column) -> Column:
    return F.substring(F.sha1(guid.cast("string")), 1, 16)


def is_feed(text: Column) -> Column:
    """An RSS document with a channel, or an Atom feed with entries."""
    return (text.rlike(r"(?is)<rss[\s>]") & text.rlike(r"(?is)<channel[\s>]")) | (text.rlike(r"(?is)<feed[\s>]") & text.rlike(r"(?is)<entry[\s>]"))


AUDIO = r"https?://[^\s\"'<>]+\.(?:mp3|m4a|ogg|opus|wav)(?:\?[^\s\"'<>]*)?"


def audio_in_page(html: Column) -> Column:
    """An audio address of a page: declared, in a player, or the only one there is."""
    bare = F.array_distinct(F.regexp_extract_all(html, F.lit(AUDIO), F.lit(0)))
    found = [F.regexp_extract(html, p, 1) for p in (r"(?i)<meta[^>]+property=[\"']og:audio[\"'][^>]+content=[\"']([^\"']+)", r"(?i)<meta[^>]+name=[\"']twitter:player:stream[\"'][^>]+content=[\"']([^\"']+)", r"(?i)<audio[^>]+src=[\"']([^\"']+)")]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in found], F.when(F.size(bare) == 1, bare[0]))


# Titles and marks of pages that ask whether the visitor is human.
CHALLENGE_TITLES = "just a moment|attention required|access denied|verify you are human"
CHALLENGE_MARKS = "challenge-platform|cf-browser-verification"


def is_challenge(html: Column) -> Column:
    """Whether a page stands in for the real one; by its title, as ordinary text may hold the same words. Null: false."""
    return F.coalesce(html.rlike(rf"(?i)<title>\s*(?:{CHALLENGE_TITLES})") | html.rlike(f"(?i){CHALLENGE_MARKS}"), F.lit(False))
