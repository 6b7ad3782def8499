"""Text functions on string columns, as built-in Spark expressions."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronotext.functions import fixed

WORD_EDGE = r"(?<![\p{L}\p{N}])"


def _accent_table() -> tuple[str, str]:
    """Letters that fold to one base letter, by their decomposition; æ, ø and å stay letters of their own."""
    wide, bare = [], []
    for code in range(0xC0, 0x2000):
        letter = chr(code).lower()
        base = "".join(c for c in unicodedata.normalize("NFD", letter) if not unicodedata.combining(c))
        if len(letter) == 1 and len(base) == 1 and base != letter and letter not in "æøå" and letter not in wide:
            wide.append(letter)
            bare.append(base)
    return "".join(wide), "".join(bare)


ACCENTS, BASES = _accent_table()


def fold(text: Column) -> Column:
    """Search form: lower case, Latin accents off (æ, ø, å kept), straight quotes, plain spaces; keeps the length."""
    out = F.translate(F.lower(text), ACCENTS + "‘’ʼ′`“”„«»\t\n\r\f ", BASES + "'''''" + '"""""' + "     ")
    return F.regexp_replace(out, r"[^\x00-ÿ\p{L}\p{N}]", " ")


def _compositions() -> str:
    """Letters with their marks behind them, and the one letter that stands for both, as JSON."""
    letters = (chr(c) for c in range(0xC0, 0x2000))
    apart = {unicodedata.normalize("NFD", c): c for c in letters if unicodedata.normalize("NFC", c) == c}
    return json.dumps({k: c for k, c in apart.items() if len(k) > 1 and not unicodedata.combining(k[0])}, ensure_ascii=False)


COMPOSITIONS = _compositions()


def composed(text: Column) -> Column:
    """Letters and the marks behind them as one letter where there is one (of the alphabets below U+2000).

    Only texts with marks are looked at letter by letter; marks in another than the canonical order stay as they are.
    """
    table = F.from_json(F.lit(COMPOSITIONS), "map<string,string>")
    letters = F.regexp_extract_all(text, F.lit(r"(?s)\P{M}\p{M}*|\p{M}+"), F.lit(0))
    return F.when(text.rlike(r"\p{M}"), F.array_join(F.transform(letters, lambda c: F.when(F.length(c) > 1, F.coalesce(F.try_element_at(table, c), c)).otherwise(c)), "")).otherwise(text)


def clean(text: Column) -> Column:
    """One line with single spaces, marks joined to their letters."""
    return F.trim(F.regexp_replace(composed(F.coalesce(text, F.lit(""))), r"\s+", " "))


def norm_title(text: Column) -> Column:
    """Lower case without accents; anything but letters and digits is one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ACCENTS + "å", BASES + "a"), r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def same_show(a: Column, b: Column) -> Column:
    """Whether two show titles are one show: equal, or one holds the other, with or without spaces."""
    x, y = norm_title(F.coalesce(a, F.lit(""))), norm_title(F.coalesce(b, F.lit("")))
    cx, cy = F.replace(x, F.lit(" "), F.lit("")), F.replace(y, F.lit(" "), F.lit(""))
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | F.contains(cx, cy) | F.contains(cy, cx))


def numbers_in(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)), " ")


def collapse_stutter(text: Column) -> Column:
    """A doubled short function word becomes one."""
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}'’])({fixed.STUTTER_WORDS})(\s+\1)+(?![\p{{L}}'’])", "$1")


def sound_key(text: Column) -> Column:
    """Letters as they sound, for names that were heard and spelled differently."""
    out = F.regexp_replace(F.translate(F.lower(text), ACCENTS + "å", BASES + "a"), r"[^\p{L}\p{N}]", "")
    for pattern, to in fixed.SOUNDS:
        out = F.regexp_replace(out, pattern, to)
    return out


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[\\`*_\[\]]", r"\\$0"), r"^([#>+-]|\d+\.)(?=\s)", r"\\$1")


def escape_xml(text: Column) -> Column:
    out = text
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def decode_entities(text: Column) -> Column:
    """Named and numeric character references, decoded once: ``&amp;lt;`` is ``&lt;``. Unknown ones, and numbers that are no
    character, stay as they are; null stays null."""
    table = F.from_json(F.lit(json.dumps(fixed.ENTITIES)), "map<string,string>")

    def letter(code: Column) -> Column:
        known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        return F.when(known, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    def meant(ref: Column) -> Column:
        number = F.when(ref.rlike("^#[xX]"), F.conv(F.substring(ref, 3, 9), 16, 10)).otherwise(F.substring(ref, 2, 9)).cast("long")
        return F.when(ref.startswith("#"), let(number, letter)).otherwise(F.try_element_at(table, ref))

    def after_mark(part: Column) -> Column:
        ref = F.regexp_extract(part, r"^(#[xX][0-9a-fA-F]{1,7}|#[0-9]{1,8}|[A-Za-z]+);", 1)
        return let(ref, lambda r: F.coalesce(F.concat(meant(r), F.substring(part, F.length(r) + 2, F.length(part))), F.concat(F.lit("&"), part)))

    return let(F.split(text, "&"), lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), after_mark), "")))


def strip_tags(html: Column) -> Column:
    """Text of a page: script and style out, a space at tags that are not inline."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{fixed.INLINE_TAGS})(?:\s[^>]*)?>", "")
    return clean(F.regexp_replace(out, r"<[^>]*>", " "))


def plain_notes(html: Column) -> Column:
    """Notes as running text: blocks end sentences, a few entities, no addresses."""
    out = F.regexp_replace(html, r"(?i)<(br|p|li|div)[^>]*>", ". ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for name, mark in (("&nbsp;", " "), ("&amp;", "&"), ("&#39;", "'"), ("&rsquo;", "'"), ("&quot;", '"')):
        out = F.replace(out, F.lit(name), F.lit(mark))
    return clean(F.regexp_replace(out, r"https?://\S+|www\.\S+|\S+@\S+", " "))


def summary(html: Column, most: int = 280) -> Column:
    """A page as one line without addresses. Beyond ``most`` characters it is cut at the last space, though not more than 40
    characters early, and ends with an ellipsis in place of white space and stops."""

    def cut(text: Column) -> Column:
        head = F.left(text, F.lit(most))
        space = F.length(head) - F.length(F.substring_index(head, " ", -1)) - 1
        kept = F.substring(head, F.lit(1), F.greatest(space, F.lit(most - 40)))
        return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(kept, r"[\s,;:.]+$", ""), F.lit("…")))

    return let(clean(F.regexp_replace(decode_entities(strip_tags(html)), r"https?://\S+", " ")), cut)


# Tags that end a line.
BLOCKS = "br|p|div|li|ul|ol|h1|h2|h3|h4|h5|h6|blockquote|tr|td|th|dt|dd|hr|pre|section|table"


def note_lines(html: Column) -> Column:
    """Lines of notes: block tags end lines, other tags vanish, blank lines go."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1", "<")
    out = F.regexp_replace(out, rf"(?i)</?(?:{BLOCKS})(?:\s[^>]*|/)?>", "\n")
    out = decode_entities(F.regexp_replace(out, r"<[^>]*>", ""))
    return F.filter(F.transform(F.split(out, "\n"), clean), lambda x: x != "")


def is_credit(text: Column) -> Column:
    return text.rlike(rf"""(?iu)^\s*[(\["]?\s*({"|".join(fixed.CREDITS)})(?:[^.!?\n]|\.(?=\S)){{0,60}}[.!?]?\s*[)\]"]?\s*$""")


def sentences(text: Column) -> Column:
    """Sentences with the space after them; a text of stops alone is one."""
    found = F.regexp_extract_all(text, F.lit(r"[^.!?]+[.!?]*\s*"), F.lit(0))
    return F.when(F.size(found) > 0, found).otherwise(F.array(text))


def _whole(alternatives: tuple[str, ...]) -> str:
    return rf"(?iu)(?<![\p{{L}}])({'|'.join(alternatives)})(?![\p{{L}}])"


def _sponsors(sentence: Column) -> Column:
    return sentence.rlike(fixed.SPONSORED) & ~sentence.rlike(fixed.NOT_A_SPONSOR)


def strong_cues(text: Column, alternatives: tuple[str, ...] = fixed.STRONG_CUES) -> Column:
    """One for any strong wording, and one for each sentence with a sponsor; none for null."""
    worded = text.rlike(_whole(alternatives)).cast("int")
    return F.coalesce(worded + F.size(F.filter(sentences(text), _sponsors)), F.lit(0))


def weak_cues(text: Column, patterns: tuple[str, ...] = fixed.WEAK_CUES) -> Column:
    """How many of the weak wordings a text has; none for null."""
    hits = [text.rlike(p).cast("int") for p in patterns]
    return F.coalesce(sum(hits[1:], hits[0]), F.lit(0))


def opens_ad(text: Column) -> Column:
    """Whether a sentence opens a read for a sponsor."""
    opens = lambda s: s.rlike(_whole(fixed.OPENERS)) & (_sponsors(s) | ~s.rlike(fixed.SPONSORED))
    return F.coalesce(F.exists(sentences(text), opens), F.lit(False))


def is_ad(text: Column, strong: tuple[str, ...] = fixed.STRONG_CUES, weak: tuple[str, ...] = fixed.WEAK_CUES) -> Column:
    return (strong_cues(text, strong) > 0) | (weak_cues(text, weak) >= 2)


def app_language(tag: Column) -> Column:
    """The name of the language that a feed's tag stands for; empty if it is none of those transcribed or null."""
    table = F.create_map(*[F.lit(x) for pair in fixed.LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.split(F.trim(F.lower(tag)), "[-_]")[0]), F.lit(""))


def trim_starters(term: Column) -> Column:
    """A name without the words of a sentence's start before it; the last word always stays."""
    parts = F.split(term, r"\s+")
    common = F.array(*map(F.lit, sorted({*fixed.STARTERS, *fixed.COMMON})))
    first = F.array_position(F.transform(parts, lambda w: ~F.array_contains(common, F.lower(w))), F.lit(True)).cast("int")
    return F.array_join(F.slice(parts, F.when(first > 0, first).otherwise(F.size(parts)), F.size(parts)), " ")


def title_words(title: Column) -> Column:
    """Words of a title in lower case without accents; a number sign stays."""
    plain = F.regexp_replace(F.translate(F.lower(F.coalesce(title, F.lit(""))), ACCENTS + "å", BASES + "a"), r"\p{M}", "")
    return F.filter(F.split(plain, r"[^\p{L}\p{N}#]+"), lambda w: w != "")


def key_words(title: Column, show: Column) -> Column:
    """Words of a title that tell it apart, as often as they stand there: no tags or handles, no filler, none of the show's,
    three letters or more or with a digit."""
    found = title_words(F.regexp_replace(F.coalesce(title, F.lit("")), r"#[\p{L}_]+|@[\w.]+", " "))
    ours = F.array_union(F.array(*map(F.lit, fixed.TITLE_FILLER)), title_words(show))
    return F.filter(found, lambda w: ((F.length(w) > 2) | w.rlike(r"\d")) & ~F.array_contains(ours, w))


def episode_number(title: Column) -> Column:
    """The number of an episode that a title gives, in the wordings of several languages; null if none."""
    return F.nullif(F.regexp_extract(title, rf"(?iu)(?:#|(?:^|[^\p{{L}}])(?:{fixed.EPISODE_WORDS})\.?\s*)(\d{{1,4}})(?!\d)", 1), F.lit("")).cast("int")


def excerpt(text: Column, at: Column, reach: int = 40) -> Column:
    """A stretch of text around the 1-based place ``at``, with ellipses where it is cut."""
    start = F.greatest(at - reach, F.lit(1))
    body = F.substring(text, start, F.lit(2 * reach))
    return F.concat(F.when(start > 1, F.lit("…")).otherwise(""), body, F.when(start + 2 * reach <= F.length(text), F.lit("…")).otherwise(""))


def last_words(text: Column, n: int = 60) -> Column:
    w = words(text)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n, F.lit(0)) + 1, F.lit(n)), " ")


def prompt(terms: Column, previous: Column, most: int = 700) -> Column:
    """Glossary terms, then the end of what was said; if too long its last ``most`` characters from a whole word on."""
    glossary = F.when(F.size(terms) > 0, F.concat(F.array_join(terms, ", "), F.lit(".")))
    whole = F.concat_ws(" ", glossary, F.nullif(last_words(previous), F.lit("")))
    return F.when(F.length(whole) > most, F.regexp_replace(F.right(whole, F.lit(most)), r"^\S*\s", "")).otherwise(whole)


def count_in_page(text: Column, needle: str) -> Column:
    """Occurrences that do not overlap; needles under two characters are not searched."""
    if len(needle) < 2:
        return F.lit(0)
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(needle.lower()), F.lit("")))) / len(needle)).cast("int")
