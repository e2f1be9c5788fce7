"""Passages for readers and models: highlights, breaks, abstracts, markers of pages and images, readable figures."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short forms after which a full stop ends no sentence.
ABBREVIATIONS = ("mr", "dr", "jr", "sr", "st", "vs", "no", "co", "ph", "pp", "mrs", "fig", "vol", "inc", "ltd", "rev", "gov", "col", "est", "prof", "corp", "univ", "dept", "blvd")
# Headings that end an abstract.
SECTIONS = ("Introduction", "Keywords", "Key words", "Contents", "Table of Contents", "Background", "Methods", "References", "Acknowledgements", "Chapter")
_OPEN, _SHUT = "\ue000", "\ue001"


def html_encoded(text: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")), text)


def search_terms(query: str) -> list[str]:
    """Words of a query to be marked: two letters at least, each once whatever its case, longest first."""
    seen = {w.lower(): w for w in reversed(query.split()) if len(w) >= 2}
    return sorted(seen.values(), key=lambda w: (-len(w), w.lower()))


def highlighted(text: Column, query: str, whole: str = "whole", part: str = "part") -> Column:
    """Encoded text with the query's terms in marks, of one class for whole words and another inside words. Entities are not marked into."""
    terms = search_terms(query)
    safe = html_encoded(F.translate(text, _OPEN + _SHUT, ""))
    if not terms:
        return safe
    wanted = "|".join(re.escape(t) for t in html_terms(terms))
    found = F.regexp_replace(safe, rf"(?iu)(&(?:amp|lt|gt|quot|#39);)|({wanted})", f"$1{_OPEN}$2{_SHUT}")
    found = F.replace(found, F.lit(_OPEN + _SHUT), F.lit(""))
    words = F.regexp_replace(found, rf"(?<![\p{{L}}\p{{N}}]){_OPEN}([^{_SHUT}]*){_SHUT}(?![\p{{L}}\p{{N}}])", f'<mark class="{whole}">$1</mark>')
    return F.regexp_replace(words, f"{_OPEN}([^{_SHUT}]*){_SHUT}", f'<mark class="{part}">$1</mark>')


def html_terms(terms: list[str]) -> list[str]:
    import html

    return [html.escape(t, quote=True).replace("&#x27;", "&#39;") for t in terms]


def sentence_breaks(text: Column) -> Column:
    """Encoded text with a break before each [n]; none at the beginning."""
    return F.regexp_replace(F.regexp_replace(html_encoded(text), r"\s*(\[[0-9]+\])", "<br/>$1"), r"^(?:<br/>)+", "")


def numbered(sentences: Column) -> Column:
    """Sentences as one text, each after its number on a line of its own; blank ones get no number."""
    kept = F.filter(sentences, lambda s: F.trim(s) != "")
    return F.array_join(F.transform(kept, lambda s, i: F.concat(F.lit("\n["), (i + 1).cast("string"), F.lit("] "), F.trim(s))), "")


def for_model(text: Column, attempt: int = 0) -> Column:
    """What a model gets of a text: its first 2000 characters, after a failure 1500."""
    return F.substring(text, 1, 2000 if attempt == 0 else 1500)


def abstract(text: Column) -> Column:
    """The passage after a heading Abstract or Summary, up to the next heading or 3500 characters; else the first 2000 characters."""
    flat = F.regexp_replace(F.regexp_replace(text, r"(?<=\p{L})-\r?\n\s*(?=\p{Ll})", ""), r"[\r\n]+", " ")
    flat = F.trim(F.regexp_replace(flat, r"\s+", " "))
    after = F.regexp_extract(flat, r"(?i)\b(?:abstract|summary)\b(.*)$", 1)
    ends = "|".join(re.escape(s) for s in SECTIONS)
    cut = F.regexp_extract(after, rf"^(.{{41,}}?)\b(?:{ends})\b", 1)
    body = F.regexp_replace(F.substring(F.when(cut != "", cut).otherwise(after), 1, 3500), r"^[\s\p{P}]+", "")
    return F.when(F.length(F.trim(body)) > 20, F.trim(body)).otherwise(F.substring(flat, 1, 2000))


def is_abbreviation(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"\.$", "")).isin(*ABBREVIATIONS)


def roman(numeral: Column) -> Column:
    """Value of a Roman numeral in any case; null for anything else."""
    values = F.create_map(*[F.lit(x) for kv in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in kv])
    digits = F.transform(F.split(F.lower(numeral), ""), lambda c: F.try_element_at(values, c))
    signed = F.transform(digits, lambda v, i: F.when(F.coalesce(F.get(digits, i + 1), F.lit(0)) > v, -v).otherwise(v))
    return F.when(F.lower(numeral).rlike("^m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (numeral != ""), F.aggregate(F.filter(signed, lambda v: v.isNotNull()), F.lit(0), lambda a, v: a + v))


def page_marker(tag: Column) -> Column:
    """Page of an id="pageN" in a tag; pages in Roman numerals are negative; null without one."""
    arabic = F.regexp_extract(tag, r"""(?i)\bid\s*=\s*["']page_?([0-9]+)["']""", 1)
    old = roman(F.regexp_extract(tag, r"""(?i)\bid\s*=\s*["']page_?([ivxlcdm]+)["']""", 1))
    return F.coalesce(arabic.try_cast("int"), -old)


def chapter_marker(tag: Column) -> Column:
    """Number of a <div class='chapter' id=...>: the digits after "ch", else the first digits."""
    is_chapter = tag.rlike(r"""(?i)^<div\b[^>]*\bclass\s*=\s*["']chapter["']""")
    name = F.regexp_extract(tag, r"""(?i)\bid\s*=\s*["']([^"']*)["']""", 1)
    number = F.coalesce(F.nullif(F.regexp_extract(name, "(?i)ch[a-z]*_?([0-9]+)", 1), F.lit("")), F.regexp_extract(name, "([0-9]+)", 1))
    return F.when(is_chapter, number.try_cast("int"))


def image_markers(text: Column) -> Column:
    """The [image.sz(info,pN)] of a text as (page, info), the first of each page."""
    infos = F.regexp_extract_all(text, F.lit(r"\[image\.sz\(([^)]*?),?p([0-9]+)\)\]"), F.lit(1))
    pages = F.regexp_extract_all(text, F.lit(r"\[image\.sz\(([^)]*?),?p([0-9]+)\)\]"), F.lit(2))
    both = F.arrays_zip(pages.alias("page"), infos.alias("info"))
    told = F.transform(both, lambda x: F.struct(x["page"].cast("int").alias("page"), x["info"].alias("info")))
    firsts = F.transform(told, lambda x: x["page"])
    return F.filter(told, lambda x, i: F.array_position(firsts, x["page"]) == i + 1)


def readable_size(n: Column) -> Column:
    """Bytes as GB, MB or KB with one decimal."""
    cut = lambda unit, name: F.concat(F.format_string("%.1f", n / float(unit)), F.lit(f" {name}"))
    return F.when(n >= 1 << 30, cut(1 << 30, "GB")).when(n >= 1 << 20, cut(1 << 20, "MB")).otherwise(cut(1 << 10, "KB"))


def readable_duration(seconds: Column) -> Column:
    """h:mm:ss, or m:ss below an hour; parts of a second are dropped."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    h, m, r = F.floor(s / 3600).cast("long"), F.floor(s % 3600 / 60).cast("long"), s % 60
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(r))).otherwise(F.concat_ws(":", m.cast("string"), two(r)))


def frame_rate(said: Column) -> Column:
    """num/den rounded to two places; null where den is not positive."""
    a, b = F.regexp_extract(said, "^([0-9]+)/", 1).try_cast("double"), F.regexp_extract(said, "/([0-9]+)$", 1).try_cast("double")
    return F.when(b > 0, F.round(a / b, 2))


def download_url(base: Column, dataset: Column, file_name: Column) -> Column:
    """base/dataset/file with both escaped; null where a part is missing."""
    escaped = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    there = reduce(lambda a, c: a & (F.coalesce(F.trim(c), F.lit("")) != ""), (base, dataset, file_name), F.lit(True))
    return F.when(there, F.concat_ws("/", F.regexp_replace(base, "/+$", ""), escaped(dataset), escaped(file_name)))


def artifacts_removed(text: Column, rounds: int = 12) -> Column:
    """No blank after an opening bracket, and none that a scan put inside an address before a lower-case letter or digit."""
    inside = r"(?<=(?:https?://|www\.)[^\s]{0,200}[./_=?&-])\s+(?=[a-z0-9])"
    tight = F.regexp_replace(text, r"\(\s+(?=\S)", "(")
    return F.when(tight.rlike(r"https?://|www\."), F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), tight, lambda t, _: F.when(t.rlike(inside), F.regexp_replace(t, inside, "")).otherwise(t))).otherwise(tight)


def around_identifiers(sentence: Column, prefix: str = "EFTA") -> Column:
    """A sentence cut around identifiers of a prefix and eight digits or more; each is a sentence of its own."""
    cut = F.regexp_replace(sentence, rf"\s*\b({re.escape(prefix)}[0-9]{{8,}})\b\s*", f"{_OPEN}$1{_OPEN}")
    return F.filter(F.split(cut, _OPEN), lambda s: F.trim(s) != "")


def stray_equals_resolved(text: Column, words: Column) -> Column:
    """A = inside a word becomes the letter that makes a known word (of several the most frequent in English), else a blank; one at a word's edge goes; operators stay.

    words: an array of known words in lower case.
    """
    letters = "etaoinshrdlcumwfgypbvkjxqz"

    def one(w: Column) -> Column:
        tries = F.filter(F.transform(F.split(F.lit(letters), ""), lambda c: F.replace(w, F.lit("="), c)), lambda t: F.array_contains(words, F.lower(t)))
        inner = F.when(F.size(tries) > 0, F.get(tries, F.lit(0))).otherwise(F.replace(w, F.lit("="), F.lit(" ")))
        edged = F.regexp_replace(w, r"^=(?=\p{L})|(?<=\p{L})=(?=[\p{P}]*$)", "")
        return F.when(w.rlike(r"==|!=|>=|<="), w).when(w.rlike(r"\p{L}=\p{L}"), inner).when(w.rlike("="), edged).otherwise(w)

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def clean_sentences(sentences: Column) -> Column:
    """Sentences for display: blank ones and junk go, boxes become dashes and straight quotes apostrophes, artifacts and cut-out identifiers are put right."""
    from . import text as T

    plain = F.transform(F.filter(sentences, lambda s: F.trim(s) != ""), lambda s: artifacts_removed(F.replace(F.replace(F.trim(s), F.lit("\u25a0"), F.lit("-")), F.lit('"'), F.lit("'"))))
    apart = F.flatten(F.transform(plain, lambda s: around_identifiers(s)))
    return F.filter(F.transform(apart, lambda s: F.trim(s)), lambda s: ~T.is_junk(s))


def expanded(word: Column, full: dict[str, str]) -> Column:
    """An abbreviation's full form from a table of lower-case keys without full stops; any other word as it is."""
    if not full:
        return word
    table = F.create_map(*[F.lit(x) for kv in full.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.replace(word, F.lit("."), F.lit("")))), word)


def local_path(path: Column, foreign: str, own: str) -> Column:
    """A path with the separators of this system, the foreign base put for its own."""
    same = F.regexp_replace(path, r"[\\/]+", "/")
    base = foreign.replace("\\", "/").rstrip("/")
    return F.when(F.lower(same).startswith(base.lower()), F.concat(F.lit(own.rstrip("/")), F.substring(same, len(base) + 1, 1 << 30))).otherwise(same)


def first_year(said: Column) -> Column:
    """The first four digits in a row as a year; null without any."""
    return F.regexp_extract(said, "([0-9]{4})", 1).try_cast("int")


def page_name(page: Column) -> Column:
    return F.concat(F.lpad(page.cast("string"), 8, "0"), F.lit(".txt"))
