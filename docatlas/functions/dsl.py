"""Words with codes: a token's suffix after its last dot tells case, spacing, quotes and marks. Parsing is in text.dsl_parsed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

_HAS = lambda flags, bit: flags.bitwiseAND(F.lit(T.FLAGS[bit])) != 0
_CODES = {v: k for k, v in T.MARKS.items()}


def parsed(tokens: Column) -> Column:
    """Tokens to (text, flags, mark); one that begins with < is raw."""
    return F.transform(tokens, lambda t: F.when(t.startswith("<"), F.struct(t.alias("text"), F.lit(T.FLAGS["r"]).alias("flags"), F.lit("").alias("mark"))).otherwise(T.dsl_parsed(t)))


def compiled(word: Column) -> Column:
    """(text, flags, mark) to a token, with codes in their order: opening quote, case, mark, closing quote, no space, raw."""
    mark = reduce(lambda c, kv: c.when(word["mark"] == kv[0], kv[1]), _CODES.items(), F.when(F.lit(False), "")).otherwise("")
    code = lambda k: F.when(_HAS(word["flags"], k), k).otherwise("")
    raw = F.when(_HAS(word["flags"], "r") & ~word["text"].startswith("<"), "r").otherwise("")
    said = F.concat(code("qo"), F.when(_HAS(word["flags"], "U"), "U").otherwise(code("u")), mark, code("qc"), code("ns"), raw)
    return F.when(said == "", word["text"]).otherwise(F.concat(word["text"], F.lit("."), said))


def shown(word: Column) -> Column:
    """A word as a reader sees it, without the space before it."""
    cased = F.when(_HAS(word["flags"], "U"), T.capitals(word["text"])).when(_HAS(word["flags"], "u"), F.concat(T.capitals(F.left(word["text"], F.lit(1))), F.substring(word["text"], 2, 1 << 30))).otherwise(word["text"])
    quote = lambda k: F.when(_HAS(word["flags"], k), '"').otherwise("")
    return F.when(_HAS(word["flags"], "r"), word["text"]).otherwise(F.concat(quote("qo"), cased, word["mark"], quote("qc")))


def rendered(words: Column) -> Column:
    """Parsed words as one text: a space before each but the first and those without space."""
    return F.array_join(F.transform(words, lambda w, i: F.concat(F.when((i == 0) | _HAS(w["flags"], "ns"), "").otherwise(" "), shown(w))), "")


def marked_up(words: Column) -> Column:
    """Parsed words as marked-up text: as rendered(), but tags and raw words stand as they are between their quotes and marks."""

    def one(w: Column, i: Column) -> Column:
        space = F.when((i == 0) | _HAS(w["flags"], "ns"), "").otherwise(" ")
        bare = F.when(_HAS(w["flags"], "r"), w["text"]).when(_HAS(w["flags"], "U"), T.capitals(w["text"])).when(_HAS(w["flags"], "u"), F.concat(T.capitals(F.left(w["text"], F.lit(1))), F.substring(w["text"], 2, 1 << 30))).otherwise(w["text"])
        return F.concat(space, F.when(_HAS(w["flags"], "qo"), '"').otherwise(""), bare, w["mark"], F.when(_HAS(w["flags"], "qc"), '"').otherwise(""))

    return F.array_join(F.transform(words, one), "")


def for_embedding(words: Column) -> Column:
    """Text of parsed words without tags and raw tokens, as plain words."""
    kept = F.filter(words, lambda w: ~_HAS(w["flags"], "r") & ~w["text"].startswith("<"))
    return F.trim(rendered(kept))


def content_length(token: Column) -> Column:
    """Characters of a token without a suffix of the form .Name(), 4095 at most."""
    return F.least(F.lit(4095), F.length(F.regexp_replace(token, r"\.[A-Za-z_]\w*\(\)$", "")))


def is_tag(token: Column) -> Column:
    return F.trim(token).rlike(r"^<[^>]*>$")


def is_content(token: Column) -> Column:
    """Not blank, no tag, and if of one character an English letter."""
    t = F.trim(token)
    return (t != "") & ~is_tag(token) & ((F.length(t) > 1) | t.rlike("^[A-Za-z]$"))


def is_punctuation(token: Column) -> Column:
    return F.trim(token).rlike(r"^[\p{P}\p{S}]+$")


def is_numeric(token: Column) -> Column:
    return F.trim(token).rlike(r"^[+-]?[0-9]+([.,][0-9]+)*$")


def is_single_word(token: Column) -> Column:
    return (F.trim(token) != "") & ~F.trim(token).rlike(r"\s")


def content_words(tokens: Column) -> Column:
    """How many tokens are content, 255 at most."""
    return F.least(F.lit(255), F.size(F.filter(tokens, is_content)))


def interspersed(words: Column, between: str = " ") -> Column:
    """Words with `between` after each but the last."""
    return F.flatten(F.transform(words, lambda w, i: F.when(i < F.size(words) - 1, F.array(w, F.lit(between))).otherwise(F.array(w))))


def appended(left: Column, right: Column) -> Column:
    """left and right with one space between them, unless either is empty, left ends with a blank or right begins with a mark or blank."""
    close = (left == "") | (right == "") | left.rlike(r"\s$") | right.rlike(r"^[\s.,;:!?)\]}]")
    return F.when(close, F.concat(left, right)).otherwise(F.concat_ws(" ", left, right))


def windows(tokens: Column, least: int = 350, overlap: int = 1) -> Column:
    """Compiled tokens of sentences (arrays) gathered until `least` words; the last `overlap` sentences open the next window.

    Blanks that stand alone are dropped, and a mark after a word becomes a part of it. tokens: an array of sentences, each an array of tokens.
    """
    squeezed = F.transform(tokens, lambda s: _squeezed(F.filter(s, lambda t: F.trim(t) != "")))
    zero = F.struct(F.array().cast("array<array<string>>").alias("held"), F.lit(0).alias("words"), F.array().cast("array<array<string>>").alias("out"), F.lit(False).alias("fresh"))

    def step(a: Column, s: Column) -> Column:
        held = F.array_append(a["held"], s)
        words = a["words"] + F.size(F.filter(s, is_content))
        tail = F.slice(held, F.greatest(F.lit(1), F.size(held) - overlap + 1), F.lit(overlap)) if overlap else F.array().cast("array<array<string>>")
        count = F.aggregate(tail, F.lit(0), lambda n, x: n + F.size(F.filter(x, is_content)))
        more = F.struct(held.alias("held"), words.alias("words"), a["out"].alias("out"), F.lit(True).alias("fresh"))
        closed = F.struct(tail.alias("held"), count.alias("words"), F.array_append(a["out"], F.flatten(held)).alias("out"), F.lit(False).alias("fresh"))
        return F.when(words >= least, closed).otherwise(more)

    return F.aggregate(squeezed, zero, step, lambda a: F.when(a["fresh"], F.array_append(a["out"], F.flatten(a["held"]))).otherwise(a["out"]))


def _squeezed(tokens: Column) -> Column:
    """Marks . , ? ! as codes of the word before them."""
    code = lambda t: reduce(lambda c, kv: c.when(t == kv[0], kv[1]), _CODES.items(), F.when(F.lit(False), ""))
    follows = lambda i: F.coalesce(F.get(tokens, i + 1), F.lit(""))
    joined = F.transform(tokens, lambda t, i: F.when(t.rlike(r"[\p{L}\p{N}]$") & follows(i).isin(*_CODES), F.concat(t, F.lit("."), code(follows(i)))).otherwise(t))
    before = lambda i: F.when(i > 0, F.get(tokens, i - 1)).otherwise("")
    return F.filter(joined, lambda t, i: ~(t.isin(*_CODES) & before(i).rlike(r"[\p{L}\p{N}]$")))


def word_stream(words: Column, start: int = 0, size: int | None = None, flags: int = 0, kind: str = "all") -> Column:
    """Parsed words from a place on, the range clamped to what is there, with all of the flags, content or tags only if asked for."""
    some = F.slice(words, max(0, start) + 1, size) if size is not None else F.slice(words, max(0, start) + 1, 1 << 30)
    if flags:
        some = F.filter(some, lambda w: w["flags"].bitwiseAND(F.lit(flags)) == flags)
    return F.filter(some, lambda w: is_content(w["text"])) if kind == "content" else F.filter(some, lambda w: is_tag(w["text"])) if kind == "tags" else some
