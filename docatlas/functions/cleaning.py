"""Repairs of mail and scan artifacts, and names and terms of a text, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# A first and a last name, in which a stray = may stand for a letter.
_NAME = r"[A-Z=][a-z=]+(?:\s+[A-Z=]\.?)?\s+[A-Z=][a-z=]{1,20}"
# Where names stand in headers, greetings and appointments.
NAME_PATTERNS = (
    rf"(?:From|To|Cc|Bcc|Sent\s*(?:by)?)\s*:\s*({_NAME})",
    rf"(?:From|To|Cc|Bcc)\s*:\s*({_NAME})\s*<",
    rf"(?:To|Cc|Bcc)\s*:\s*(?:(?:{_NAME})\s*;\s*)*({_NAME})",
    r"\b(?:Dear|Hi|Hello|Attn)\s+([A-Z=][a-z=]+(?:\s+[A-Z=][a-z=]{1,20})?)",
    r"\b(?:w/|with|meeting\s+with|Appt\s+w/|LUNCH\s+w/)\s+([A-Z=][a-z=]+(?:\s+[A-Z=][a-z=]{1,20}))",
)
TERM_PATTERN = r"\b([A-Z=][a-z=]{2,15}\s+[A-Z=][a-z=]{2,20})\b"
# Words with which no name begins.
NO_FIRST_WORDS = (
    "sent", "hello", "dear", "hey", "the", "this", "that", "your", "our", "my", "from", "date", "subject", "reply", "forward", "original", "attachment", "please", "thanks",
    "thank", "best", "kind", "warm", "good", "look", "flight", "stem", "med", "image", "file", "case", "help", "earth", "click", "view", "open", "read", "copy", "save", "print",
    "delete", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "san", "new", "south", "north", "east", "west", "los", "santa", "palm",
)
# Pairs of capitalised words that are no terms.
COMMON_PHRASES = (
    "sent from", "original message", "court order", "court document", "new york", "los angeles", "san francisco", "santa monica", "palm beach", "united states", "south florida",
    "southern district", "northern district", "dear sir", "dear madam", "good morning", "good afternoon", "good evening", "best regards", "kind regards", "warm regards", "many thanks",
    "please note", "for immediate", "private communication", "all rights", "rights reserved", "east street", "west street", "north street", "south street",
    "monday morning", "tuesday morning", "wednesday morning", "thursday morning", "friday morning", "saturday morning", "sunday morning", "january february", "february march",
    "unauthorized use", "your email", "this email", "this message", "earth link", "flash player", "internet explorer", "microsoft office", "google chrome", "apple inc", "subject line",
    "read receipt", "return receipt", "thank you", "look forward", "property list", "attachment name", "cell number", "phone number", "office number", "image format", "file size",
    "file name", "date received", "help save", "feminine care", "gillette blade", "building entrance", "front door", "attorney client", "inside information", "strictly prohibited",
)


def mime_decoded(text: Column) -> Column:
    """=XX becomes its printable ASCII character, a blank for CR and LF, and nothing otherwise; decoded signs aren't read again."""
    parts = F.split(text, "=", -1)

    def one(p: Column) -> Column:
        code = F.conv(F.substring(p, 1, 2), 16, 10).cast("int")
        char = F.when(code.isin(10, 13), " ").when(code.between(32, 126), F.char(code)).otherwise("")
        return F.when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(char, F.substring(p, 3, 1 << 30))).otherwise(F.concat(F.lit("="), p))

    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(one(p))), "")


def mime_cleaned(text: Column) -> Column:
    """Decoded, without soft line breaks and without = inside words, before words and between a word and its mark."""
    strays = (r"=\r?\n", r"(?<=[a-zA-Z])=(?=[a-zA-Z])", r"(?<=\s|^)=(?=[a-zA-Z])", r"(?<=[a-zA-Z])=(?=[)\]}>.,;:!?/])")
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), strays, mime_decoded(text))


def unglued(text: Column) -> Column:
    """A blank where lower meets upper case, a mark a letter (not inside numbers, addresses and contractions), or a possessive its noun."""
    seams = (r"(?<=\p{Ll})(?=\p{Lu})", r"(?<=['’.])(?=\p{Lu})", r"(?<=[\p{P}&&[^'’.]])(?=\p{L})", r"(?<=\.)(?=[\p{L}&&[^\p{Ll}\p{Lu}]])", r"(?<=['’]s)(?=\p{Ll})")
    return F.regexp_replace(text, "|".join(seams), " ")


# Header and day words that a name does not end with.
CLOSING_WORDS = ("sent", "from", "to", "cc", "subject", "date", "re", "fwd", "mon", "tue", "wed", "thu", "fri", "sat", "sun")
# Signs at the edges of what was found that belong to no name, and signs that no name holds.
_EDGE, _NEVER = r"[\s\d<>\[\]@.,;:!?\-_/\\()]", r"\s\d@#$%^&*(){}|<>"


def cleaned_name(name: Column) -> Column:
    """The words of a name without stray =, without signs at its edges and without one closing word."""
    bare = F.regexp_replace(name, f"^{_EDGE}+|{_EDGE}+$", "")
    words = F.filter(F.split(F.replace(bare, F.lit("=")), r"\s+"), lambda w: w != "")
    closes = (F.size(words) > 1) & F.lower(F.try_element_at(words, F.lit(-1))).isin(*CLOSING_WORDS)
    return F.array_join(F.when(closes, F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words), " ")


def is_name(name: Column) -> Column:
    """Two words or more, the first and the last of two letters at least, without digits and signs, that do not begin as no name does."""
    shape = f"^[^{_NEVER}]{{2,}}(?: [^{_NEVER}]+)* [^{_NEVER}]{{2,}}$"
    return name.rlike(shape) & ~F.lower(F.substring_index(name, " ", 1)).isin(*NO_FIRST_WORDS)


def _once(names: Column) -> Column:
    """The first spelling of each, whatever its case, in order of code points."""
    lowered = F.transform(names, lambda n: F.lower(n))
    return F.array_sort(F.filter(names, lambda n, i: F.array_position(lowered, F.lower(n)) == i + 1))


def _found(text: Column, patterns: tuple[str, ...]) -> Column:
    hits = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns))
    return F.filter(F.transform(hits, cleaned_name), is_name)


def people(text: Column, head: int = 8000) -> Column:
    """Names that headers, greetings and appointments hold, among the first `head` characters."""
    return _once(_found(F.substring(text, 1, head), NAME_PATTERNS))


def terms(text: Column, names: Column, head: int = 8000, phrases: tuple[str, ...] = COMMON_PHRASES) -> Column:
    """Pairs of capitalised words that are neither names (as people() gives them) nor common phrases, to which a caller may add those of a collection."""
    lowered = F.transform(names, lambda n: F.lower(n))
    free = F.filter(_found(F.substring(text, 1, head), (TERM_PATTERN,)), lambda t: ~F.lower(t).isin(*phrases) & ~F.array_contains(lowered, F.lower(t)))
    return _once(free)


def is_contraction(word: Column, suffix: Column) -> Column:
    """Letters before an apostrophe and one of the known endings after it; t only after n."""
    s = F.lower(suffix)
    return s.isin("t", "nt", "m", "re", "ve", "ll", "d", "s") & word.rlike(r"^\p{L}+$") & ((s != "t") | F.lower(word).endswith("n"))
