"""Identifiers, media types and addresses of catalogued files, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Media type and kind of content of each extension.
FILE_TYPES = {
    "pdf": ("application/pdf", "book"),
    "epub": ("application/epub+zip", "book"),
    "mobi": ("application/x-mobipocket-ebook", "book"),
    "azw": ("application/vnd.amazon.ebook", "book"),
    "azw3": ("application/vnd.amazon.ebook", "book"),
    "djvu": ("image/vnd.djvu", "book"),
    "fb2": ("application/x-fictionbook+xml", "book"),
    "txt": ("text/plain", "book"),
    "rtf": ("application/rtf", "book"),
    "doc": ("application/msword", "book"),
    "docx": ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "book"),
    "cbr": ("application/x-cbr", "comic"),
    "cbz": ("application/x-cbz", "comic"),
    "cb7": ("application/x-cb7", "comic"),
    "cbt": ("application/x-cbt", "comic"),
    "zip": ("application/zip", "archive"),
    "rar": ("application/x-rar-compressed", "archive"),
    "7z": ("application/x-7z-compressed", "archive"),
    "chm": ("application/vnd.ms-htmlhelp", "reference"),
}
# The library that numbers its volumes with each prefix.
LIBRARIES = {
    "39015": "mdp", "39076": "mdp", "49015": "mdp", "31951": "umn", "30112": "uiug", "31924": "coo", "32435": "osu", "31822": "uc1", "32106": "uc1", "31210": "uc1", "31175": "uc1", "31158": "uc1",
    "32044": "hvd", "30000": "inu", "39000": "inu", "33433": "nyp", "05917": "txu", "31858": "iau", "32101": "njp", "35556": "ien", "31262": "ufl", "32754": "pur1", "31293": "msu", "32108": "uga1",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def extension(file_name: Column) -> Column:
    return F.lower(F.regexp_extract(file_name, r"\.([^./\\]*)$", 1))


def media_type(file_name: Column) -> Column:
    return F.coalesce(_lookup({k: v[0] for k, v in FILE_TYPES.items()}, extension(file_name)), F.lit("application/octet-stream"))


def content_kind(file_name: Column) -> Column:
    return F.coalesce(_lookup({k: v[1] for k, v in FILE_TYPES.items()}, extension(file_name)), F.lit("unknown"))


def md5_in(file_name: Column) -> Column:
    """The first 32 hex digits in a row before the extension, in lower case; null without any."""
    return F.lower(F.nullif(F.regexp_extract(F.regexp_replace(file_name, r"\.[^.]*$", ""), "([a-fA-F0-9]{32})", 1), F.lit("")))


def volume_id(folder: Column) -> Column:
    """A volume's public id from its folder's name: library and number, whose separating letter is a zero; archival keys stay."""
    library, rest = _lookup(LIBRARIES, F.substring(folder, 1, 5)), F.regexp_replace(F.substring(folder, 6, 1 << 30), r"^\p{L}", "0")
    numbered = F.concat(library, F.lit("."), F.substring(folder, 1, 5), rest)
    return F.when(folder.rlike("^ark(\\+=|:/)"), folder).otherwise(F.coalesce(numbered, F.replace(folder, F.lit("+"), F.lit("."))))


def is_viewable(volume: Column) -> Column:
    return ~volume.rlike(r"^ark(:|\+=)") & F.contains(volume, F.lit(".")) & ~F.contains(volume, F.lit("/"))


def page_url(base: str, volume: Column, page: Column) -> Column:
    """base?id=...&seq=page; null for volumes that no viewer shows."""
    return F.when(is_viewable(volume), F.concat(F.lit(base + "?id="), F.replace(F.url_encode(volume), F.lit("+"), F.lit("%20")), F.lit("&seq="), page.cast("string")))


def identifier(file_name: Column, kind: Column) -> Column:
    """(id, kind, md5) of a file by the kind its collection is known for: aacid, htid and ia_id are names without extension; all else is a digest.

    A file of an aacid collection that is not named so is known by its digest. Without a digest the id is null.
    """
    name = F.regexp_extract(file_name, r"([^/\\]*)$", 1)
    bare, digest = F.regexp_replace(name, r"\.[^.]*$", ""), md5_in(name)
    said = F.when((F.lower(kind) == "aacid") & F.startswith(F.lower(name), F.lit("aacid__")), "aacid").when(F.lower(kind).isin("htid", "ia_id"), F.lower(kind)).otherwise("md5")
    by_digest = said == "md5"
    return F.struct(F.when(by_digest, digest).otherwise(bare).alias("id"), said.alias("kind"), F.when(by_digest, digest).alias("md5"))
