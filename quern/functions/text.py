"""Scalar functions over text columns; all native Spark expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.cleaning import as_col


def ascii_lower(c: Column | str) -> Column:
    """A-Z to a-z, every other letter as it is."""
    return F.translate(as_col(c), string.ascii_uppercase, string.ascii_lowercase)


def lines(c: Column | str) -> Column:
    """Lines of a text without their ends; a last empty line is none."""
    text = F.regexp_replace(as_col(c), "\r\n", "\n")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    )


def collapsed(c: Column | str) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(as_col(c), r"\s+", " "))


def preview(c: Column | str, most: int) -> Column:
    """First line, trimmed; beyond `most` characters it ends in three dots."""
    first = F.trim(F.regexp_replace(F.substring_index(as_col(c), "\n", 1), "\r$", ""))
    return F.when(F.length(first) > most, F.concat(F.substring(first, 1, most - 3), F.lit("..."))).otherwise(first)


def display_name(c: Column | str) -> Column:
    """White space collapsed; beyond 40 characters 37 and three dots."""
    text = collapsed(c)
    return F.when(F.length(text) > 40, F.concat(F.substring(text, 1, 37), F.lit("..."))).otherwise(text)


def ellipsis(c: Column | str, most: int) -> Column:
    """White space collapsed, at most `most` characters, dots included."""
    text = collapsed(c)
    if most <= 3:
        return F.when(F.length(text) <= most, text).otherwise(F.lit("." * most))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most - 3), F.lit("...")))


#: Languages whose qualified names are joined by dots; the others use two colons.
DOTTED = ("python", "javascript", "typescript", "go", "swift")


def separator(language: Column | str) -> Column:
    return F.when(as_col(language).isin(*DOTTED), ".").otherwise("::")


def nesting_depth(display_path: Column | str, language: Column | str) -> Column:
    """How many separators a qualified name has; 0 for none or null."""
    path = F.coalesce(as_col(display_path), F.lit(""))
    sep = separator(language)
    return ((F.length(path) - F.length(F.replace(path, sep, F.lit("")))) / F.length(sep)).cast("int")


def duration(seconds: Column | str) -> Column:
    """1.50s below a minute, 2m 3.25s from there on."""
    s = as_col(seconds)
    minutes = F.floor(s / 60)
    return F.when(s >= 60, F.format_string("%dm %.2fs", minutes, s - minutes * 60)).otherwise(F.format_string("%.2fs", s))


def plural(count: Column, word: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {word}"), F.when(count == 1, "").otherwise("s"))


def staleness_reason(head_changed: Column, files_changed: Column) -> Column:
    """Why an index is out of date, in words; empty when it is not."""
    head = F.when(head_changed, F.lit("HEAD changed since the last save"))
    files = F.when(files_changed > 0, F.concat(plural(files_changed, "indexed file"), F.lit(" changed on disk")))
    return F.concat_ws("; ", head, files)


def id_prefix(c: Column | str) -> Column:
    """What precedes the first hyphen of an id; component where nothing does."""
    head = F.substring_index(as_col(c), "-", 1)
    return F.when(head != "", head).otherwise("component")


def type_prefix(c: Column | str) -> Column:
    """A kind as a prefix for ids: lower ASCII letters and digits, the rest one underscore."""
    text = F.regexp_replace(F.regexp_replace(ascii_lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(text != "", text).otherwise("component")


def indent_width(line: Column | str) -> Column:
    """Columns before the first other sign: a blank counts 1, a tab 4."""
    lead = F.regexp_extract(as_col(line), r"^[ \t]*", 0)
    return F.length(F.replace(lead, F.lit("\t"), F.lit("    ")))


#: File extensions and the languages they stand for (fixed values).
EXTENSIONS = {
    "rs": "rust", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python",
    "go": "go", "zig": "zig", "swift": "swift", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp",
    "hpp": "cpp", "hh": "cpp", "hxx": "cpp",
}
#: Short names of languages (fixed values).
LANGUAGE_ALIASES = {"rs": "rust", "py": "python", "js": "javascript", "ts": "typescript"}
LANGUAGES = ("rust", "javascript", "typescript", "python", "go", "zig", "c", "cpp", "swift")


def detected_language(path: Column | str) -> Column:
    """Language by the extension of a path, whatever its case; null for others."""
    table = F.create_map(*(F.lit(x) for kv in EXTENSIONS.items() for x in kv))
    return F.element_at(table, ascii_lower(F.regexp_extract(as_col(path), r"[^/]\.([^./]+)$", 1)))


def normal_language(name: str) -> str:
    """The language a user means; ValueError for unknown ones."""
    lower = name.strip().lower()
    language = LANGUAGE_ALIASES.get(lower, lower)
    if language not in LANGUAGES:
        raise ValueError(f"unsupported language {name!r}; known: {', '.join(LANGUAGES)}")
    return language


def content_hash(c: Column | str) -> Column:
    """SHA-256 of a text's or a binary's bytes, in hex."""
    return F.sha2(as_col(c).cast("binary"), 256)


def decoded(content: Column | str) -> Column:
    """Bytes as text; what is no UTF-8 becomes the replacement character."""
    return F.call_function("make_valid_utf8", as_col(content).cast("string"))
