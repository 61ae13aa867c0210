"""Text helpers with Python's notion of blanks, lines and regex classes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as ``str.strip`` sees it: Unicode White_Space and the four information separators.
BLANK = r"[\s\x1c-\x1f]"
#: The same characters one by one.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Line breaks of ``str.splitlines``.
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"

#: Those that are no line feed. Most texts hold none, and to look for them costs less than the pattern.
ODD_BREAKS = ("\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")


def py(pattern: str) -> str:
    """Java pattern with Python's defaults: Unicode classes, and ``.`` stopping at line feeds only."""
    return "(?Ud)" + pattern


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once: inside a lambda an outer expression would be evaluated for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def any_held(text: Column, words) -> Column:
    """Whether a text holds any of ``words``."""
    hit = F.lit(False)
    for w in words:
        hit = hit | text.contains(w)
    return hit


def strip(c: Column) -> Column:
    """Without the blanks at both ends: only these are looked at, where a pattern would try each blank of the text."""
    return F.btrim(c, F.lit(BLANKS))


def without_last_break(c: Column) -> Column:
    """Without the last character, if it is a line feed."""
    return F.when(c.endswith("\n"), F.left(c, F.length(c) - 1)).otherwise(c)


def unify_breaks(c: Column) -> Column:
    """Lines joined by line feeds, without a last break."""
    return let(F.when(any_held(c, ODD_BREAKS), F.regexp_replace(c, BREAK, "\n")).otherwise(c), without_last_break)


def lines(c: Column) -> Column:
    """``str.splitlines``: no element for what follows the last break."""
    each = F.when(any_held(c, ODD_BREAKS), F.split(c, BREAK, -1)).otherwise(F.split(c, "\n", -1))
    return let(
        each, lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    )


def is_blank(c: Column) -> Column:
    return ~c.rlike(py(r"[^\s\x1c-\x1f]"))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def file_stem(name: Column) -> Column:
    """Name without its last suffix; a leading dot does not start a suffix, a trailing one neither."""
    return F.when(name.rlike(r"(?s)\A.+\.[^.]+\z"), F.regexp_replace(name, r"\.[^.]+\z", "")).otherwise(name)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"(?s)\A.+(\.[^.]+)\z", 1))
