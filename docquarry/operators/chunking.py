"""Two-level chunking: sections by headings, sub-sections by summary titles, windows of sentences.

All of it is one projection per document - no shuffle, no Python. Folds run over headings and sentences, not lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import any_held, is_blank, let, lines, py, strip, unify_breaks, without_last_break
from .lines import heading_level, heading_title, may_bound, summary_boundary

_IN_LINE = r"[\s\x1c-\x1f&&[^\n]]"
_PART = "struct<path:string,text:string>"


def structural_sections(text: Column) -> Column:
    """Array of (path, text). H1 and H2 always open a section; H3 only when the buffered text, stripped, has at
    least twice the largest chunk. The path is the stack of titles above and including the section's heading."""
    parts = F.split(unify_breaks(text), py(rf"\n(?={_IN_LINE}*#{{1,3}}{_IN_LINE}+[^\s\x1c-\x1f])"), -1)
    units = let(parts, lambda p: F.transform(p, lambda x, i: F.when(i < F.size(p) - 1, F.concat(x, F.lit("\n"))).otherwise(x)))
    start = F.struct(
        F.array().cast("array<struct<level:int,title:string>>").alias("stack"),
        F.lit("").alias("buf"),
        F.array().cast(f"array<{_PART}>").alias("out"),
    )

    def push(a):
        part = F.struct(
            F.array_join(F.transform(a.stack, lambda s: s.title), " > ").alias("path"),
            without_last_break(a.buf).alias("text"),
        )
        return F.when(is_blank(a.buf), a.out).otherwise(F.concat(a.out, F.array(part)))

    def step(a, unit):
        line = F.substring_index(unit, "\n", 1)
        level = F.coalesce(heading_level(line), F.lit(0)).cast("int")
        opens = level.isin(1, 2) | ((level == 3) & (F.length(strip(a.buf)) >= 2 * rules.CHUNK_MAX))
        above = F.concat(
            F.filter(a.stack, lambda s: s.level < level),
            F.array(F.struct(level.alias("level"), F.coalesce(heading_title(line), F.lit("")).alias("title"))),
        )
        return F.when(opens, F.struct(above.alias("stack"), unit.alias("buf"), push(a).alias("out"))).otherwise(
            F.struct(a.stack.alias("stack"), F.concat(a.buf, unit).alias("buf"), a.out.alias("out"))
        )

    return F.aggregate(units, start, step, push)


def summary_sections(text: Column, unified: bool = False) -> Column:
    """Array of (path, text) of a section: each summary title after the first line with content opens a part and
    names it (path); one on the very first line names the first part; otherwise the name is empty. A text without any
    word of such titles is one part. ``unified``: its breaks are line feeds already."""

    def cut(all_lines, starts):
        def part(m, k):
            end = F.coalesce(F.get(starts, k + 1).i, F.size(all_lines))
            return F.struct(
                F.coalesce(m.title, F.lit("")).alias("path"),
                strip(F.array_join(F.slice(all_lines, m.i + 1, end - m.i), "\n")).alias("text"),
            )

        return F.filter(F.transform(starts, part), lambda p: p.text != "")

    def marked(all_lines):
        titled = F.filter(
            F.transform(all_lines, lambda x, i: F.struct(i.alias("i"), summary_boundary(x).alias("title"))),
            lambda m: (m.i == 0) | m.title.isNotNull(),
        )
        filled = F.array_min(
            F.filter(F.transform(all_lines, lambda x, i: F.when(~is_blank(x), i)), lambda i: i.isNotNull())
        )
        return let(
            filled,
            lambda first: let(
                F.filter(titled, lambda m: (m.i == 0) | (m.i > first)), lambda starts: cut(all_lines, starts)
            ),
        )

    def whole(t):
        part = F.struct(F.lit("").alias("path"), strip(t if unified else unify_breaks(t)).alias("text"))
        return F.filter(F.array(part), lambda p: p.text != "")

    cut_lines = let(F.split(without_last_break(text), "\n", -1) if unified else lines(text), marked)
    return F.when(~may_bound(text), whole(text)).otherwise(cut_lines)


def is_special(text: Column) -> Column:
    """Tables of two lines and more, numbered items and code blocks are never split."""
    hit = F.lit(False)
    for pattern, marks in zip(rules.SPECIAL_PATTERNS, rules.SPECIAL_MARKS, strict=True):
        hit = hit | (any_held(text, marks) & text.rlike(py(pattern)))
    return hit


def semantic_windows(text: Column) -> Column:
    """Array of texts: sentences gathered up to the largest chunk, each next one starting with the last characters
    of the one before; a tail of less than half the smallest chunk is dropped."""
    def ended(parts):
        return F.transform(parts, lambda x, i: F.when(i < F.size(parts) - 1, F.concat(x, F.lit("\n"))).otherwise(x))

    def cut(line):
        return F.when(any_held(line, "。！？；"), F.split(line, r"(?<=[。！？；])", -1)).otherwise(F.array(line))

    each = F.flatten(F.transform(let(F.split(text, "\n", -1), ended), cut))
    sentences = F.filter(each, lambda s: strip(s) != "")
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        fits = (F.length(a.buf) + F.length(s) <= rules.CHUNK_MAX) | (F.length(a.buf) < rules.CHUNK_MIN)
        return F.when(fits, F.struct(F.concat(a.buf, s).alias("buf"), a.out.alias("out"))).otherwise(
            F.struct(
                F.concat(F.right(a.buf, F.lit(rules.CHUNK_OVERLAP)), s).alias("buf"),
                F.concat(a.out, F.array(strip(a.buf))).alias("out"),
            )
        )

    return F.aggregate(
        sentences,
        start,
        step,
        lambda a: F.when(
            F.length(strip(a.buf)) >= rules.CHUNK_MIN // 2, F.concat(a.out, F.array(strip(a.buf)))
        ).otherwise(a.out),
    )


def scoped_path(section: Column, boundary: Column) -> Column:
    return (
        F.when(boundary == "", section)
        .when(section == "", boundary)
        .otherwise(F.concat(section, F.lit(" > "), boundary))
    )


def chunks_of(text: Column) -> Column:
    """Array of (path, text): all chunks of a document in order."""

    def sub(section):
        def cut(part):
            path = scoped_path(section.path, part.path)
            whole = is_special(part.text) | (F.length(part.text) <= rules.CHUNK_MAX)
            return F.transform(
                F.when(whole, F.array(strip(part.text))).otherwise(semantic_windows(part.text)),
                lambda t: F.struct(path.alias("path"), t.alias("text")),
            )

        return F.flatten(F.transform(summary_sections(section.text, unified=True), cut))

    return F.flatten(F.transform(structural_sections(text), sub))


def chunk_documents(docs: DataFrame, text_col: str = "body") -> DataFrame:
    """One row per chunk: the columns of ``docs`` without the text, chunk_index (from 0), section_path, text. Null
    and blank texts have no chunks."""
    kept = [c for c in docs.columns if c not in (text_col, "chunk_index", "section_path", "text")]
    rows = docs.select(
        *(F.col(f"`{c}`") for c in kept), F.posexplode(chunks_of(F.col(text_col))).alias("chunk_index", "_chunk")
    )
    return rows.select(
        *(F.col(f"`{c}`") for c in kept),
        "chunk_index",
        F.col("_chunk.path").alias("section_path"),
        F.col("_chunk.text").alias("text"),
    )
