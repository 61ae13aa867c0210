"""Line and page operators: noise, cleaning, virtual pages, headings, tables, PDF lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import any_held, let, lines, py, strip


def remove_noise(text: Column) -> Column:
    """Drop template lines."""

    def noise(line):
        hit = F.lit(False)
        for pattern in rules.NOISE_PATTERNS:
            hit = hit | strip(line).rlike(py(pattern.replace("$", r"\z") if pattern.endswith("$") else pattern))
        return hit

    return F.array_join(F.filter(lines(text), lambda x: ~noise(x)), "\n")


def clean_line(line: Column) -> Column:
    """Remove control characters except tab and breaks, shorten three and more spaces to two, strip."""
    return strip(F.regexp_replace(F.regexp_replace(line, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r" {3,}", "  "))


def virtual_pages(text: Column) -> Column:
    """Array of sections: a new one at each H1 or H2 line when something is buffered; stripped, empty ones dropped."""
    joined = F.array_join(lines(text), "\n")
    return F.filter(F.transform(F.split(joined, r"(?<=\n)(?=#{1,2} )", -1), strip), lambda x: x != "")


def heading_level(line: Column) -> Column:
    """Level of a heading line (1-6), else null."""
    marks = F.regexp_extract(strip(line), py(r"\A(#{1,6})\s+(.+)\z"), 1)
    return F.when(marks != "", F.length(marks))


def heading_title(line: Column) -> Column:
    return F.when(heading_level(line).isNotNull(), strip(F.regexp_extract(strip(line), py(r"\A(#{1,6})\s+(.+)\z"), 2)))


def first_heading(text: Column) -> Column:
    """First line that starts with ``#``, without its marks; empty if there is none."""
    return F.coalesce(
        strip(
            F.regexp_replace(
                F.try_element_at(F.filter(lines(text), lambda x: x.startswith("#")), F.lit(1)), r"\A#+", ""
            )
        ),
        F.lit(""),
    )


def heading_from_size(size: Column, bold: Column) -> Column:
    """Markdown prefix for a font size."""
    return F.when(size >= 18, "# ").when(size >= 15, "## ").when(size >= 13, "### ").when((size >= 11) & bold, "#### ")


def heading_from_style(style: Column) -> Column:
    """Heading level for a paragraph style name; null for other styles."""
    low, out = strip(F.lower(style)), F
    for n in (1, 2, 3):
        out = out.when(low.contains(f"heading {n}") | style.contains(f"标题 {n}"), n)
    return out.when(low.contains("heading") | style.contains("标题"), 4)


def table_to_markdown(rows: Column) -> Column:
    """Markdown for ``array<array<string>>``: rows without content dropped, cells on one line, rows padded to the
    widest, the first row as header; empty text if nothing is left."""
    held = F.filter(
        rows,
        lambda r: F.exists(F.coalesce(r, F.array().cast("array<string>")), lambda c: F.coalesce(c, F.lit("")) != ""),
    )
    cells = F.transform(
        held, lambda r: F.transform(r, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))))
    )
    width = F.array_max(F.transform(cells, F.size))
    full = F.transform(cells, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))

    def line(r):
        return F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    body = F.when(F.size(full) > 1, F.slice(full, F.lit(2), F.size(full))).otherwise(
        F.array(F.array_repeat(F.lit(""), width))
    )
    text = F.array_join(
        F.concat(F.array(line(full[0]), line(F.array_repeat(F.lit("---"), width))), F.transform(body, line)), "\n"
    )
    return F.when(F.size(held) > 0, text).otherwise("")


def image_note(count: Column) -> Column:
    return F.when(
        count > 0, F.concat(F.lit("> [图例：本页包含 "), count.cast("string"), F.lit(" 张图片/架构图，详情请参考原始文档。]"))
    ).otherwise("")


def rebuild_lines(words: DataFrame) -> DataFrame:
    """Lines from positioned words. ``words``: doc, page, seq, text, fontname, size, top. A word joins the line of
    the word before it while their rounded tops differ by less than 3. Output: doc, page, line, text."""
    order = Window.partitionBy("doc", "page").orderBy("seq")
    y = F.bround(F.coalesce("top", F.lit(0.0)), 1)
    placed = words.withColumn("_y", y).withColumn(
        "_new", (F.abs(F.col("_y") - F.lag("_y").over(order)) >= 3).cast("int")
    )
    placed = placed.withColumn("line", F.sum(F.coalesce("_new", F.lit(0))).over(order))
    made = placed.groupBy("doc", "page", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda w: w.text), " ").alias(
            "_text"
        ),
        F.avg(F.coalesce("size", F.lit(10.0))).alias("_size"),
        F.max(F.coalesce("fontname", F.lit("")).rlike("Bold|bold")).alias("_bold"),
    )
    return made.select(
        "doc",
        "page",
        "line",
        F.concat(
            F.coalesce(heading_from_size(F.col("_size"), F.col("_bold")), F.lit("")), clean_line(F.col("_text"))
        ).alias("text"),
    )


def normalize_title(title: Column) -> Column:
    return F.regexp_replace(strip(title), py(rf"[：:。；;\-—\s\x1c-\x1f]+\z"), "")


def may_bound(text: Column) -> Column:
    """Whether a text holds one of the words of which every title of a summary holds one."""
    return any_held(text, ("小结", "总结", "结论", "回顾"))


def summary_boundary(line: Column) -> Column:
    """Title of a line that opens a summary, else null. Every such title holds one of four words; lines without them are
    settled by that."""

    def boundary(title):
        short = (
            (F.length(title) <= 32)
            & (title.contains("小结") | title.endswith("总结") | title.endswith("结论"))
            & title.rlike(py(rf"\A{rules.SUMMARY_CHARACTERS}\z"))
        )
        return F.when((title != "") & (title.rlike(py(rules.SUMMARY_TITLE)) | short), title)

    return F.when(may_bound(line), let(normalize_title(F.coalesce(heading_title(line), strip(line))), boundary))
