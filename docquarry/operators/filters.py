"""Metadata predicates: request normalization, conjunctive filters, relaxation levels."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import strip

# Words that stand for a missing parameter; canonical document types.
MISSING_WORDS = ("string", "none", "null")
DOC_TYPE_ALIASES = {
    "软件需求规格说明书": "需求",
    "需求规格说明书": "需求",
    "需求": "需求",
    "软件概要设计说明书": "概要设计",
    "概要设计": "概要设计",
    "软件详细设计说明书": "详细设计",
    "详细设计": "详细设计",
    "软件开发计划书": "开发计划",
    "开发计划": "开发计划",
    "项目管理文档": "项目管理",
    "项目管理": "项目管理",
    "测试报告": "测试报告",
    "用户手册": "用户手册",
    "用户使用说明书": "用户手册",
    "项目总结报告": "项目总结",
    "项目总结": "项目总结",
    "总结报告": "项目总结",
    "人员分工": "人员分工",
}
TEMPLATE_ALIASES = {
    "软件需求规格说明书": "软件需求规格说明书",
    "需求": "软件需求规格说明书",
    "软件概要设计说明书": "软件概要设计说明书",
    "概要设计": "软件概要设计说明书",
    "软件详细设计说明书": "软件详细设计说明书",
    "详细设计": "软件详细设计说明书",
    "软件开发计划书": "软件开发计划书",
    "开发计划": "软件开发计划书",
    "测试报告": "测试报告",
    "迭代需求文档": "迭代需求文档",
    "项目管理文档": "项目管理文档",
    "项目管理": "项目管理文档",
    "项目总结": "项目总结",
    "项目总结报告": "项目总结",
    "用户手册": "用户手册",
    "用户使用说明书": "用户手册",
}
EQUAL_FIELDS = ("term", "phase", "doc_type", "project_id", "artifact_type")


def normalize_text(c: Column) -> Column:
    """Trimmed value; null for blanks and for words that stand for nothing."""
    held = strip(c)
    return F.when((held != "") & ~F.lower(held).isin(*MISSING_WORDS), held)


def normalize_list(c: Column) -> Column:
    """Trimmed items without missing ones; null if none is left."""
    held = F.filter(F.transform(c, normalize_text), lambda x: x.isNotNull())
    return F.when(F.size(held) > 0, held)


def normalize_value(value):
    """The same for a parameter on the driver (text or list)."""
    if value is None:
        return None
    if isinstance(value, (list, tuple)):
        return [v for v in map(normalize_value, (x for x in value if isinstance(x, str))) if v is not None] or None
    held = value.strip()
    return None if not held or held.lower() in MISSING_WORDS else held


def canonical_doc_type(c: Column, aliases=None) -> Column:
    """Canonical document type; unknown ones unchanged, blank ones null."""
    held = strip(c)
    table = F.create_map(*(F.lit(x) for pair in (aliases or DOC_TYPE_ALIASES).items() for x in pair))
    return F.when(held != "", F.coalesce(F.try_element_at(table, held), held))


def conjunction(
    term=None, phase=None, doc_type=None, project_id=None, quality_level=None, artifact_type=None
) -> Column | None:
    """Predicate of all given parameters; falsy ones add nothing; None if nothing is given. A missing field never
    matches."""
    given = {
        "term": term, "phase": phase, "doc_type": doc_type, "project_id": project_id, "artifact_type": artifact_type
    }
    parts = [F.col(k) == v for k, v in given.items() if v]
    if quality_level:
        parts.append(F.col("quality_level").isin(*quality_level))
    return reduce(and_, parts) if parts else None


def contains_any(c: Column, values: list[str]) -> Column:
    """An array column holds any of the values."""
    return F.arrays_overlap(c, F.array(*map(F.lit, values)))


def relaxed(term=None, phase=None, doc_type=None, project_id=None, quality_level=None, artifact_type=None) -> list[
    Column | None
]:
    """Predicates from strict to loose: all; without doc_type, quality and artifact; without phase; without term.
    project_id always stays; levels that add nothing are left out."""
    levels = [
        {"term": term, "phase": phase, "doc_type": doc_type, "project_id": project_id, "quality_level": quality_level, "artifact_type": artifact_type},
        {"term": term, "phase": phase, "project_id": project_id},
        {"term": term, "project_id": project_id},
        {"project_id": project_id},
    ]
    distinct = []
    for level in ({k: v for k, v in x.items() if v} for x in levels):
        if level not in distinct:
            distinct.append(level)
    return [conjunction(**level) for level in distinct]


def where(df, predicate: Column | None):
    return df if predicate is None else df.where(predicate)
