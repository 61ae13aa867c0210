"""Rule-based metadata of chunks as one projection: no Python, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import any_held, file_name, let, py


def year_of(path: Column) -> Column:
    found = F.regexp_extract(path, py(rules.YEAR_PATTERN), 1)
    return F.when(found != "", found.cast("int"))


def term_of(path: Column) -> Column:
    return first(rules.TERM_RULES, path, True)


def first(table, text: Column, fold: bool = False) -> Column:
    return rules.first_keyword(text, table, fold)


def doc_type_of(name: Column) -> tuple[Column, Column]:
    """(doc_type, phase) from file name and first heading."""
    return rules.first_match(name, rules.DOC_TYPE_RULES, 1), rules.first_match(name, rules.DOC_TYPE_RULES, 2)


def project_of(path: Column) -> Column:
    """Slug of the parent folder; null for a year or term folder or no folder."""
    parent = F.when(path.rlike(r"\A/+[^/]+/*\z"), F.lit("/")).otherwise(
        F.regexp_extract(path, r"([^/]+)/+[^/]+/*\z", 1)
    )
    usable = (parent != "") & ~parent.rlike(rf"(?iUd)\A(?:{rules.NOT_A_PROJECT})\z")
    return F.when(usable, F.substring(F.regexp_replace(parent, py(r"[^\w\-]"), "_"), 1, 32))


def ids_of(text: Column, pattern: str, marks) -> Column:
    """Sorted distinct matches. ``marks``: texts one of which every match holds."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(py(pattern)), F.lit(0))))
    return F.when(~any_held(text, marks), F.array().cast("array<string>")).otherwise(found)


def keywords_of(text: Column, *lists) -> Column:
    """Struct of an array for each list: its words that the text holds. The text is lower-cased once."""

    def held(low):
        return F.struct(*(F.filter(F.array(*map(F.lit, words)), lambda k: low.contains(k)) for words in lists))

    return let(F.lower(text), held)


def trace_edges(req: Column, test: Column, design: Column) -> Column:
    """For each requirement its test edges, then its design edges."""

    def edges(r):
        return F.transform(F.concat(test, design), lambda t: F.struct(r.alias("from"), t.alias("to")))

    return F.flatten(F.transform(req, edges))


def quality_of(text: Column) -> tuple[Column, Column]:
    """(level, certainty)."""
    signs = [
        (any_held(text, rules.REQ_MARKS) & text.rlike(py(rules.REQ_PATTERN)))
        | (any_held(text, rules.TEST_MARKS) & text.rlike(py(rules.TEST_PATTERN))),
        rules.occurs(text, rules.METRIC_PATTERN),
        text.contains("```"),
        rules.occurs(text, rules.TABLE_PATTERN),
    ]
    score = sum((s.cast("int") for s in signs[1:]), signs[0].cast("int"))
    high, low = (score >= 2) & (F.length(text) >= 200), F.length(text) < 80
    return F.when(high, "high").when(low, "low").otherwise("medium"), F.when(high, 0.80).when(low, 0.75).otherwise(0.70)


def chunk_id(year: Column, term: Column, project: Column, doc_type: Column, index: Column, text: Column) -> Column:
    def known(c, n=None):
        c = F.coalesce(F.when(c != "", c), F.lit("unk"))
        return F.substring(c, 1, n) if n else c

    return F.concat_ws(
        "-",
        known(year.cast("string")),
        F.replace(known(term), F.lit(" "), F.lit("")),
        known(project, 12),
        known(doc_type, 8),
        index.cast("string"),
        F.substring(F.md5(F.encode(F.substring(text, 1, 50), "UTF-8")), 1, 6),
    )


def confidences(df: DataFrame) -> DataFrame:
    """Add the struct ``confidence`` and its weighted mean ``_overall``."""

    def when(name, value):
        return F.when(F.col(name).isNotNull(), F.lit(value)).otherwise(0.0)

    conf = {
        "year": when("year", 1.0),
        "term": when("term", 1.0),
        "doc_type": when("doc_type", 0.98),
        "phase": when("doc_type", 0.98),
        "project_id": when("project_id", 0.90),
        "artifact_type": when("artifact_type", 0.85),
        "evidence_type": when("evidence_type", 0.85),
        "status": when("status", 0.80),
        "quality_level": F.col("_quality"),
    }
    total = F.lit(0.0)
    for name, weight in rules.CONFIDENCE_WEIGHTS:
        total = total + conf[name] * weight
    return df.withColumns(
        {
            "confidence": F.struct(*(c.alias(n) for n, c in conf.items())),
            "_overall": total / sum(w for _, w in rules.CONFIDENCE_WEIGHTS),
        }
    )


def with_metadata(
    chunks: DataFrame,
    path_col: str = "file_path",
    heading_col: str = "first_heading",
    course: str = rules.COURSE,
    override: dict | None = None,
    recompute: bool = False,
) -> DataFrame:
    """All metadata columns of each chunk (chunk_index, section_path, text, a path and the first heading).

    ``override`` holds project_id, term, year; truthy values replace what was inferred. chunk_id, confidence and the
    review flag keep describing the inferred values unless ``recompute``.
    """
    path, text, index = F.col(path_col), F.col("text"), F.col("chunk_index")
    doc_type, phase = doc_type_of(F.concat(file_name(path), F.lit(" "), F.col(heading_col)))
    level, certainty = quality_of(text)
    given = {k: v for k, v in (override or {}).items() if v}
    inferred = {"year": year_of(path), "term": term_of(path), "project_id": project_of(path)}
    if recompute:
        inferred |= {k: F.lit(v) for k, v in given.items()}
    df = chunks.withColumns(inferred | {
        "doc_type": doc_type, "phase": phase, "artifact_type": rules.first_match(F.concat("section_path", F.lit(" "), F.substring(text, 1, 200)), rules.ARTIFACT_RULES),
        "evidence_type": rules.first_match(text, rules.EVIDENCE_RULES), "status": first(rules.STATUS_RULES, text), "quality_level": level, "_quality": certainty,
        "req_ids": ids_of(text, rules.REQ_PATTERN, rules.REQ_MARKS), "design_ids": ids_of(text, rules.DESIGN_PATTERN, rules.DESIGN_MARKS), "test_ids": ids_of(text, rules.TEST_PATTERN, rules.TEST_MARKS), "impl_refs": F.filter(ids_of(text, rules.IMPL_PATTERN, rules.IMPL_MARKS), lambda x: F.length(x) > 4),
        "_held": keywords_of(text, rules.ARCH_KEYWORDS, rules.BIZ_KEYWORDS),
    })
    df = confidences(df).withColumns({"_arch": F.col("_held.col1"), "_biz": F.col("_held.col2")}).withColumns({
        "course": F.lit(course), "chunk_id": chunk_id(F.col("year"), F.col("term"), F.col("project_id"), F.col("doc_type"), index, text),
        "trace_links": trace_edges(F.col("req_ids"), F.col("test_ids"), F.col("design_ids")), "keywords": F.array_sort(F.array_union("_arch", "_biz")), "is_arch": F.size("_arch") > 0, "is_biz": F.size("_biz") > 0,
        "_confidence_overall": F.bround("_overall", 3), "_needs_review": F.col("term").isNull() | F.col("doc_type").isNull() | F.col("phase").isNull() | F.col("project_id").isNull() | (F.col("_overall") < rules.REVIEW_BELOW),
    })
    return df.withColumns({k: F.lit(v) for k, v in given.items()}).drop("_quality", "_held", "_arch", "_biz", "_overall")
