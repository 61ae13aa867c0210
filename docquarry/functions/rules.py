"""Rule tables of the metadata extraction and builders that turn ordered rules into Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_held, let, py

# Ordered rules, keyword lists, patterns, weights and limits.
DOC_TYPE_RULES = (
    ("软件需求规格说明书|需求规格说明|SRS", "需求", "requirement"),
    ("软件概要设计说明书|概要设计", "概要设计", "design"),
    ("软件详细设计说明书|详细设计", "详细设计", "design"),
    ("软件开发计划书|开发计划", "开发计划", "implementation"),
    ("项目管理文档", "项目管理", "implementation"),
    ("测试报告|测试计划", "测试报告", "testing_deployment"),
    ("用户手册|用户使用说明书|使用说明", "用户手册", "testing_deployment"),
    ("项目总结|总结报告", "项目总结", "testing_deployment"),
    ("人员分工|贡献|权重", "人员分工", "implementation"),
)
ARTIFACT_RULES = (
    ("目标|概述|背景|简介|范围", "goal"),
    ("需求|功能|能力|用例|业务规则", "requirement"),
    ("接口|API|通信|协议|外部接口", "interface"),
    ("数据库|数据结构|数据模型|实体|ER", "data_model"),
    ("模块|组件|架构|分层|子系统", "module"),
    ("设计决策|方案|选型|技术选择", "design_decision"),
    ("实现|开发|编码|迭代|Day", "implementation"),
    ("测试用例|测试|验证|断言|用例", "test_case"),
    ("缺陷|Bug|问题|故障", "defect"),
    ("部署|上线|发布|环境|配置", "deployment"),
    ("风险|约束|限制|假设", "risk"),
    ("总结|复盘|回顾|结论", "summary"),
)
EVIDENCE_RULES = (
    (r"\|.*\|", "table"),
    (r"\d+ms|\d+%|TPS|QPS|吞吐|响应时间|并发", "metric"),
    (r"```|`[A-Za-z]", "code_ref"),
    ("日志|log|ERROR|WARN|INFO", "log"),
    (r"截图|图\d|Figure", "screenshot"),
)
STATUS_RULES = (
    ("done", ("已完成", "完成", "done", "closed", "resolved")),
    ("in_progress", ("进行中", "开发中", "in progress", "ongoing")),
    ("planned", ("计划", "待开发", "TODO", "planned")),
    ("blocked", ("阻塞", "blocked", "问题", "无法解决")),
)
TERM_RULES = (("春季", ("春季", "spring", "秋", "第一学期")), ("夏季", ("夏季", "summer", "第二学期", "暑")))
ARCH_KEYWORDS = ("架构", "设计", "模式", "module", "component", "interface", "protocol", "layer", "分分层", "模块")
BIZ_KEYWORDS = ("业务", "流程", "功能", "需求", "场景", "用户", "用例", "business", "logic")
REQ_PATTERN = r"\b(?:FR|NFR|IF)-\d+\b"
DESIGN_PATTERN = r"\b(?:SD|DES)-\d+\b"
TEST_PATTERN = r"\b(?:TC|TEST)-\d+\b"
IMPL_PATTERN = r"\b([A-Z][a-zA-Z0-9]*(?:Controller|Service|Repository|Manager|Handler|API))\b"
METRIC_PATTERN = r"\d+ms|\d+%|TPS|QPS|并发"
TABLE_PATTERN = r"\|.+\|"
YEAR_PATTERN = r"(20\d{2})"
NOT_A_PROJECT = r"20\d{2}|春季|夏季|summer|spring"
NOISE_PATTERNS = (
    r"^[\*_~>]{0,3}\s*本条应.{0,60}$",
    r"^[\*_~>]{0,3}\s*说明：.*$",
    r"^[\*_~>]{0,3}\s*最终文档请删除.*$",
    r"(?i)^[\*_~>]{0,3}\s*\[?TOC\]?$",
)
SUMMARY_TITLE = r"^(?:第?[一二三四五六七八九十百千\d]+[章节部分篇]?\s*)?(?:本章|本节|模块|阶段|单元)?(?:小结|总结|结论|回顾|总结与展望)(?:[：:]?.*)?$"
SUMMARY_CHARACTERS = r"[\w一-龥\s、，,。.；;:：()（）《》【】\-]+"
SPECIAL_PATTERNS = (r"(\|.+\|.+\n){2,}", r"(FR|NFR|IF|TC|SD)-\d+", r"```[\s\S]+?```")
CONFIDENCE_WEIGHTS = (
    ("year", 0.10),
    ("term", 0.15),
    ("doc_type", 0.25),
    ("phase", 0.20),
    ("artifact_type", 0.15),
    ("quality_level", 0.05),
    ("evidence_type", 0.05),
    ("status", 0.05),
)
COURSE = "软件工程实践"
CHUNK_MIN, CHUNK_MAX, CHUNK_OVERLAP = 200, 700, 100
REVIEW_BELOW = 0.75
#: Texts one of which every match of a pattern holds.
REQ_MARKS, DESIGN_MARKS, TEST_MARKS = ("FR-", "IF-"), ("SD-", "DES-"), ("TC-", "TEST-")
IMPL_MARKS = ("Controller", "Service", "Repository", "Manager", "Handler", "API")
SPECIAL_MARKS = (("\n|",), ("FR-", "IF-", "TC-", "SD-"), ("```",))
PHASES = ("requirement", "design", "implementation", "testing_deployment")


def literals(pattern: str) -> list[tuple[str, str, bool]] | None:
    """(alternative, a text that all its matches hold, whether that text is all of it) for each alternative of a pattern; None
    where none such can be told (groups, optional parts)."""
    found, own, longest, whole, start, last = [], "", "", True, 0, ""
    tokens = [*re.finditer(r"\\.|\[[^\]]*\]|.", pattern, re.S), None]
    for m in tokens:
        token = m.group() if m else "|"
        if token in ("(", ")", "?", "{", "}") or token == "*" and last != ".":
            return None
        last = token
        if token == "|":
            longest = max(longest, own, key=len)
            if not longest:
                return None
            found.append((pattern[start : m.start() if m else len(pattern)], longest, whole))
            own, longest, whole, start = "", "", True, m.end() if m else 0
        elif len(token) == 1 and token not in ".*+^$" or len(token) == 2 and not token[1].isalnum():
            own += token[-1]
        else:  # a class, an anchor or a repetition: texts go on after it
            longest, own, whole = max(longest, own, key=len), "", False
    return found


def occurs(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs in ``text``. Alternatives that are plain texts are looked for as such, and others tried
    only where a text that all their matches hold is there."""
    found = literals(pattern)
    if found is None:
        return text.rlike(py(pattern))
    hit = F.lit(False)
    for own, held, whole in found:
        hit = hit | (text.contains(held) if whole else text.contains(held) & text.rlike(py(own)))
    return hit


def first_match(text: Column, rules, value: int = 1) -> Column:
    """Value of the first rule whose pattern occurs in ``text``; null if none does."""
    return let(text, lambda own: F.coalesce(*(F.when(occurs(own, r[0]), F.lit(r[value])) for r in rules)))


def first_keyword(text: Column, rules, fold: bool = False) -> Column:
    """Name of the first rule of which any keyword is contained in ``text``."""
    return let(
        F.lower(text) if fold else text,
        lambda held: F.coalesce(
            *(F.when(any_held(held, [w.lower() if fold else w for w in words]), F.lit(name)) for name, words in rules)
        ),
    )
