"""Constant catalogs (templates, skills, default queries) and the tool functions over a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import PHASES
from ..functions.text import strip
from .filters import DOC_TYPE_ALIASES, TEMPLATE_ALIASES, canonical_doc_type, normalize_value
from .retrieval import search

# Template sections and places, skills by phase, phases of document types, default queries.
TEMPLATE_SECTIONS = {
    "软件需求规格说明书": [
        "1 范围 / 1.1 标识 / 1.2 系统概述 / 1.3 文档概述 / 1.4 基线", "2 引用文件", "3 需求 / 3.1 所需的状态和方式 / 3.2 需求概述 / 3.2.1 目标 / 3.2.2 运行环境", "3.3 CSCI能力需求（功能需求）",
        "3.4 CSCI外部接口需求", "3.5 CSCI内部接口需求", "3.6 适应性需求", "3.7 保密性和私密性需求", "3.8 CSCI环境需求", "3.9 计算机资源需求", "3.10 软件质量因素", "3.11 设计和实现约束",
        "4 合格性规定", "5 需求可追踪性", "6 尚未解决的问题", "7 注释",
    ],
    "软件概要设计说明书": [
        "1 范围 / 1.1 标识 / 1.2 系统概述 / 1.3 文档概述", "2 引用文件", "3 系统总体设计 / 3.1 系统基本设计方案 / 3.2 系统组成", "4 CSCI体系结构设计 / 4.1 体系结构 / 4.2 模块划分",
        "5 CSCI数据库设计", "6 CSCI接口设计 / 6.1 外部接口 / 6.2 内部接口", "7 运行设计", "8 出错处理设计", "9 注释",
    ],
    "软件详细设计说明书": ["1 范围", "2 引用文件", "3 CSCI级设计决策", "4 CSCI体系结构设计决策", "5 CSCI详细设计 / 5.x 模块详细设计（每模块一条）", "6 注释"],
    "软件开发计划书": [
        "1 范围", "2 引用文件", "3 概述 / 3.1 项目概况 / 3.2 项目假定与约束", "4 项目组织", "5 项目计划 / 5.1 工作任务的分解与人员分工 / 5.2 进度计划 / 5.3 里程碑", "6 技术计划",
        "7 项目支持计划 / 7.1 配置管理计划 / 7.2 质量保证计划", "8 注释",
    ],
    "测试报告": ["1 范围", "2 引用文件", "3 测试结果概述 / 3.1 测试目标 / 3.2 测试摘要", "4 详细测试结果 / 4.x 各测试用例结果", "5 测试日志", "6 注释"],
    "迭代需求文档": ["1 迭代目标与范围", "2 用户故事列表", "3 功能需求细化", "4 非功能需求", "5 验收标准", "6 变更记录"],
    "项目管理文档": ["1 项目概述", "2 迭代计划（Sprint Backlog）", "3 任务分工与进度追踪", "4 燃尽图 / 速率统计", "5 缺陷管理", "6 风险管理", "7 迭代复盘"],
    "项目总结": ["1 项目背景与目标", "2 交付成果总览", "3 技术方案与实施过程回顾", "4 质量与测试结果", "5 团队协作与过程管理复盘", "6 风险问题与改进措施", "7 课程收获与后续计划"],
}
TEMPLATE_FILES = {
    "软件需求规格说明书": "模版库-供claudeCode调用/提交文件模版/春季/软件需求规格说明书.md",
    "软件概要设计说明书": "模版库-供claudeCode调用/提交文件模版/春季/软件概要设计说明书.md",
    "软件详细设计说明书": "模版库-供claudeCode调用/提交文件模版/春季/软件详细设计说明书.md",
    "软件开发计划书": "模版库-供claudeCode调用/提交文件模版/春季/软件开发计划书.md",
    "测试报告": "模版库-供claudeCode调用/提交文件模版/春季/测试报告.md",
    "迭代需求文档": None,
    "项目管理文档": "模版库-供claudeCode调用/提交文件模版/夏季/项目管理文档.md",
    "项目总结": "模版库-供claudeCode调用/提交文件模版/夏季/项目总结.md",
    "用户手册": "模版库-供claudeCode调用/提交文件模版/春季/用户手册模版.md",
}
TEMPLATE_NOTE = "请按 sections 列表逐章生成内容，对每个章节可调用 search_by_section 检索往年同章节的高质量写法"
SKILLS = {
    "requirement": [
        ("se-requirements-doc-assistant", "生成需求规格说明书章节内容", "用于结构化产出需求分析文档与验收标准"),
        ("ambiguity-detector", "检测需求文本中的歧义表述", "识别需求中的模糊词、范围不清与缺失约束"),
    ],
    "design": [
        ("se-architecture-doc-assistant", "生成概要设计/详细设计章节", "用于架构、模块、接口与数据结构设计文档输出"),
        ("api-design-assistant", "设计接口规范（OpenAPI格式）", "用于生成标准化接口定义与契约说明"),
    ],
    "implementation": [
        ("se-implementation-doc-assistant", "生成实现阶段文档", "用于整理实现说明、迭代记录与完成度证明"),
        ("se-project-management-doc-assistant", "生成开发计划/迭代记录", "用于生成项目管理材料与过程追踪文档"),
        ("code-change-summarizer", "汇总 git 提交生成开发说明", "用于从提交历史提炼阶段实现总结"),
    ],
    "testing_deployment": [("se-testing-deployment-doc-assistant", "生成测试报告/用户手册/部署说明", "用于测试与部署阶段的文档化交付")],
    "all": [
        ("se-course-doc-orchestrator", "统筹整个课程文档阶段，不确定从哪份写时优先使用", "用于阶段编排与文档产出流程串联"),
        ("explain-code", "需要在文档中解释代码实现逻辑", "用于将代码行为转换为可读的实现说明"),
    ],
}
DOC_TYPE_PHASE = {
    "软件需求规格说明书": "requirement",
    "需求": "requirement",
    "迭代需求文档": "requirement",
    "软件概要设计说明书": "design",
    "概要设计": "design",
    "软件详细设计说明书": "design",
    "详细设计": "design",
    "软件开发计划书": "implementation",
    "开发计划": "implementation",
    "项目管理文档": "implementation",
    "项目管理": "implementation",
    "测试报告": "testing_deployment",
    "用户手册": "testing_deployment",
    "项目总结": "testing_deployment",
    "项目总结报告": "testing_deployment",
}
DOC_TYPE_QUERY = {
    "需求": "功能需求 用户故事 验收标准",
    "概要设计": "架构设计 模块划分 接口设计",
    "详细设计": "类设计 数据结构 算法流程",
    "测试报告": "测试用例 测试结果 缺陷记录",
    "开发计划": "进度计划 里程碑 人员分工",
    "项目管理": "Sprint Backlog 迭代计划 燃尽图 复盘",
    "项目总结": "项目总结 复盘 技术选型 过程改进",
}
PHASE_QUERY = {
    "requirement": "功能需求 非功能需求 用例",
    "design": "体系结构 模块设计 数据库 接口",
    "implementation": "开发计划 迭代记录 模块实现",
    "testing_deployment": "测试报告 测试用例 部署说明",
}
CHAIN_LIMIT = 8


def template_sections(asked: DataFrame, column: str = "asked") -> DataFrame:
    """``asked`` with, for each of its types, doc_type, sections, template_path_hint, usage_note; for a type without sections
    error and available_doc_types instead. The templates are a small constant table, joined by broadcast."""
    spark = asked.sparkSession
    made = [(t, s, TEMPLATE_FILES.get(t), TEMPLATE_NOTE) for t, s in TEMPLATE_SECTIONS.items()]
    templates = spark.createDataFrame(
        made, "doc_type string, sections array<string>, template_path_hint string, usage_note string"
    )
    held = strip(F.coalesce(column, F.lit("")))
    rows = asked.withColumn("_type", canonical_doc_type(held, TEMPLATE_ALIASES))
    rows = rows.join(F.broadcast(templates), F.col("_type") == F.col("doc_type"), "left").drop("_type")
    known = F.col("sections").isNotNull()
    missing = F.concat(F.lit("未找到文档类型 '"), F.coalesce(column, F.lit("")), F.lit("' 的模版"))
    available = F.array(*map(F.lit, TEMPLATE_SECTIONS))
    return rows.withColumns({"error": F.when(~known, missing), "available_doc_types": F.when(~known, available)})


def suggest_skills(asked: DataFrame, phase: str = "phase", doc_type: str = "doc_type") -> DataFrame:
    """``asked`` with (position, skill, trigger, description) of each skill for its phase and type: those of the phase first,
    general ones always. The document type overrides the phase. Skills are a small constant table, joined by
    broadcast."""
    spark = asked.sparkSession
    made = [(p, i, *r) for p in (*SKILLS, "") for i, r in enumerate([*(SKILLS[p] if p and p != "all" else ()), *SKILLS["all"]])]
    skills = spark.createDataFrame(made, "_phase string, position int, skill string, trigger string, description string")
    table = F.create_map(*(F.lit(x) for pair in DOC_TYPE_PHASE.items() for x in pair))
    held = strip(F.coalesce(doc_type, F.lit("")))
    of_type = F.coalesce(
        F.try_element_at(table, canonical_doc_type(held, TEMPLATE_ALIASES)), F.try_element_at(table, F.col(doc_type))
    )
    resolved = F.coalesce(of_type, F.col(phase), F.lit(""))
    known = F.when(resolved.isin(*(p for p in SKILLS if p != "all")), resolved).otherwise("")
    return asked.withColumn("_phase", known).join(F.broadcast(skills), "_phase").drop("_phase")


def project_chain(store: DataFrame, project_id: str | None = None, limit: int = CHAIN_LIMIT) -> DataFrame:
    """Per project and phase the first ``limit`` chunks in store order, then sorted by quality: project_id, phase,
    place, chunk_uuid, text, section_path, doc_type, quality_level."""
    rows = store.where(F.col("phase").isin(*PHASES))
    rows = rows if project_id is None else rows.where(F.col("project_id") == project_id)
    head = rows.withColumn(
        "_n", F.row_number().over(Window.partitionBy("project_id", "phase").orderBy("chunk_uuid"))
    ).where(F.col("_n") <= limit)
    quality = (
        F.when(F.col("quality_level") == "high", 0)
        .when(F.col("quality_level") == "medium", 1)
        .when(F.col("quality_level") == "low", 2)
        .otherwise(3)
    )
    place = F.row_number().over(Window.partitionBy("project_id", "phase").orderBy(quality, "_n")).alias("place")
    return head.select("project_id", "phase", place, "chunk_uuid", "text", "section_path", "doc_type", "quality_level")


def _canonical(doc_type):
    held = (doc_type or "").strip()
    return DOC_TYPE_ALIASES.get(held, held) or None


def _source(hits: DataFrame, *names: str) -> DataFrame:
    return hits.select(
        "chunk_uuid",
        "text",
        F.struct(*(F.col(f"metadata.{n}").alias(n) for n in names)).alias("source"),
        F.col("composite_score").alias("score"),
        "why_hit",
    )


def search_course_docs(
    store: DataFrame,
    embed,
    query: str,
    phase=None,
    term=None,
    doc_type=None,
    quality_level=None,
    artifact_type=None,
    use_reranker: bool = True,
) -> DataFrame:
    """Search without a project filter. ``embed`` maps a text to (dense, sparse)."""
    hits = search(
        store,
        query,
        *embed(query),
        phase=phase,
        term=term,
        doc_type=_canonical(doc_type),
        quality_level=quality_level,
        artifact_type=artifact_type,
        use_reranker=use_reranker,
    )
    return _source(
        hits, "project_id", "doc_type", "phase", "section_path", "quality_level", "year", "term"
    ).withColumnRenamed("why_hit", "why")


def phase_examples(store: DataFrame, embed, phase: str, doc_type=None, topic_hint=None, n: int = 5) -> DataFrame:
    """High-quality examples of a phase; the query is the hint or the default of the type or phase."""
    kind = _canonical(doc_type)
    query = topic_hint or DOC_TYPE_QUERY.get(kind or "") or PHASE_QUERY.get(phase, phase)
    hits = search(store, query, *embed(query), phase=phase, doc_type=kind, quality_level=["high"], use_reranker=False)
    return _source(hits, "project_id", "doc_type", "section_path", "year", "term").drop("why_hit").limit(n)


def search_by_section(
    store: DataFrame, embed, section_path: str, doc_type=None, phase=None, quality_level=None, n: int = 3
) -> DataFrame:
    """Examples of one template section; its path is the query text."""
    hits = search(
        store,
        section_path,
        *embed(section_path),
        phase=phase,
        doc_type=_canonical(doc_type),
        quality_level=["high"] if quality_level is None else quality_level,
    )
    return _source(hits, "project_id", "doc_type", "section_path", "year", "term").drop("why_hit").limit(n)


def search_documents(store: DataFrame, embed, query: str, use_reranker: bool = True, **params) -> DataFrame:
    """Search with normalized request parameters."""
    return search(
        store, query, *embed(query), use_reranker=use_reranker, **{k: normalize_value(v) for k, v in params.items()}
    )
