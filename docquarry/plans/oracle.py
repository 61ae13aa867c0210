"""DuckDB SQL for the registered queries, written independently of the Column expressions."""

from __future__ import annotations

from ..functions import rules
from ..operators.catalog import SKILLS
from ..operators.filters import DOC_TYPE_ALIASES
from .fixtures import FX


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def case(text: str, table, value: int = 1) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(r[0])}) THEN {q(r[value])}" for r in table) + " END"


def words(text: str, table) -> str:
    return (
        "CASE "
        + " ".join("WHEN " + " OR ".join(f"contains({text}, {q(w)})" for w in ws) + f" THEN {q(n)}" for n, ws in table)
        + " END"
    )


def held(text: str, items) -> str:
    return f"list_filter([{', '.join(map(q, items))}], lambda k: contains(lower({text}), k))"


TITLE = rf"regexp_replace({strip(r'''CASE WHEN regexp_matches(trim(line), '^#{1,6}\s+.+$') THEN regexp_extract(trim(line), '^#{1,6}\s+(.+)$', 1) ELSE line END''')}, '[：:。；;\-—\s]+$', '')"
BOUNDARY = rf"CASE WHEN {TITLE} <> '' AND (regexp_matches({TITLE}, {q(rules.SUMMARY_TITLE)}) OR (length({TITLE}) <= 32 AND (contains({TITLE}, '小结') OR suffix({TITLE}, '总结') OR suffix({TITLE}, '结论')) AND regexp_full_match({TITLE}, '[\p{{L}}\p{{N}}_\s、，,。.；;:：()（）《》【】\-]+'))) THEN {TITLE} END"
# no line after the last break
CLOSED = "CASE WHEN suffix(body, chr(10)) THEN left(body, length(body) - 1) ELSE body END"
LINES = f"fx AS ({FX}), l AS (SELECT doc_id, unnest(string_split({CLOSED}, chr(10))) AS line, generate_subscripts(string_split({CLOSED}, chr(10)), 1) AS i FROM fx)"
SECTIONS = rf"""{LINES}, h AS (SELECT *, length(regexp_extract({strip('line')}, '^(#{{1,2}})\s+.+$', 1)) AS lv, regexp_extract({strip('line')}, '^#{{1,2}}\s+(.+)$', 1) AS title FROM l),
s0 AS (SELECT *, sum((lv > 0)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS sec, last_value(CASE WHEN lv = 1 THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS t1 FROM h),
sections AS (SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY i) AS text, first(CASE lv WHEN 1 THEN title WHEN 2 THEN t1 || ' > ' || title ELSE '' END ORDER BY i) AS path FROM s0 GROUP BY doc_id, sec)"""


def parts(source: str) -> str:
    """Summary parts of ``source`` (doc_id, sec, text, path)."""
    return rf"""pl AS (SELECT doc_id, sec, path, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {source}),
pb AS (SELECT *, {BOUNDARY} AS title, trim(line, chr(9) || chr(10) || chr(13) || ' ') = '' AS blank FROM pl),
pf AS (SELECT *, min(CASE WHEN NOT blank THEN i END) OVER (PARTITION BY doc_id, sec) AS f FROM pb),
ps AS (SELECT *, i = 1 OR (title IS NOT NULL AND i > f) AS opens FROM pf),
pn AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id, sec ORDER BY i) AS sub FROM ps),
parts AS (SELECT doc_id, sec, sub, path, {strip('string_agg(line, chr(10) ORDER BY i)')} AS text, coalesce(first(CASE WHEN opens THEN title END ORDER BY i), '') AS boundary FROM pn GROUP BY doc_id, sec, sub, path HAVING {strip('string_agg(line, chr(10) ORDER BY i)')} <> '')"""


def folded(source: str, keys: str) -> str:
    """Sentence windows of ``source`` (keys, text) as ``windows`` (keys, k, chunk)."""
    same = " AND ".join(f"f.{k.strip()} = s.{k.strip()}" for k in keys.split(","))
    fkeys = ", ".join(f"f.{k.strip()}" for k in keys.split(","))
    return rf"""sent0 AS (SELECT {keys}, unnest(regexp_extract_all(text, '[^。！？；\n]*[。！？；\n]|[^。！？；\n]+')) AS s, generate_subscripts(regexp_extract_all(text, '[^。！？；\n]*[。！？；\n]|[^。！？；\n]+'), 1) AS n FROM {source}),
sent AS (SELECT {keys}, s, row_number() OVER (PARTITION BY {keys} ORDER BY n) AS k FROM sent0 WHERE {strip('s')} <> ''),
fold AS (SELECT {keys}, 0::BIGINT AS k, '' AS buf, NULL::VARCHAR AS chunk FROM {source} UNION ALL
  SELECT {fkeys}, s.k, CASE WHEN length(buf) + length(s) <= 700 OR length(buf) < 200 THEN buf || s ELSE right(buf, 100) || s END,
    CASE WHEN length(buf) + length(s) <= 700 OR length(buf) < 200 THEN NULL ELSE {strip('buf')} END FROM fold f JOIN sent s ON {same} AND s.k = f.k + 1),
windows AS (SELECT {keys}, k, chunk FROM fold WHERE chunk IS NOT NULL UNION ALL
  SELECT {keys}, k + 1, {strip('buf')} FROM (SELECT *, max(k) OVER (PARTITION BY {keys}) AS top FROM fold) WHERE k = top AND length({strip('buf')}) >= 100)"""


SPECIAL = r"(regexp_matches(text, '(\|.+\|.+\n){2}') OR regexp_matches(text, '(FR|NFR|IF|TC|SD)-\d+') OR regexp_matches(text, '```[\s\S]+?```'))"
CHUNKS = rf"""{SECTIONS}, {parts('sections')},
scoped AS (SELECT doc_id, sec, sub, text, CASE WHEN boundary = '' THEN path WHEN path = '' THEN boundary ELSE path || ' > ' || boundary END AS section_path FROM parts),
big AS (SELECT * FROM scoped WHERE NOT ({SPECIAL} OR length(text) <= 700)),
{folded('big', 'doc_id, sec, sub')},
allc AS (SELECT doc_id, sec, sub, 0 AS k, section_path, text FROM scoped WHERE {SPECIAL} OR length(text) <= 700 UNION ALL
  SELECT w.doc_id, w.sec, w.sub, k, section_path, chunk FROM windows w JOIN big b ON w.doc_id = b.doc_id AND w.sec = b.sec AND w.sub = b.sub),
chunks AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec, sub, k) - 1)::INT AS chunk_index, section_path, text FROM allc)"""


def ids(pattern: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(text, {q(pattern)})))"


YEAR = r"TRY_CAST(nullif(regexp_extract(file_path, '20\d{2}'), '') AS INT)"
PARENT = "string_split(file_path, '/')[-2]"
PROJECT = rf"CASE WHEN regexp_full_match({PARENT}, '20\d{{2}}|春季|夏季|summer|spring', 'i') THEN NULL ELSE left(regexp_replace({PARENT}, '[^\p{{L}}\p{{N}}_\-]', '_', 'g'), 32) END"
TERM = words("lower(file_path)", rules.TERM_RULES)
NAMED = "string_split(file_path, '/')[-1] || ' ' || first_heading"
HAS = [
    f"(regexp_matches(text, {q(rules.REQ_PATTERN)}) OR regexp_matches(text, {q(rules.TEST_PATTERN)}))",
    f"regexp_matches(text, {q(rules.METRIC_PATTERN)})",
    "contains(text, '```')",
    f"regexp_matches(text, {q(rules.TABLE_PATTERN)})",
]
SIGNS = " + ".join(f"{x}::INT" for x in HAS)
QUALITY = f"CASE WHEN {SIGNS} >= 2 AND length(text) >= 200 THEN 'high' WHEN length(text) < 80 THEN 'low' ELSE 'medium' END"
META = rf"""{CHUNKS},
m0 AS (SELECT c.*, fx.file_path, fx.source, fx.lang, 'Doc ' || c.doc_id AS first_heading FROM chunks c JOIN fx ON fx.doc_id = c.doc_id),
m1 AS (SELECT *, {YEAR} AS year, {TERM} AS term, {PROJECT} AS project_id, {case(NAMED, rules.DOC_TYPE_RULES, 1)} AS doc_type, {case(NAMED, rules.DOC_TYPE_RULES, 2)} AS phase,
  {case("section_path || ' ' || left(text, 200)", rules.ARTIFACT_RULES)} AS artifact_type, {case('text', rules.EVIDENCE_RULES)} AS evidence_type, {words('text', rules.STATUS_RULES)} AS status, {QUALITY} AS quality_level,
  {ids(rules.REQ_PATTERN)} AS req_ids, {ids(rules.DESIGN_PATTERN)} AS design_ids, {ids(rules.TEST_PATTERN)} AS test_ids, list_filter({ids(rules.IMPL_PATTERN)}, lambda x: length(x) > 4) AS impl_refs,
  {held('text', rules.ARCH_KEYWORDS)} AS arch, {held('text', rules.BIZ_KEYWORDS)} AS biz FROM m0),
m2 AS (SELECT *, (CASE WHEN year IS NULL THEN 0 ELSE 1.0 END * 0.1::DOUBLE + CASE WHEN term IS NULL THEN 0 ELSE 1.0 END * 0.15::DOUBLE + CASE WHEN doc_type IS NULL THEN 0 ELSE 0.98 END * 0.25::DOUBLE + CASE WHEN doc_type IS NULL THEN 0 ELSE 0.98 END * 0.2::DOUBLE
  + CASE WHEN artifact_type IS NULL THEN 0 ELSE 0.85 END * 0.15::DOUBLE + CASE quality_level WHEN 'high' THEN 0.8 WHEN 'low' THEN 0.75 ELSE 0.7 END * 0.05::DOUBLE + CASE WHEN evidence_type IS NULL THEN 0 ELSE 0.85 END * 0.05::DOUBLE + CASE WHEN status IS NULL THEN 0 ELSE 0.8 END * 0.05::DOUBLE) AS overall FROM m1),
meta AS (SELECT *, round_even(overall, 3) AS confidence_overall, term IS NULL OR doc_type IS NULL OR phase IS NULL OR project_id IS NULL OR overall < 0.75 AS needs_review,
  concat_ws('-', coalesce(year::VARCHAR, 'unk'), replace(coalesce(term, 'unk'), ' ', ''), left(coalesce(project_id, 'unk'), 12), left(coalesce(doc_type, 'unk'), 8), chunk_index::VARCHAR, left(md5(left(text, 50)), 6)) AS chunk_id,
  lpad(doc_id::VARCHAR, 9, '0') || '-' || lpad(chunk_index::VARCHAR, 5, '0') AS chunk_uuid, len(req_ids) * (len(test_ids) + len(design_ids)) AS n_links FROM m2)"""
TEMPLATE_NAMES = ("软件需求规格说明书", "需求", "测试报告", "用户手册", "迭代需求文档", "x")
WITH = "WITH RECURSIVE "


def joined(x: str) -> str:
    return f"array_to_string({x}, ',') AS {x}"


FLAT_NOISE = " OR ".join(f"regexp_matches({strip('x')}, {q(p)})" for p in rules.NOISE_PATTERNS)
VEC = "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings"
COS = "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"
QUERIES_SQL = "(SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0)"
WORDS_PATTERN = "[a-z0-9]+|[一-鿿]{2,}"
#: Products of term counts; the ten documents of largest sum for each query.
SPARSE = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]{{2,}}')) AS w FROM documents), d AS (SELECT doc_id, w, count(*) AS n FROM t GROUP BY ALL),
b AS (SELECT query_id, w, count(*) AS m FROM (SELECT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[一-鿿]{{2,}}')) AS w FROM {queries}) GROUP BY ALL), s AS (SELECT query_id, doc_id, sum(n * m)::DOUBLE AS score FROM d JOIN b USING (w) GROUP BY ALL)
SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s QUALIFY rank <= 10"""
#: Share of a passage's terms in every document.
RERANK = f"""WITH qs AS (SELECT regexp_extract_all(lower(text), '{WORDS_PATTERN}') AS qa, list_distinct(qa) AS w FROM benchmark WHERE item_id = 0), a AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORDS_PATTERN}') AS all_ FROM documents),
d AS (SELECT doc_id, all_, len(list_intersect(w, list_distinct(all_)))::DOUBLE / len(w) AS s FROM a, qs)"""

def search_sql(tokens, levels, hits, terms=None, hint=None, named="true", dense=False, limit=None, columns=None) -> str:
    """The stages of a search in SQL. ``tokens``: of the sparse query, each once; ``levels``: predicates from strict to loose;
    ``hits``: the fields asked for; ``terms``: of the reranked query, none without reranking; ``hint``: a part of file
    names that the query names, looked for where ``named``."""
    lv = " UNION ALL ".join(f"SELECT {i} AS level, * FROM sc WHERE {x}" for i, x in enumerate(levels))
    fused = "d" if dense else "CASE WHEN rd <= 80 THEN 1 / (60 + rd) ELSE 0 END + CASE WHEN rs <= 80 THEN 1 / (60 + rs) ELSE 0 END"
    found = "rd <= 80" if dense else "rd <= 80 OR rs <= 80"
    score = f"CASE WHEN count(*) OVER () > 18 THEN len(list_intersect([{', '.join(map(q, terms))}], regexp_extract_all(lower(text), '{WORDS_PATTERN}'))) / {len(terms)}::DOUBLE END" if terms else "NULL::DOUBLE"
    looked = f"{named} AND contains(string_split(file_path, '/')[-1], {q(hint)})" if hint else "false"
    columns = columns or "why_metadata_match, why_continuity, why_docname_match"
    return rf"""{WITH}{META}, v AS ({VEC}), nv AS (SELECT count(*) AS n FROM embeddings), qv AS (SELECT v AS q FROM v WHERE vec_id = 0),
      dn AS (SELECT m.chunk_uuid, list_dot_product(v.v, q) / (sqrt(list_dot_product(v.v, v.v)) * sqrt(list_dot_product(q, q))) AS d FROM meta m CROSS JOIN nv CROSS JOIN qv JOIN v ON v.vec_id = m.doc_id % nv.n),
      tok AS (SELECT chunk_uuid, unnest(regexp_extract_all(lower(text), '{WORDS_PATTERN}')) AS w FROM meta), sp AS (SELECT chunk_uuid, count(*)::DOUBLE AS s FROM tok WHERE w IN ({', '.join(map(q, tokens))}) GROUP BY chunk_uuid),
      sc AS (SELECT m.chunk_uuid, phase, quality_level, doc_type, d, s FROM meta m JOIN dn USING (chunk_uuid) LEFT JOIN sp USING (chunk_uuid)),
      lv AS ({lv}),
      rk AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY d DESC, chunk_uuid) AS rd, CASE WHEN s IS NOT NULL THEN row_number() OVER (PARTITION BY level ORDER BY s DESC NULLS LAST, chunk_uuid) END AS rs FROM lv),
      fu AS (SELECT level, chunk_uuid, {fused} AS f FROM rk WHERE {found}),
      rf AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY f DESC, chunk_uuid) AS rank FROM fu QUALIFY rank <= 80), f1 AS (SELECT * FROM rf QUALIFY row_number() OVER (PARTITION BY chunk_uuid ORDER BY level, rank) = 1),
      bf AS (SELECT level, (SELECT count(*) FROM f1 WHERE f1.level < x.level) AS before FROM (SELECT DISTINCT level FROM rf) x), rec AS (SELECT chunk_uuid, f AS score, row_number() OVER (ORDER BY level, rank) AS seq FROM f1 JOIN bf USING (level) WHERE before < 18),
      dc AS (SELECT chunk_uuid, 0.9::DOUBLE AS ds, row_number() OVER (ORDER BY chunk_uuid) AS place FROM meta WHERE {looked} QUALIFY place <= 9),
      mg AS (SELECT coalesce(rec.chunk_uuid, dc.chunk_uuid) AS chunk_uuid, coalesce(score, 0.2::DOUBLE + 0.2::DOUBLE * 0.9::DOUBLE) AS score, coalesce(ds, 0::DOUBLE) AS ds, row_number() OVER (ORDER BY seq NULLS LAST, place) AS seq0 FROM rec FULL JOIN dc ON rec.chunk_uuid = dc.chunk_uuid),
      rr AS (SELECT mg.*, {score} AS rs FROM mg JOIN meta USING (chunk_uuid)),
      top AS (SELECT *, row_number() OVER (ORDER BY rs + 0.2::DOUBLE * ds DESC NULLS LAST, seq0) AS seq FROM rr QUALIFY seq <= 18),
      hd AS (SELECT seq, list_slice(list_concat(test_ids, design_ids), 1, 4) AS ends FROM top JOIN meta USING (chunk_uuid) WHERE seq <= 9 AND len(req_ids) > 0), lk AS (SELECT seq, unnest(ends) AS t, generate_subscripts(ends, 1) AS pos FROM hd),
      own AS (SELECT chunk_uuid, unnest(test_ids) AS t FROM meta UNION ALL SELECT chunk_uuid, unnest(design_ids) FROM meta), hit AS (SELECT seq, pos, chunk_uuid, row_number() OVER (PARTITION BY seq, pos ORDER BY chunk_uuid) AS n FROM lk JOIN own USING (t) QUALIFY n <= 2),
      nw AS (SELECT * FROM hit WHERE chunk_uuid NOT IN (SELECT chunk_uuid FROM top) QUALIFY row_number() OVER (PARTITION BY chunk_uuid ORDER BY seq, pos, n) = 1),
      ex AS (SELECT chunk_uuid, 1000000 + row_number() OVER (ORDER BY seq, pos, n) AS seq FROM (SELECT *, (SELECT count(*) FROM nw x WHERE x.seq < nw.seq) AS before FROM nw) WHERE before < 4),
      al AS (SELECT chunk_uuid, coalesce(rs, score) AS sim, ds, seq FROM top UNION ALL SELECT chunk_uuid, 0::DOUBLE, 0::DOUBLE, seq FROM ex),
      fin AS (SELECT al.*, meta.*, {' + '.join(f'coalesce(({h})::INT, 0)' for h in hits)} AS hits, CASE WHEN n_links > 0 THEN 'trace+req' WHEN len(req_ids) > 0 THEN 'req_only' ELSE 'none' END AS why_continuity FROM al JOIN meta USING (chunk_uuid)),
      told AS (SELECT *, round_even(0.6::DOUBLE * sim + 0.25::DOUBLE * (hits / {len(hits)}) + 0.15::DOUBLE * CASE why_continuity WHEN 'trace+req' THEN 0.8 WHEN 'req_only' THEN 0.5 ELSE 0.2 END + 0.2::DOUBLE * ds, 4) AS composite_score,
        hits || '/{len(hits)}' AS why_metadata_match, CASE WHEN ds > 0 THEN 'hint_in_filename' ELSE 'none' END AS why_docname_match FROM fin)
      SELECT chunk_uuid, composite_score, {columns} FROM told{f" ORDER BY composite_score DESC, seq LIMIT {limit}" if limit else ""}"""


#: Values that requests leave out in one way or another, by document; the same text in Spark and DuckDB.
GIVEN = "CASE doc_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' WHEN 3 THEN 'string' WHEN 4 THEN ' NONE' WHEN 5 THEN 'Null ' WHEN 6 THEN ' ' || source || ' ' ELSE lang END"
GIVEN_TOO = "CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE lang || ' ' END"
#: Types as people write them.
TYPED = "CASE doc_id % 19 " + " ".join(f"WHEN {i} THEN {q(f' {k} ')}" for i, k in enumerate(DOC_TYPE_ALIASES)) + " WHEN 17 THEN '  ' ELSE source END"
TEMPLATED = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {q(k)}" for i, k in enumerate(TEMPLATE_NAMES[:5])) + " ELSE source END"
PHASED = "CASE doc_id % 5 WHEN 0 THEN 'requirement' WHEN 1 THEN 'design' WHEN 2 THEN 'implementation' WHEN 3 THEN 'testing_deployment' END"
TYPED_TOO = "CASE doc_id % 7 WHEN 0 THEN ' 需求 ' WHEN 1 THEN '测试报告' WHEN 2 THEN '' WHEN 3 THEN source END"
#: Queries with and without names of files.
HINTED = """CASE doc_id % 6 WHEN 0 THEN 'see ' || source || '_' || doc_id || '.MD' WHEN 1 THEN '《' || lang || ' guide》 `x` 《' || lang || ' guide》' WHEN 2 THEN 'no ' || chr(39) || 'ab' || chr(39) || ' hint'
  WHEN 3 THEN NULL WHEN 4 THEN 'a/x.pdf Y' || doc_id || '.DOCX "The ' || source || '" x.pdf' ELSE replace(substring(text, 1, 200), chr(10), ' ') END"""


def norm(x: str) -> str:
    return f"CASE WHEN {strip(x)} <> '' AND lower({strip(x)}) NOT IN ('string', 'none', 'null') THEN {strip(x)} END"


def skills(phase: str) -> str:
    return "[" + ", ".join(q(x[0]) for x in [*SKILLS.get(phase, ()), *SKILLS["all"]]) + "]"


ORACLE: dict[str, str] = {
    "noise_filter": f"WITH fx AS ({FX}) SELECT doc_id, array_to_string(list_filter(string_split('说明：x' || chr(10) || body || chr(10) || ' [toc] ' || chr(10) || '> 本条应y', chr(10)), lambda x: NOT ({FLAT_NOISE})), chr(10)) AS cleaned FROM fx",
    "clean_line": f"WITH fx AS ({FX}) SELECT doc_id, {strip(r'''regexp_replace(regexp_replace('    ' || replace(body, ' ', '   ') || chr(1) || '  x ', '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), ' {3,}', '  ', 'g')''')} AS cleaned FROM fx",
    "md_virtual_pages": rf"WITH {LINES}, p AS (SELECT *, sum((regexp_matches(line, '^#{{1,2}} ') AND i > 1)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM l), g AS (SELECT doc_id, n, {strip('string_agg(line, chr(10) ORDER BY i)')} AS text FROM p GROUP BY ALL) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n))::INT AS page_num, text FROM g WHERE text <> ''",
    "heading_lines": rf"WITH {LINES} SELECT doc_id, (i - 1)::INT AS line_no, length(regexp_extract({strip('line')}, '^(#{{1,6}})\s+.+$', 1))::INT AS level, {strip(rf'''regexp_extract({strip('line')}, '^#{{1,6}}\s+(.+)$', 1)''')} AS title FROM l WHERE regexp_matches({strip('line')}, '^#{{1,6}}\s+.+$')",
    "first_heading": f"WITH fx AS ({FX}) SELECT doc_id, 'Doc ' || doc_id AS heading FROM fx",
    "table_to_markdown": "SELECT n_regionkey, '| nation | key |' || chr(10) || '| --- | --- |' || chr(10) || string_agg(CASE WHEN n_nationkey % 2 = 0 THEN '| ' || n_name || ' | ' || n_nationkey || ' |' ELSE '| ' || n_name || ' |  |' END, chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey",
    "font_heading": "SELECT p_partkey, CASE WHEN p_size >= 18 THEN '# ' WHEN p_size >= 15 THEN '## ' WHEN p_size >= 13 THEN '### ' WHEN p_size >= 11 AND p_partkey % 2 = 0 THEN '#### ' END AS prefix FROM part",
    "style_heading": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 4 THEN NULL WHEN starts_with(p_size::VARCHAR, '1') THEN 1 WHEN starts_with(p_size::VARCHAR, '2') THEN 2 WHEN starts_with(p_size::VARCHAR, '3') THEN 3 ELSE 4 END AS level FROM part",
    "pdf_lines": """WITH w AS (SELECT p_partkey // 9 AS doc, p_partkey % 9 AS seq, p_size::VARCHAR AS text, (p_size // 3)::DOUBLE AS size, ((p_partkey % 9) * (p_partkey // 9 % 5))::DOUBLE AS top, CASE WHEN p_partkey // 9 % 2 = 0 THEN 'Arial-Bold' ELSE 'Arial' END AS font FROM part),
      n AS (SELECT *, coalesce((abs(top - lag(top) OVER (PARTITION BY doc ORDER BY seq)) >= 3)::INT, 0) AS nw FROM w), g AS (SELECT *, sum(nw) OVER (PARTITION BY doc ORDER BY seq) AS line FROM n),
      a AS (SELECT doc, line, string_agg(text, ' ' ORDER BY seq) AS t, avg(size) AS s, max(font = 'Arial-Bold') AS b FROM g GROUP BY ALL)
      SELECT doc, line, CASE WHEN s >= 18 THEN '# ' WHEN s >= 15 THEN '## ' WHEN s >= 13 THEN '### ' WHEN s >= 11 AND b THEN '#### ' ELSE '' END || t AS text FROM a""",
    "image_note": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 > 0 THEN '> [图例：本页包含 ' || (n_nationkey % 3) || ' 张图片/架构图，详情请参考原始文档。]' ELSE '' END AS note FROM nation",
    "summary_boundary": f"WITH {LINES}, b AS (SELECT doc_id, (i - 1)::INT AS line_no, {BOUNDARY} AS title FROM l) SELECT * FROM b WHERE title IS NOT NULL",
    "structural_sections": f"WITH {SECTIONS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1)::INT AS pos, path, text FROM sections WHERE {strip('text')} <> ''",
    "summary_sections": f"WITH whole AS (SELECT doc_id, 0 AS sec, body AS text, '' AS path FROM ({FX})), {parts('whole')} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY sub) - 1)::INT AS pos, boundary, text FROM parts",
    "special_blocks": f"WITH fx AS ({FX}), t AS (SELECT doc_id, body AS text FROM fx UNION ALL SELECT -1 - doc_id, text FROM documents) SELECT doc_id, {SPECIAL} AS special FROM t",
    "semantic_chunks": f"{WITH}src AS (SELECT doc_id, text FROM documents), {folded('src', 'doc_id')} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INT AS pos, chunk FROM windows",
    "section_paths": f"{WITH}{CHUNKS} SELECT doc_id, chunk_index, section_path, length(text)::INT AS n_chars, md5(text) AS digest FROM chunks",
    "path_year_term": f"WITH fx AS ({FX}) SELECT doc_id, {YEAR} AS year, {TERM} AS term FROM fx",
    "doc_type_phase": f"WITH fx AS ({FX}), n AS (SELECT *, 'Doc ' || doc_id AS first_heading FROM fx) SELECT doc_id, {case(NAMED, rules.DOC_TYPE_RULES, 1)} AS doc_type, {case(NAMED, rules.DOC_TYPE_RULES, 2)} AS phase FROM n",
    "project_slug": f"WITH p AS (SELECT doc_id, '/a/' || CASE doc_id % 4 WHEN 0 THEN '2024' WHEN 1 THEN 'Spring' WHEN 2 THEN source || ' x.y-' || doc_id ELSE repeat('ab', 20) END || '/f.md' AS file_path FROM documents) SELECT doc_id, {PROJECT} AS project_id FROM p",
    "artifact_type": f"{WITH}{META} SELECT chunk_uuid, artifact_type FROM meta",
    "evidence_type": f"{WITH}{META} SELECT chunk_uuid, evidence_type FROM meta",
    "status": f"{WITH}{META} SELECT chunk_uuid, status FROM meta",
    "extract_ids": f"{WITH}{META} SELECT chunk_uuid, {', '.join(map(joined, ('req_ids', 'design_ids', 'test_ids', 'impl_refs')))} FROM meta",
    "trace_edges": f"""{WITH}{META}, r AS (SELECT chunk_uuid, unnest(req_ids) AS "from", list_concat(test_ids, design_ids) AS ends FROM meta) SELECT chunk_uuid, "from", unnest(ends) AS "to" FROM r""",
    "keyword_flags": f"{WITH}{META} SELECT chunk_uuid, array_to_string(list_sort(list_distinct(list_concat(arch, biz))), ',') AS keywords, len(arch) > 0 AS is_arch, len(biz) > 0 AS is_biz FROM meta",
    "quality_level": f"{WITH}{META} SELECT chunk_uuid, quality_level FROM meta",
    "confidence": f"{WITH}{META} SELECT chunk_uuid, confidence_overall FROM meta",
    "needs_review": f"{WITH}{META} SELECT chunk_uuid, needs_review FROM meta",
    "chunk_id": f"{WITH}{META} SELECT chunk_uuid, chunk_id FROM meta",
    "metadata_override": f"{WITH}{META} SELECT chunk_uuid, 'proj' AS project_id, term, 2030 AS year, chunk_id, needs_review FROM meta",
    "metadata_full": f"{WITH}{META} SELECT chunk_uuid, doc_id, chunk_index, {q(rules.COURSE)} AS course, chunk_id, year, term, project_id, doc_type, phase, section_path, artifact_type, evidence_type, status, quality_level, {', '.join(map(joined, ('req_ids', 'design_ids', 'test_ids', 'impl_refs')))}, array_to_string(list_sort(list_distinct(list_concat(arch, biz))), ',') AS keywords, n_links::INT AS n_links, confidence_overall, needs_review, md5(text) AS digest FROM meta",
    "filter_conjunctive": f"{WITH}{META} SELECT chunk_uuid FROM meta WHERE term = '春季' AND phase = 'requirement' AND project_id = 'src0'",
    "filter_any": f"{WITH}{META} SELECT chunk_uuid FROM meta WHERE quality_level IN ('high', 'low') AND doc_type = '概要设计'",
    "filter_array_any": f"{WITH}{META} SELECT chunk_uuid FROM meta WHERE list_has_any(req_ids, ['FR-1', 'FR-5'])",
    "normalize_params": f"""WITH p AS (SELECT doc_id, {GIVEN} AS v, {GIVEN_TOO} AS w FROM documents), n AS (SELECT doc_id, {norm('v')} AS value, list_filter([{norm('v')}, {norm('w')}, {norm("'Null'")}], lambda x: x IS NOT NULL) AS l FROM p)
      SELECT doc_id, value, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') END AS items FROM n""",
    "doc_type_alias": f"WITH p AS (SELECT doc_id, {strip('(' + TYPED + ')')} AS v FROM documents) SELECT doc_id, CASE v {' '.join(f'WHEN {q(k)} THEN {q(x)}' for k, x in DOC_TYPE_ALIASES.items())} WHEN '' THEN NULL ELSE v END AS canonical FROM p",
    "relaxed_recall": f"""{WITH}{META}, lv AS (SELECT 0 AS level, chunk_uuid, confidence_overall AS score FROM meta WHERE term = '春季' AND phase = 'requirement' AND doc_type = '需求' AND project_id = 'src3' AND quality_level = 'high'
      UNION ALL SELECT 1, chunk_uuid, confidence_overall FROM meta WHERE term = '春季' AND phase = 'requirement' AND project_id = 'src3' UNION ALL SELECT 2, chunk_uuid, confidence_overall FROM meta WHERE term = '春季' AND project_id = 'src3'
      UNION ALL SELECT 3, chunk_uuid, confidence_overall FROM meta WHERE project_id = 'src3'), r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY score DESC, chunk_uuid) AS rank FROM lv QUALIFY rank <= 80),
      f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY chunk_uuid ORDER BY level, rank) = 1), b AS (SELECT level, (SELECT count(*) FROM f WHERE f.level < x.level) AS before FROM (VALUES (0), (1), (2), (3)) x(level))
      SELECT chunk_uuid, level, row_number() OVER (ORDER BY level, rank)::INT AS seq FROM f JOIN b USING (level) WHERE before < 18""",
    "dense_topk": f"WITH e AS ({VEC}), s AS (SELECT b.vec_id, {COS} AS s FROM e a, e b WHERE a.vec_id = 0) SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank FROM s ORDER BY s DESC, vec_id LIMIT 80",
    "dense_topk_filtered": f"WITH e AS ({VEC}), s AS (SELECT b.vec_id, {COS} AS s FROM e a, e b WHERE a.vec_id = 0 AND b.label IN (1, 3)) SELECT vec_id, round(s, 6) AS score, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank FROM s ORDER BY s DESC, vec_id LIMIT 80",
    "dense_topk_many": f"WITH e AS ({VEC}), s AS (SELECT a.vec_id AS query_id, b.vec_id, {COS} AS s FROM e a, e b WHERE a.vec_id % 20 = 0) SELECT query_id, vec_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM s QUALIFY rank <= 5",
    "sparse_topk": SPARSE.format(queries=QUERIES_SQL),
    "rrf_fusion": f"WITH e AS ({VEC}), a1 AS (SELECT b.vec_id, row_number() OVER (ORDER BY {COS} DESC, b.vec_id) AS r FROM e a, e b WHERE a.vec_id = 0 QUALIFY r <= 80), a2 AS (SELECT b.vec_id, row_number() OVER (ORDER BY {COS} DESC, b.vec_id) AS r FROM e a, e b WHERE a.vec_id = 7 QUALIFY r <= 80), f AS (SELECT vec_id, coalesce(1 / (60 + a1.r), 0) + coalesce(1 / (60 + a2.r), 0) AS s FROM a1 FULL JOIN a2 USING (vec_id)) SELECT vec_id, round(s, 9) AS score, row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank FROM f ORDER BY s DESC, vec_id LIMIT 80",
    "docname_hints": rf"""WITH p AS (SELECT doc_id, {HINTED} AS v FROM documents), h AS (SELECT doc_id, list_concat(regexp_extract_all(v, '(?i)([^\s/\\]+\.(?:pdf|docx|md|markdown))', 1), regexp_extract_all(v, '["''`《](.{{3,120}}?)["''`》]', 1)) AS l FROM p),
      c AS (SELECT doc_id, list_filter(list_transform(l, lambda x: lower({strip('x')})), lambda x: x <> '') AS l FROM h) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS hints FROM c""",
    "docname_score": f"WITH fx AS ({FX}) SELECT doc_id, (CASE WHEN doc_id = 12 THEN 1.0 WHEN doc_id % 6 = 0 THEN 0.9 ELSE 0.0 END)::DOUBLE AS score, CASE WHEN doc_id = 12 THEN 'filename_in_query' WHEN doc_id % 6 = 0 THEN 'hint_in_filename' ELSE 'none' END AS reason FROM fx",
    "candidate_merge": "",
    "composite_score": f"""{WITH}{META}, s AS (SELECT *, (doc_id % 100) / 100.0::DOUBLE AS sim, coalesce((term = '春季')::INT, 0) + coalesce((phase = 'design')::INT, 0) + coalesce((quality_level IN ('high'))::INT, 0) AS hits FROM meta)
      SELECT chunk_uuid, round_even(0.6::DOUBLE * sim + 0.25::DOUBLE * (hits / 3) + 0.15::DOUBLE * CASE WHEN n_links > 0 AND len(req_ids) > 0 THEN 0.8 WHEN len(req_ids) > 0 THEN 0.5 ELSE 0.2 END + 0.2::DOUBLE * 0.6::DOUBLE, 4) AS score, hits || '/3' AS matched,
      CASE WHEN n_links > 0 THEN 'trace+req' WHEN len(req_ids) > 0 THEN 'req_only' ELSE 'none' END AS continuity FROM s""",
    "trace_expand": f"""{WITH}{META}, res AS (SELECT chunk_uuid, row_number() OVER (ORDER BY chunk_uuid DESC) AS seq, req_ids, test_ids, design_ids FROM meta WHERE n_links > 0 QUALIFY seq <= 9),
      lk AS (SELECT seq, unnest(range(1, 5)) AS pos, list_concat(test_ids, design_ids) AS ends FROM res), lt AS (SELECT seq, pos, ends[pos] AS t FROM lk WHERE ends[pos] IS NOT NULL),
      own AS (SELECT chunk_uuid, unnest(test_ids) AS t FROM meta UNION ALL SELECT chunk_uuid, unnest(design_ids) FROM meta),
      hit AS (SELECT seq, pos, chunk_uuid, row_number() OVER (PARTITION BY seq, pos ORDER BY chunk_uuid) AS n FROM lt JOIN own USING (t) QUALIFY n <= 2),
      nw AS (SELECT * FROM hit WHERE chunk_uuid NOT IN (SELECT chunk_uuid FROM res) QUALIFY row_number() OVER (PARTITION BY chunk_uuid ORDER BY seq, pos, n) = 1),
      b AS (SELECT *, (SELECT count(*) FROM nw x WHERE x.seq < nw.seq) AS before FROM nw) SELECT chunk_uuid, row_number() OVER (ORDER BY seq, pos, n)::INT AS seq FROM b WHERE before < 4""",
    "project_chain": f"""{WITH}{META}, head AS (SELECT *, row_number() OVER (PARTITION BY project_id, phase ORDER BY chunk_uuid) AS n FROM meta WHERE phase IS NOT NULL QUALIFY n <= 8)
      SELECT project_id, phase, row_number() OVER (PARTITION BY project_id, phase ORDER BY CASE quality_level WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, n)::INT AS place, chunk_uuid, quality_level FROM head""",
    "ingest_report": f"""{WITH}{META} SELECT doc_id, count(*) AS chunks_total, count(*) FILTER (contains(section_path, '小结') OR contains(section_path, '总结') OR contains(section_path, '结论')) AS chunks_summary_scoped, count(*) FILTER (needs_review) AS needs_review_count,
      round_even(100.0::DOUBLE * count(term) / count(*), 1) AS has_term_pct, round_even(100.0::DOUBLE * count(phase) / count(*), 1) AS has_phase_pct, round_even(100.0::DOUBLE * count(doc_type) / count(*), 1) AS has_doc_type_pct, least(count(*) FILTER (needs_review), 20)::INT AS n_items FROM meta GROUP BY doc_id""",
    "batch_totals": f"{WITH}{META} SELECT count(DISTINCT doc_id) AS files, count(*) AS total_chunks, count(*) FILTER (needs_review) AS total_review FROM meta",
    "delete_by_source": f"WITH fx AS ({FX}) SELECT doc_id, file_path AS source_file FROM fx WHERE doc_id % 10 <> 3",
    "upsert_latest": f"WITH fx AS ({FX}) SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN upper(lang) ELSE lang END AS lang, CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END AS version FROM fx UNION ALL SELECT -1 - doc_id, lang, 2 FROM fx WHERE doc_id % 50 = 0",
    "template_sections": f"""WITH p AS (SELECT doc_id, {TEMPLATED} AS asked FROM documents) SELECT doc_id, asked, CASE asked WHEN '软件需求规格说明书' THEN asked WHEN '需求' THEN '软件需求规格说明书' WHEN '测试报告' THEN asked WHEN '迭代需求文档' THEN asked END AS doc_type,
      CASE asked WHEN '软件需求规格说明书' THEN 16 WHEN '需求' THEN 16 WHEN '测试报告' THEN 6 WHEN '迭代需求文档' THEN 6 END AS n_sections, asked NOT IN ('软件需求规格说明书', '需求', '测试报告', '迭代需求文档') AS is_error FROM p""",
    "suggest_skills": f"""WITH p AS (SELECT doc_id, {PHASED} AS phase, {TYPED_TOO} AS kind FROM documents), r AS (SELECT doc_id, CASE WHEN trim(kind) = '需求' THEN 'requirement' WHEN kind = '测试报告' THEN 'testing_deployment' ELSE phase END AS phase FROM p),
      l AS (SELECT doc_id, CASE phase {' '.join(f"WHEN {q(x)} THEN {skills(x)}" for x in ('requirement', 'design', 'implementation', 'testing_deployment'))} ELSE {skills('')} END AS l FROM r)
      SELECT doc_id, (generate_subscripts(l, 1) - 1)::INT AS position, unnest(l) AS skill FROM l""",
    "content_dedup": "SELECT min(doc_id) AS doc_id, count(*) AS copies, md5(text) AS digest FROM documents GROUP BY md5(text)",
    "sparse_topk_all": SPARSE.format(queries="(SELECT item_id AS query_id, text FROM benchmark)"),
    "rerank_all": f"""{RERANK} SELECT doc_id, round(s, 6) AS rerank_score, row_number() OVER (ORDER BY s DESC, doc_id) AS seq FROM d""",
    "rerank": f"""{RERANK}, o AS (SELECT doc_id, unnest(all_) AS x FROM d), h AS (SELECT doc_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, doc_id) AS r FROM o JOIN (SELECT unnest(qa) AS x FROM qs) USING (x) GROUP BY doc_id QUALIFY r <= 80)
      SELECT doc_id, round(s, 6) AS rerank_score, row_number() OVER (ORDER BY s DESC, r)::INT AS seq FROM d JOIN h USING (doc_id)""",
    "docname_recall": rf"""WITH fx AS ({FX}), n AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS chunk_uuid, lower(string_split(file_path, '/')[-1]) AS name FROM fx), s AS (SELECT *, regexp_replace(name, '\.[^.]+$', '') AS stem FROM n),
      o AS (SELECT *, list_distinct(regexp_extract_all(stem, '{WORDS_PATTERN}')) AS own FROM s), c AS (SELECT *, len(list_intersect(own, ['概要设计', '7'])) / greatest(1, len(own)) AS share FROM o),
      d AS (SELECT chunk_uuid, CASE WHEN contains('《概要设计》 概要设计_7', name) THEN 1 WHEN contains('《概要设计》 概要设计_7', stem) THEN 2 WHEN contains(name, '概要设计') THEN 3 WHEN share >= 0.7 THEN 5 WHEN share >= 0.4 THEN 6 END AS k FROM c),
      r AS (SELECT chunk_uuid, [1.0, 0.95, 0.9, 0.85, 0.8, 0.6][k]::DOUBLE AS docname_score, ['filename_in_query', 'filestem_in_query', 'hint_in_filename', 'hint_in_filestem', 'token_overlap_high', 'token_overlap_mid'][k] AS docname_reason FROM d WHERE k IS NOT NULL)
      SELECT chunk_uuid, 0.2::DOUBLE + 0.2::DOUBLE * docname_score AS score, docname_score, docname_reason FROM r ORDER BY docname_score DESC, chunk_uuid LIMIT 9""",
    "search_hits": search_sql(
        ("latency", "fr", "1", "12ms"), ("phase = 'design' AND quality_level = 'high'", "phase = 'design'", "true"), ("phase = 'design'", "quality_level = 'high'"),
        ("概要设计", "latency", "fr", "1"), "概要设计", "phase = 'design' AND quality_level = 'high'",
    ),
    "search_dense_only": search_sql(
        ("x",), ("phase = 'design' AND quality_level = 'high'", "phase = 'design'", "true"), ("phase = 'design'", "quality_level = 'high'"), ("latency", "module"), dense=True
    ),
    "course_docs": search_sql(
        ("latency", "fr", "1", "12ms"), ("phase = 'design' AND doc_type = '概要设计'", "phase = 'design'", "true"), ("phase = 'design'", "doc_type = '概要设计'"), ("latency", "fr", "1", "12ms"),
        columns="project_id, doc_type, phase, section_path, quality_level, year, term",
    ),
    "phase_examples": search_sql(
        ("latency", "12ms"), ("phase = 'requirement' AND doc_type = '需求' AND quality_level = 'high'", "phase = 'requirement'", "true"), ("phase = 'requirement'", "doc_type = '需求'", "quality_level = 'high'"),
        limit=5, columns="project_id, doc_type, section_path, year, term",
    ),
    "section_examples": search_sql(
        ("doc", "目标", "latency"), ("quality_level = 'high'", "true"), ("quality_level = 'high'",), ("doc", "目标", "latency"), limit=3, columns="project_id, doc_type, section_path, year, term"
    ),
}
ORACLE["rules_of_a_table"] = """WITH w AS (SELECT item_id, regexp_extract_all(text, '[a-z]{8,}') AS l FROM benchmark),
k AS (SELECT item_id, unnest(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 3)) AS w FROM w)
SELECT doc_id, (SELECT min(item_id) FROM k WHERE contains(text, k.w))::VARCHAR AS rule FROM documents"""
#: Shares of a passage's terms, letters and pairs of neighbours in every document.
ORACLE["ranker_features"] = f"""WITH qs AS (SELECT lower(text) AS phrase, regexp_extract_all(lower(text), '{WORDS_PATTERN}') AS qa, list_distinct(qa) AS w, list_distinct(list_transform(range(1, len(qa)), lambda i: qa[i] || ' ' || qa[i + 1])) AS qp FROM benchmark WHERE item_id = 0),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS low, regexp_extract_all(low, '{WORDS_PATTERN}') AS a FROM documents),
p AS (SELECT *, list_distinct(list_transform(range(1, len(a)), lambda i: a[i] || ' ' || a[i + 1])) AS side, list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i + 2])) AS further FROM d)
SELECT doc_id, round(len(list_intersect(w, list_distinct(a)))::DOUBLE / len(w), 6) AS terms,
  round(coalesce(list_sum(list_transform(list_intersect(w, list_distinct(a)), lambda t: length(t))), 0)::DOUBLE / list_sum(list_transform(w, lambda t: length(t))), 6) AS letters,
  round(len(list_intersect(qp, side))::DOUBLE / len(qp), 6) AS pairs, round(len(list_intersect(qp, list_distinct(list_concat(side, further))))::DOUBLE / len(qp), 6) AS near_pairs,
  round(len(list_filter(a, lambda t: list_contains(w, t)))::DOUBLE / greatest(1, len(a)), 6) AS density, contains(low, phrase)::INT::DOUBLE AS phrase, round(1 / (1 + ln(1 + len(a))), 6) AS shortness FROM p, qs"""
#: CRC-32 of terms by the table of its polynomial; the lower 16 bits name a term.
ORACLE["term_statistics"] = f"""WITH tab AS (SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
t AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{WORDS_PATTERN}'))) AS w FROM documents), u AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM t)),
c AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || substring(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8))) & 65535 AS feature FROM u, tab),
f AS (SELECT feature, count(DISTINCT doc_id) AS df FROM t JOIN c USING (w) GROUP BY feature) SELECT feature::INT AS feature, df, round(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM f"""
ORACLE["section_substring"] = f"{WITH}{CHUNKS} SELECT d.doc_id AS query_id, c.doc_id, chunk_index FROM chunks c JOIN documents d ON d.doc_id % 20 = 0 AND contains(section_path, 'oc ' || d.doc_id)"
ORACLE["sparse_topk_postings"] = ORACLE["sparse_topk_all"]
ORACLE["dense_topk_cells"] = ORACLE["dense_topk_many"]
ORACLE["candidate_merge"] = f"""WITH nm AS (SELECT *, row_number() OVER (ORDER BY docname_score DESC, chunk_uuid) AS place FROM ({ORACLE["docname_recall"]})),
  c AS (SELECT lpad(doc_id::VARCHAR, 9, '0') AS chunk_uuid, 1 / (1 + row_number() OVER w)::DOUBLE AS score, row_number() OVER w AS seq FROM documents WINDOW w AS (ORDER BY n_chars DESC, doc_id) QUALIFY seq <= 80)
  SELECT coalesce(c.chunk_uuid, nm.chunk_uuid) AS chunk_uuid, coalesce(c.score, nm.score) AS score, coalesce(docname_score, 0::DOUBLE) AS docname_score, coalesce(docname_reason, 'none') AS docname_reason,
  row_number() OVER (ORDER BY seq NULLS LAST, place)::INT AS seq FROM c FULL JOIN nm ON c.chunk_uuid = nm.chunk_uuid"""
