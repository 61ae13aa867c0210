"""Text helpers, chunking, hints and the store on literal cases."""

from pyspark.sql import functions as F

from docquarry.functions.text import file_stem, lines
from docquarry.operators import chunking, embedding, filters
from docquarry.operators.store import ChunkStore


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_lines(spark):
    for text in ("", "a", "a\n", "a\r\nb\n\nc", "\n"):
        assert one(spark, lines(F.lit(text))) == text.splitlines()
    assert [one(spark, file_stem(F.lit(x))) for x in ("a.b.md", ".md", "a")] == ["a.b", ".md", "a"]


def test_sections(spark):
    text = "intro\n# A\nbody\n## B\n" + "x" * 1500 + "\n### C\ntail\n## 总结\nend"
    got = [(r.path, r.text.split("\n")[0]) for r in one(spark, chunking.structural_sections(F.lit(text)))]
    assert got == [("", "intro"), ("A", "# A"), ("A > B", "## B"), ("A > B > C", "### C"), ("A > 总结", "## 总结")]
    assert [r.path for r in one(spark, chunking.summary_sections(F.lit("a\n小结\nb\n")))] == ["", "小结"]
    assert one(spark, chunking.summary_sections(F.lit(" \n "))) == []


def test_windows(spark):
    sentence = "s" * 299 + "。"
    got = one(spark, chunking.semantic_windows(F.lit(sentence * 5)))
    assert got[0] == sentence * 2 and got[1] == sentence[-100:] + sentence * 2
    assert one(spark, chunking.semantic_windows(F.lit("short"))) == []


def test_term_weights(spark):
    got = one(spark, embedding.term_weights(F.lit("b a b C c c")))
    assert sorted(got.values()) == [1.0, 2.0, 3.0]
    assert one(spark, embedding.term_weights(F.lit(""))) == {}
    assert sum(one(spark, embedding.term_vector(F.lit("b a b"), 8))) == 3


def test_normalization(spark):
    assert [one(spark, filters.normalize_text(F.lit(x))) for x in ("", " ", "NONE", "null", " design ")] == [
        None, None, None, None, "design"
    ]


def test_store(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/store", dims=2)
    assert not store.exists()
    rows = spark.createDataFrame(
        [("a", "f.md", "one", [1.0, 0.0]), ("b", "g.md", "two", [0.0, 1.0])],
        "chunk_uuid string, source_file string, text string, dense array<float>",
    )
    store.commit(rows)
    store.commit(rows.where("chunk_uuid = 'a'").withColumn("text", F.lit("new")), rows.where("chunk_uuid = 'a'"))
    assert {r.chunk_uuid: r.text for r in store.read().collect()} == {"a": "new", "b": "two"}
    assert store.delete("f.md") == 1 and store.delete("f.md") == 0
    assert [r.chunk_uuid for r in store.compact(f"file://{tmp_path}/next").read().collect()] == ["b"]


def test_plain_searches_equal_the_patterns(spark):
    """Blanks, breaks, sentences and rules by plain text searches give what the patterns over whole texts give."""
    import random

    from docquarry.functions import rules, text
    from docquarry.operators import metadata

    rng = random.Random(7)
    bits = [*text.BLANKS, *"ab|#。！？；图1%`", "\r\n", "\n", "\n\n", "| a | b |\n", "FR-1", "TC-2x", "SD-", "DES-9", "12ms", "总结", "\n## 小结\n", "Figure", "ER", "问题", "XAPI", "word " * 30]
    rows = [("".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))),) for _ in range(400)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    t, break_ = F.col("t"), text.BREAK
    assert all(c.isspace() for c in text.BLANKS) and len(set(text.BLANKS)) == 29
    parts = F.split(t, break_, -1)
    ids = lambda p: F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(text.py(p)), F.lit(0))))
    pairs = {
        "strip": (text.strip(t), F.regexp_replace(t, text.py(rf"\A{text.BLANK}+|{text.BLANK}+\z"), "")),
        "unify": (text.unify_breaks(t), F.regexp_replace(F.regexp_replace(t, break_, "\n"), r"\n\z", "")),
        "lines": (text.lines(t), F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)),
        "special": (chunking.is_special(t), F.lit(False) | t.rlike(text.py(rules.SPECIAL_PATTERNS[0])) | t.rlike(text.py(rules.SPECIAL_PATTERNS[1])) | t.rlike(text.py(rules.SPECIAL_PATTERNS[2]))),
        "req": (metadata.ids_of(t, rules.REQ_PATTERN, rules.REQ_MARKS), ids(rules.REQ_PATTERN)),
        "design": (metadata.ids_of(t, rules.DESIGN_PATTERN, rules.DESIGN_MARKS), ids(rules.DESIGN_PATTERN)),
        "test": (metadata.ids_of(t, rules.TEST_PATTERN, rules.TEST_MARKS), ids(rules.TEST_PATTERN)),
        "impl": (metadata.ids_of(t, rules.IMPL_PATTERN, rules.IMPL_MARKS), ids(rules.IMPL_PATTERN)),
    }
    for i, (pattern, *_) in enumerate([*rules.DOC_TYPE_RULES, *rules.ARTIFACT_RULES, *rules.EVIDENCE_RULES, (rules.METRIC_PATTERN,), (rules.TABLE_PATTERN,)]):
        assert rules.literals(pattern)  # none of them is tried on every text
        pairs[f"rule{i}"] = (rules.occurs(t, pattern), t.rlike(text.py(pattern)))
    assert rules.literals("a(b|c)d") is None and rules.literals("ab*|c") is None and rules.literals(r"\d+") is None
    for name, (got, want) in pairs.items():
        assert df.where(~got.eqNullSafe(want)).count() == 0, name
