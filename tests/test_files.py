"""Sources, ingestion, service functions, command line and streaming."""

import io
import json
import os
import sys
import zipfile
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from docquarry import cli, service
from docquarry.ingest import ingest_directory
from docquarry.operators.store import ChunkStore
from docquarry.sources import files, listing
from docquarry.streaming.ingest import start_ingest

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*blocks: str, styles: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {W}><w:body>{''.join(blocks)}</w:body></w:document>")
        archive.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
    return out.getvalue()


def paragraph(text: str, style: str = "") -> str:
    mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{mark}<w:r><w:t>{text}</w:t></w:r></w:p>"


def table(*rows) -> str:
    return (
        "<w:tbl>"
        + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
        + "</w:tbl>"
    )


def parsed(spark, given: dict[str, bytes]) -> dict:
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in given.items()], "file_path string, content binary")
    return {r.file_path: r for r in files.parse_files(rows).collect()}


def texts(row) -> list[tuple]:
    return [(p.page_num, p.text) for p in row.pages]


def test_docx(spark):
    body = docx(
        paragraph("before   the \x09 rest"), paragraph("Aims", "H"), paragraph("one"), paragraph(" "), table(["a", "b"], ["", ""], ["c"]),
        paragraph("Details", "Heading2"), *(paragraph(f"p{i}") for i in range(61)),
        styles='<w:style w:styleId="H"><w:name w:val="heading 1"/></w:style>',
    )
    got = parsed(spark, {"x/a.docx": body, "b.docx": b"not a zip", "c.txt": b"x"})
    pages = texts(got["x/a.docx"])
    assert pages[0] == (1, "before  the \t rest")
    assert pages[1] == (2, "# Aims\none\n| a | b |\n| --- | --- |\n| c |  |")
    assert pages[2][1].splitlines() == ["#### Details", *(f"p{i}" for i in range(59))]
    assert pages[3] == (4, "p59\np60")
    assert got["b.docx"].error and not got["b.docx"].pages and got["c.txt"].error == "unsupported file type: .txt"


def test_markdown_bytes_and_noise(spark):
    got = parsed(
        spark, {"a.md": b"# T\n\xff\xfe bad\n> [TOC]\n## Two\ntext", "empty.md": b"", "b.MARKDOWN": "# é".encode()}
    )
    assert texts(got["a.md"]) == [(1, "# T\n�� bad"), (2, "## Two\ntext")]
    assert texts(got["empty.md"]) == [] and got["empty.md"].error is None
    assert texts(got["b.MARKDOWN"]) == [(1, "# é")]


def test_pdf_entries(spark, monkeypatch):
    words = [
        {"text": "Big", "fontname": "X", "size": 20.0, "top": 10.0},
        {"text": "title", "fontname": "X", "size": 20.0, "top": 11.0},
        {"text": "plain", "fontname": "X", "size": 9.0, "top": 40.0},
    ]
    first = SimpleNamespace(
        extract_words=lambda **_: words,
        extract_tables=lambda: [[["h", None], [None, None], ["a\nb", "c"]]],
        images=[1, 2],
        extract_text=lambda: "unused",
    )
    second = SimpleNamespace(
        extract_words=lambda **_: [], extract_tables=lambda: None, images=None, extract_text=lambda: " only text "
    )
    third = SimpleNamespace(
        extract_words=lambda **_: [], extract_tables=lambda: [], images=[], extract_text=lambda: None
    )
    spans = SimpleNamespace(
        get_text=lambda _: {
            "blocks": [
                {
                    "lines": [
                        {"spans": [{"text": "Bold", "size": 12, "font": "A-Bold"}, {"text": " "}]},
                        {"spans": [{"text": "small", "size": 8}]},
                    ]
                },
                {},
            ]
        }
    )
    entries = {
        "w.pdf": [e for i, p in enumerate((first, second, third), 1) for e in files.word_entries(i, p)],
        "s.pdf": files.span_entries(1, spans),
        "none.pdf": [],
    }
    fields = [f.name for f in files.ENTRY]
    rows = [(n, n, [tuple(e.get(f) for f in fields) for e in es], None) for n, es in entries.items()]
    df = spark.createDataFrame(rows, f"file_path string, file_name string, entries {files.ENTRIES}, error string")
    got = {r.file_path: r for r in files.pdf_pages(df).collect()}
    note = "> [图例：本页包含 2 张图片/架构图，详情请参考原始文档。]"
    assert texts(got["w.pdf"]) == [
        (1, "# Big title\nplain\n\n| h |  |\n| --- | --- |\n| a b | c |\n\n" + note), (2, "only text")
    ]
    assert texts(got["s.pdf"]) == [(1, "#### Bold\nsmall")] and texts(got["none.pdf"]) == []
    failed = parsed(spark, {"x.pdf": b"junk"})["x.pdf"]
    assert failed.error and failed.pages == []


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, f"{tmp_path}/store", dims=64)


def body(word: str, n: int = 3) -> str:
    return "".join(f"# {word} {i}\n" + f"{word} text. " * 20 + "\n" for i in range(n))


def live(store) -> list[str]:
    return sorted(r.text for r in store.read().select("text").collect())


def test_directory_reports_every_file(spark, store, tmp_path):
    folder = tmp_path / "in"
    (folder / "2024" / "proj").mkdir(parents=True)
    (folder / "2024" / "proj" / "测试报告.md").write_text(body("alpha"))
    (folder / "empty.md").write_bytes(b"")
    (folder / "bad.docx").write_bytes(b"x")
    (folder / "note.txt").write_text("x")
    report = {r.source_file.rpartition("/")[2]: r for r in ingest_directory(store, str(folder)).collect()}
    assert {n: r.status for n, r in report.items()} == {
        "测试报告.md": "ok", "empty.md": "empty", "bad.docx": "error", "note.txt": "error"
    }
    good = report["测试报告.md"]
    assert good.chunks_total == good.chunks_inserted == 3 == store.read().count() and good.elapsed_seconds > 0 and good.document_id
    assert len(good.needs_review_items) == good.needs_review_count == 3
    assert {r.document_id for r in store.read().collect()} == {good.document_id}
    listed = {r.name.rpartition("/")[2]: r.size for r in service.list_files(spark, str(folder)).collect()}
    assert listed["empty.md"] == 0 and listed["note.txt"] == 1 and len(listed) == 4


def test_changed_and_deleted_files(spark, store, tmp_path):
    service.upload(store, "p/a.md", body("alpha").encode())
    service.upload(store, "p/b.md", body("beta", 1).encode())
    service.upload(store, "p/a.md", body("gamma", 2).encode())
    assert all("alpha" not in t for t in live(store)) and len(live(store)) == 3
    assert service.delete_file(store, " p/a.md ") == 2 and len(live(store)) == 1
    assert service.delete_file(store, "p/none.md") == 0
    service.upload(store, "p/a.md", body("delta", 2).encode())
    assert sum("delta" in t for t in live(store)) == 2
    service.upload(store, "p/b.md", b" \n ")  # nothing to read leaves the old text
    assert sum("beta" in t for t in live(store)) == 1
    assert store.compact(f"{tmp_path}/compact").read().count() == 3
    with pytest.raises(ValueError):
        service.upload(store, "a.txt", b"x")
    with pytest.raises(ValueError):
        service.upload(store, "a.md", b"")
    with pytest.raises(ValueError):
        service.delete_file(store, "  ")


def test_upload_batch_keeps_sources(spark, store, tmp_path):
    given = {"x/one.md": body("one").encode(), "../two.md": body("two").encode(), "three.docx": b"junk"}
    report = service.upload_batch(store, given, project_id="string", term=" 春季 ", year=2030, sources=f"{tmp_path}/kept")
    assert sorted(r.status for r in report.collect()) == ["error", "ok", "ok"]
    kept = {r.name.rpartition("/kept/")[2]: r.size for r in service.list_files(spark, f"{tmp_path}/kept").collect()}
    assert kept == {"x/one.md": len(given["x/one.md"]), "two.md": len(given["../two.md"]), "three.docx": 4}
    assert {(r.term, r.year) for r in store.read().collect()} == {("春季", 2030)}


def test_delete_then_command_line(spark, store, tmp_path, capsys, monkeypatch):
    folder = tmp_path / "in"
    folder.mkdir()
    path = folder / "a.md"
    path.write_text(body("alpha"))
    monkeypatch.setattr(cli.SparkSession, "builder", SimpleNamespace(getOrCreate=lambda: spark))
    cli.main(["--dir", str(folder), "--store", store.path])
    out = [json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert out[0]["status"] == "ok" and out[-1] == {"files": 1, "total_chunks": 3, "total_review": 3}
    assert service.delete_file(store, str(path)) == 3 and live(store) == []
    cli.main(["--file", str(path), "--store", store.path, "--report", f"{tmp_path}/report"])
    assert len(live(store)) == 3
    assert spark.read.json(f"{tmp_path}/report").first().status == "ok"


def streamed(store, folder, tmp_path) -> list[tuple]:
    """One run of the stream, restarted from its checkpoint: (file, first word) of every chunk."""
    start_ingest(store, str(folder), f"{tmp_path}/checkpoint").awaitTermination()
    return sorted((r.source_file[len(str(folder)) + 1 :], r.text.split()[1]) for r in store.read().collect())


def test_streaming_takes_every_change(spark, store, tmp_path):
    folder = tmp_path / "in"
    (folder / "deep" / "er").mkdir(parents=True)
    service.upload(store, f"{folder}/a.md", body("old").encode())
    (folder / "a.md").write_text(body("new", 2))
    (folder / "deep" / "er" / "b.md").write_text(body("beta", 1))
    (folder / "_hidden.md").write_text(body("hidden", 1))
    first = [("a.md", "new"), ("a.md", "new"), ("deep/er/b.md", "beta")]
    assert streamed(store, folder, tmp_path) == first
    version = store.snapshot().version
    assert streamed(store, folder, tmp_path) == first and store.snapshot().version == version  # nothing new, no commit
    (folder / "a.md").write_text(body("other", 1))  # changed in place
    (folder / "twin.md").write_text(body("beta", 1))  # what another path holds already
    (folder / "late.md").write_text(body("late", 1))
    os.utime(folder / "late.md", (1_000_000, 1_000_000))  # dated far behind all others
    rest = [("deep/er/b.md", "beta"), ("late.md", "late"), ("twin.md", "beta")]
    assert streamed(store, folder, tmp_path) == [("a.md", "other"), *rest]
    (folder / "a.md").write_text(body("new", 2))  # back to what it was
    os.utime(folder / "twin.md")  # touched, the same
    assert streamed(store, folder, tmp_path) == [("a.md", "new"), ("a.md", "new"), *rest]
    taken = {r.source_file[len(str(folder)) + 1 :]: r.n for r in store.reports().groupBy("source_file").agg(F.count("*").alias("n")).collect()}
    assert taken == {"a.md": 4, "deep/er/b.md": 1, "late.md": 1, "twin.md": 1}


def test_listing_on_executors(spark, tmp_path):
    folder = tmp_path / "in"
    for i in range(6):
        (folder / f"d{i}" / "x").mkdir(parents=True)
        (folder / f"d{i}" / "x" / "f.md").write_bytes(b"a" * i)
        (folder / f"d{i}" / "g.md").write_bytes(b"b" * 100)
    (folder / "top.md").write_bytes(b"")
    (folder / ".hidden").mkdir()
    (folder / ".hidden" / "no.md").write_text("x")
    for depth in (0, 1, 2, 5):
        rows = listing.listed(spark, str(folder), depth)
        got = {r.path[len(str(folder)) + 1 :]: r.length for r in rows.collect()}
        want = {f"d{i}/x/f.md": i for i in range(6)} | {f"d{i}/g.md": 100 for i in range(6)} | {"top.md": 0}
        assert got == want
    assert listing.listed(spark, str(folder), 1).rdd.getNumPartitions() == 7
    dealt = listing.by_bytes(listing.listed(spark, str(folder), 0), 150)
    assert dealt.count() == 13 and dealt.select(F.sum("length")).first()[0] == 615
    got = listing.contents(dealt, str(folder)).select("length", F.length("content").alias("n")).collect()
    assert len(got) == 13 and all(r.length == r.n for r in got)
    gone = spark.createDataFrame([(f"{folder}/none.md", 0, 1)], listing.LISTED)
    assert listing.contents(gone, str(folder)).count() == 0
    one = files.read_files(spark, f"{folder}/d1/g.md").collect()
    assert len(one) == 1 and listing.listed(spark, f"{folder}/missing").count() == 0


def test_pages_of_a_pdf_fail_alone(monkeypatch):
    def bad(**_):
        raise ValueError("no words here")

    def page(words):
        return SimpleNamespace(extract_words=words, extract_tables=lambda: [], images=[], extract_text=lambda: "plain")

    class Pdf:
        pages = [page(lambda **_: [{"text": "w"}]), page(bad)]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    monkeypatch.setitem(sys.modules, "pdfplumber", SimpleNamespace(open=lambda _: Pdf()))
    got = [(e["page"], e["kind"], e.get("text")) for e in files.pdf_entries(b"x")]
    assert got == [(1, "word", "w"), (1, "images", None), (2, "text", "plain")]


def test_search_store(spark, store):
    service.upload(store, "2024/春季/proj/概要设计.md", ("# 目标\nlatency FR-1 TC-2 module " + "design text. " * 20).encode())
    service.upload(store, "2024/夏季/proj/测试报告.md", ("# 目标\nother words " + "report text. " * 20).encode())
    hits = service.search_store(store, "latency module", phase="string", term=None).collect()
    assert [h.metadata.source_file for h in hits][0].endswith("概要设计.md") and len(hits) == 2
    only = service.search_store(store, "latency module", project_id="proj", phase="design", term="春季").collect()
    assert {h.metadata.phase for h in only} >= {"design"} and service.health() == {"status": "ok"}
