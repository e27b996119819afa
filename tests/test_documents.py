"""Scans keep account of windows that fail; Word files and first bytes."""

import io
import zipfile

from textloom.operators import scan as N
from textloom.sources import files as S


def test_failed_windows_are_counted(spark):
    docs = spark.createDataFrame([(1, "The crate is late. The buyer waits for the crate. Nothing more is said."), (2, "No word on it here.")], "doc long, text string")
    windows = spark.createDataFrame([(1, 0, 0, 40), (1, 1, 30, 72), (2, 0, 0, 19)], "doc long, index int, start int, end int")
    questions = spark.createDataFrame([(7, 1, "crate late"), (7, 2, "crate late")], "question_id int, doc long, text string")

    def extract(question, text):
        if "No word" in text:
            raise RuntimeError("model is away")
        return ["The crate is late.", "something made up that is nowhere"]

    found, account = N.scan(windows, docs, questions, extract)
    assert [(r["doc"], r["start"], r["end"]) for r in found.collect()] == [(1, 0, 18)]
    assert sorted((r["doc"], r["n_windows"], r["n_failed"], r["n_discarded"]) for r in account.collect()) == [(1, 2, 0, 2), (2, 1, 1, 0)]


def test_the_extractor_is_asked_once_for_each_window(spark, tmp_path):
    docs = spark.createDataFrame([(1, "The crate is late. The buyer waits for the crate."), (2, "No word on it here.")], "doc long, text string")
    windows = spark.createDataFrame([(1, 0, 0, 18), (1, 1, 19, 49), (2, 0, 0, 19)], "doc long, index int, start int, end int")
    questions = spark.createDataFrame([(7, 1, "crate"), (7, 2, "crate")], "question_id int, doc long, text string")

    def extract(question, text):
        with (tmp_path / "asked").open("a") as out:
            out.write(f"{text}\n")
        return [text]

    found, account = N.scan(windows, docs, questions, extract)
    assert found.count() == account.join(found, ["question_id", "doc"]).count() == 3
    assert len((tmp_path / "asked").read_text().splitlines()) == 3


def word_file():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="Base"><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style><w:style w:styleId="Own"><w:basedOn w:val="Base"/></w:style></w:styles>')
        z.writestr("word/numbering.xml", f'<w:numbering {w}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1)"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>')
        z.writestr(
            "word/document.xml",
            f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Own"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr></w:pPr><w:r><w:t>kept </w:t></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:del><w:r><w:delText>old</w:delText></w:r></w:del></w:p>'
            "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
        )
    return out.getvalue()


def test_word_paragraphs():
    got = S.word_paragraphs(word_file())
    assert [(p["text"], p["heading_level"], p["label"], p["in_table"]) for p in got] == [("Head", 2, None, False), ("kept new", None, "3)", False), ("cell", None, None, True)]


def test_kinds_and_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(word_file())
    (tmp_path / "b.pdf").write_bytes(b"\n%PDF-1.4 rest")
    (tmp_path / "c.bin").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1old")
    (tmp_path / "d.txt").write_text("plain words")
    with zipfile.ZipFile(tmp_path / "e.zip", "w") as z:
        z.writestr("x", "y")
    got = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in S.with_kind(S.read_files(spark, str(tmp_path))).collect()}
    assert got == {"a.docx": "docx", "b.pdf": "pdf", "c.bin": "doc", "d.txt": "text", "e.zip": "zip"}


def test_html_blocks():
    assert S.html_blocks("<h1>A &amp; b</h1><p>one<br>two<script>no</script><ul><li>x<li>y</ul>tail") == [("h1", "A & b"), ("p", "one two"), ("li", "x"), ("li", "y"), ("p", "tail")]
