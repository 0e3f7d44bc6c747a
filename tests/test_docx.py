"""Word files made here, and their units worked out by hand."""

import io
import zipfile

from pyspark.sql import functions as F

from quillspark.operators import word as D
from quillspark.sources.docx import items_of
from quillspark.sources.documents import file_text, read_files

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = f'<w:styles {NS}><w:style w:type="paragraph" w:default="1" w:styleId="N"><w:name w:val="Normal"/></w:style><w:style w:type="paragraph" w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>'
LONG = "this line follows and is long enough to be a body"


def p(text="", style="", brk=False, outline=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:outlineLvl w:val="{outline}"/>' if outline is not None else "")
    return f'<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r>' + ('<w:r><w:br w:type="page"/></w:r>' if brk else "") + "</w:p>"


def table(*rows):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


def docx(*parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{''.join(parts)}</w:body></w:document>")
        z.writestr("word/styles.xml", STYLES)
    return out.getvalue()


T1 = table(("a", "b"), ("1", "2|"))
FILES = [
    (1, docx(p("before"), p("Top", outline=0), p(LONG), T1, p(), p("Sub", "H2"), p("2.1 Plain words"), p(LONG), table(("x",)))),
    (2, docx(p("one"), p(brk=True), p("two", brk=True), T1, p("three"))),
    (3, docx(p("x" * 2000), p("y" * 598), p("z"), p("w" * 3000))),
    (4, docx()),
    (5, b"no \xffzip"),
    (6, None),
]


def files(spark):
    return spark.createDataFrame(FILES, "doc_id long, content binary")


def units(spark, method, doc):
    return D.extract_docx(files(spark), method).where(f"doc_id = {doc}").orderBy("unit_ord").collect()


def test_items_have_signs_spans_and_merged_cells():
    run = '<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/></w:r><w:hyperlink><w:r><w:t>c</w:t></w:r></w:hyperlink></w:p>'
    wide = f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{p("q")}</w:tc><w:tc><w:tcPr><w:vMerge w:val="restart"/></w:tcPr>{p("m")}</w:tc></w:tr><w:tr><w:tc>{p("r")}</w:tc><w:tc>{p("s")}</w:tc><w:tc><w:tcPr><w:vMerge/></w:tcPr>{p()}</w:tc></w:tr></w:tbl>'
    first, second = items_of(docx(run, wide))
    assert first["text"] == "a\tb\nc" and first["style"] == "Normal"
    assert second["cells"] == [["q", "q", "m"], ["r", "s", "m"]]


def test_text_of_files(spark):
    got = {r["doc_id"]: r["t"] for r in files(spark).select("doc_id", file_text("content", F.lit(".docx")).alias("t")).collect()}
    assert got[2] == "one\n\ntwo\n\nthree\n\na | b\n1 | 2|"
    assert got[1].endswith("a | b\n1 | 2|\n\nx") and got[4] == "" and got[5] == "no zip" and got[6] is None


def test_read_files_unpacks_word_files_alone(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(FILES[1][1])
    (tmp_path / "b.txt").write_bytes(b"plain")
    (tmp_path / "c.docx").write_bytes(b"not packed")
    got = {r["name"]: (r["doc_type"], r["text"]) for r in read_files(spark, str(tmp_path)).collect()}
    assert got["a.docx"][1].startswith("one\n\ntwo") and got["b.txt"][1] == "plain" and got["c.docx"][1] == "not packed"


def test_blocks_and_tables(spark):
    got = units(spark, "block_wise", 2)
    assert [r["unit_id"] for r in got] == ["paragraph-1", "paragraph-2", "table-1", "paragraph-3"]
    assert got[2]["text"] == "| a | b |\n| --- | --- |\n| 1 | 2\\| |" and got[2]["format"] == "docx"
    assert [r["unit_id"] for r in units(spark, "table_aware", 1)] == ["table-1"]
    assert not [r for doc in (4, 5, 6) for r in units(spark, "block_wise", doc)]


def test_pages_by_breaks_and_by_length(spark):
    got = units(spark, "page_wise", 2)
    assert [(r["unit_id"], r["page"], r["reason"]) for r in got if r["unit_type"] == "page"] == [(f"page-{i}", i, "explicit_break") for i in (1, 2, 3)]
    assert [r["text"] for r in got if r["unit_type"] == "page"][:2] == ["one", "two"]
    assert [r["page"] for r in got if r["unit_type"] == "table"] == [3]
    # 2000 + 2 + 598 is a full page, so z starts the second and the 3000 the third
    assert [(len(r["text"]), r["page"]) for r in units(spark, "page_wise", 3)] == [(2600, 1), (1, 2), (3000, 3)]


def test_sections_by_outline_style_and_number(spark):
    got = units(spark, "section_wise", 1)
    assert [(r["title"], r["level"], r["reason"]) for r in got if r["unit_type"] == "section"] == [("before", 1, "before_first_heading"), ("Top", 1, "docx_heading"), ("Sub", 2, "docx_heading"), ("Plain words", 2, "docx_heading")]
    tab = next(r for r in got if r["unit_type"] == "table")
    assert (tab["parent_section_title"], tab["section_path"]) == ("Top", "Top")
    assert [r["text"] for r in got][1] == "Top\n\n" + LONG
