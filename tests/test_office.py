"""Workbooks and documents built with zipfile alone."""

import zipfile
from datetime import datetime

import pytest

from orrery import cli
from orrery.sources import catalog, office

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def relations(targets):
    return f'<Relationships xmlns="{PACKAGE}">' + "".join(f'<Relationship Id="{i}" Type="x" Target="{t}"{m}/>' for i, t, m in targets) + "</Relationships>"


def build(path, sheets, strings=(), workbook="", styles=None):
    """A workbook of sheets {name: rows of cell XML}."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{workbook}<sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", relations([(f"rId{i}", f"worksheets/sheet{i}.xml", "") for i in range(1, len(sheets) + 1)]))
        for i, rows in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>' + "".join(f'<row r="{k}">{r}</row>' for k, r in enumerate(rows, 1)) + "</sheetData></worksheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        if styles is not None:
            z.writestr("xl/styles.xml", styles)
    return str(path)


def s(ref, k):
    return f'<c r="{ref}" t="s"><v>{k}</v></c>'


def n(ref, v, style=None):
    return f'<c r="{ref}"' + (f' s="{style}"' if style is not None else "") + f"><v>{v}</v></c>"


STYLES = f"""<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts>
<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>"""


@pytest.fixture
def book(tmp_path):
    strings = ["<t>name</t>", "<t>amount</t>", "<r><t>Ad</t></r><r><rPr><b/></rPr><t>a</t></r><rPh><t>x</t></rPh>", "<t xml:space='preserve'> b\nc </t>", "<t>Amount</t>", "<t>when</t>"]
    first = [
        s("A1", 0) + s("B1", 1) + s("D1", 4) + s("E1", 5) + '<c r="F1" t="inlineStr"><is><t>ok</t></is></c>',
        s("A2", 2) + n("B2", "3") + n("D2", "1.5", 3) + n("E2", "45658", 1) + '<c r="F2" t="b"><v>1</v></c>',
        "",
        s("A4", 3) + n("B4", "4.0") + '<c r="C4" t="e"><v>#REF!</v></c>' + n("D4", "2") + n("E4", "45658.5", 2),
        '<c r="A5"><v></v></c>' + '<c r="B5"><f>1+1</f><v>2</v></c><c r="F5" t="b"><v>0</v></c>',
    ]
    mixed = [s("A1", 0), n("A2", "7"), '<c r="A3" t="str"><f>x</f><v>text</v></c>', '<c t="b"><v>1</v></c>']
    return build(tmp_path / "My book.xlsx", {"2024 sales": first, "mixed": mixed, "empty": []}, strings, styles=STYLES)


def test_sheets_and_types(spark, book):
    assert office.sheet_names(book) == ["2024 sales", "mixed", "empty"]
    df = office.read_sheet(spark, book)
    assert df.dtypes == [("name", "string"), ("amount", "double"), ("column_3", "string"), ("Amount_2", "double"), ("when", "timestamp_ntz"), ("ok", "boolean")]
    assert [tuple(r) for r in df.collect()] == [
        ("Ada", 3.0, None, 1.5, datetime(2025, 1, 1), True),
        (" b\nc ", 4.0, None, 2.0, datetime(2025, 1, 1, 12), None),
        (None, 2.0, None, None, None, False),
    ]
    assert [r[0] for r in office.read_sheet(spark, f"file://{book}", "mixed").collect()] == ["7", "text", "true"]
    assert office.read_sheet(spark, book, "empty").collect() == []
    assert [tuple(r) for r in office.read_sheet(spark, book, "mixed", header=False).collect()] == [("name",), ("7",), ("text",), ("true",)]
    with pytest.raises(Exception, match="no sheet 'none'"):
        office.read_sheet(spark, book, "none")


def test_sheets_of_one_layout_are_partitions(spark, tmp_path):
    path = build(tmp_path / "b.xlsx", {f"m{k}": [s("A1", 0), *[n(f"A{i}", i * k) for i in range(2, 40)]] for k in (1, 2, 3)}, ["<t>v</t>"])
    df = office.read_workbook(spark, path)
    assert df.dtypes == [("sheet", "string"), ("v", "bigint")] and df.rdd.getNumPartitions() == 3
    assert {r["sheet"]: r["sum(v)"] for r in df.groupBy("sheet").sum("v").collect()} == {f"m{k}": k * sum(range(2, 40)) for k in (1, 2, 3)}


def test_first_day_of_1904(spark, tmp_path):
    path = build(tmp_path / "old.xlsx", {"a": [s("A1", 0), n("A2", "1", 1)]}, ["<t>d</t>"], '<workbookPr date1904="1"/>', STYLES)
    assert office.read_sheet(spark, path).first()[0] == datetime(1904, 1, 2)


def test_books_are_registered_by_their_sheets(spark, book, tmp_path):
    (tmp_path / "no.xlsx").write_text("no archive")
    names, warnings = catalog.register_files(spark, [book, str(tmp_path / "no.xlsx")])
    assert names == {"2024 sales": "t_2024_sales", "mixed": "mixed"} and len(warnings) == 2
    assert catalog.query_files(spark, "SELECT sum(amount) AS a FROM t_2024_sales", names).first()[0] == 9.0
    assert "t_2024_sales" in cli.run(["data", "inspect", "--files", book], spark)
    assert "mean" in cli.run(["data", "summary", "--files", book, "--table", "2024 sales"], spark).lower()


def test_a_long_sheet_is_read_as_a_stream(spark, tmp_path):
    path = build(tmp_path / "long.xlsx", {"a": ['<c t="inlineStr"><is><t>k</t></is></c>', *[f"<c><v>{i}</v></c>" for i in range(30_000)]]})
    assert office.read_sheet(spark, path).selectExpr("count(*) AS n", "sum(k) AS s").first() == (30_000, sum(range(30_000)))


def docx(path, body, links=()):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{W}" xmlns:r="{REL}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/_rels/document.xml.rels", relations([(i, t, ' TargetMode="External"') for i, t in links]))


def p(text, style="", runs=""):
    return f"<w:p><w:pPr>{style}</w:pPr><w:r><w:t xml:space='preserve'>{text}</w:t></w:r>{runs}</w:p>"


def test_documents_become_markdown(spark, tmp_path, book):
    cell = lambda t: f"<w:tc>{p(t)}</w:tc>"
    item = lambda k: f'<w:numPr><w:ilvl w:val="{k}"/><w:numId w:val="1"/></w:numPr>'
    body = (
        p("Title", '<w:pStyle w:val="Heading1"/>')
        + p("Plain ", "", '<w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:rPr><w:i/></w:rPr><w:t xml:space="preserve"> slanted</w:t></w:r><w:r><w:rPr><w:b w:val="0"/></w:rPr><w:t>.</w:t></w:r>')
        + p("one", item(0))
        + p("two", item(1))
        + p("")
        + p("Below", '<w:outlineLvl w:val="2"/>')
        + '<w:p><w:hyperlink r:id="r1"><w:r><w:t>here</w:t></w:r></w:hyperlink></w:p>'
        + f"<w:tbl><w:tr>{cell('a')}{cell('b')}</w:tr><w:tr>{cell('1|2')}</w:tr></w:tbl>"
    )
    docx(tmp_path / "a.docx", body, [("r1", "https://example.org/x")])
    A, P = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    with zipfile.ZipFile(tmp_path / "b.pptx", "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:presentation xmlns:p="{P}" xmlns:r="{REL}"><p:sldIdLst><p:sldId id="256" r:id="r2"/><p:sldId id="257" r:id="r1"/></p:sldIdLst></p:presentation>')
        z.writestr("ppt/_rels/presentation.xml.rels", relations([("r1", "slides/slide1.xml", ""), ("r2", "slides/slide2.xml", "")]))
        for k in (1, 2):
            z.writestr(f"ppt/slides/slide{k}.xml", f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><a:p><a:r><a:t>text {k}</a:t></a:r></a:p></p:cSld></p:sld>')
    (tmp_path / "c.docx").write_bytes(b"broken")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r["path"].rpartition("/")[2]: r for r in office.documents_as_markdown(spark, str(tmp_path)).collect()}
    assert got["a.docx"]["markdown"] == "# Title\n\nPlain **bold** *slanted*.\n\n- one\n  - two\n\n### Below\n\n[here](https://example.org/x)\n\n| a | b |\n| --- | --- |\n| 1\\|2 |  |"
    assert got["b.pptx"]["markdown"] == "## Slide 1\n\ntext 2\n\n## Slide 2\n\ntext 1"
    assert got["c.docx"]["markdown"] is None and got["d.pdf"]["markdown"] is None and got["d.pdf"]["ending"] == "pdf"
    sheet = next(r for k, r in got.items() if k.endswith(".xlsx"))["markdown"]
    assert sheet.startswith("## 2024 sales\n\n| name | amount |") and "## empty" in sheet
