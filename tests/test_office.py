"""DOCX and XLSX files written here, part by part, and read again."""

from __future__ import annotations

import zipfile

import pytest

from doclathe.sources.office import read_office

WORD = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
SHEET = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def para(text, style=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>' if style else f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def cell(text, more=""):
    return f"<w:tc><w:tcPr>{more}</w:tcPr>{para(text)}</w:tc>"


@pytest.fixture
def folder(tmp_path):
    table = f"<w:tbl><w:tr>{cell('A')}{cell('B')}</w:tr><w:tr>{cell('')}{cell(' ')}</w:tr><w:tr>{cell('wide', '<w:gridSpan w:val=\"2\"/>')}</w:tr></w:tbl>"
    body = f"<w:document {WORD}><w:body>{para('Title  here', 'H1')}{para('')}{para('plain words')}{table}{para('item', 'ListBullet')}</w:body></w:document>"
    styles = f'<w:styles {WORD}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>'
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/styles.xml", styles)
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {SHEET} {REL}><sheets><sheet name="Two" r:id="r2"/><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {SHEET}><si><t>Name</t></si><si><r><t>Gi</t></r><r><t>á</t></r></si></sst>")
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {SHEET}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f'<worksheet {SHEET}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"/></row><row><c r="B3"><v>5</v></c><c r="C3" t="b"><v>1</v></c></row></sheetData></worksheet>')
    (tmp_path / "c.docx").write_bytes(b"no package")
    (tmp_path / "d.txt").write_text("not read")
    return tmp_path


def test_files_are_read_with_tables_and_errors(spark, folder):
    got = {r.path[-6:]: r for r in read_office(spark, str(folder)).collect()}
    assert sorted(got) == ["a.docx", "b.xlsx", "c.docx"]
    a, b, c = got["a.docx"], got["b.xlsx"], got["c.docx"]
    assert [(e.type, e.text) for e in a.elements if e.type != "table"] == [("heading", "Title here"), ("paragraph", "plain words"), ("list", "item")]
    assert a.tables[0].matrix == [["A", "B"], ["wide", "wide"]] and a.total_pages == 1 and a.error is None
    assert [(t.sheet_name, t.matrix) for t in b.tables] == [("Two", [["Name", "", "Giá"], ["", "5", "True"]])]
    assert b.full_text.startswith("=== Sheet: Two ===\nName") and (b.total_pages, b.extraction_method, b.has_table) == (1, "table_extraction", True)
    assert [(e.type, e.text) for e in b.elements] == [("heading", "Sheet: Two"), ("table", "=== Sheet: Two ===\nName\t\tGiá\n\t5\tTrue")]
    assert [(p.page, p.method, p.sheet_name, p.text) for p in b.pages] == [(1, "table_extraction", "Two", "| Name |     | Giá  |\n| ---- | --- | ---- |\n|      | 5   | True |")]
    assert (b.tables[0].headers, b.tables[0].markdown, b.tables[0].page) == (["Name", "", "Giá"], b.pages[0].text, 1)
    assert (a.pages[0].text, a.pages[0].lines[0], a.original_filename, a.source_type) == (a.full_text, "Title here", "a.docx", "docx")
    assert c.error.startswith("BadZipFile") and c.full_text == "" and not c.has_table


def test_no_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("x")
    assert read_office(spark, str(tmp_path)).count() == 0


def test_dates_go_by_the_cells_format(spark, tmp_path):
    formats = ["General", "dd/mm/yyyy", '0.00" days"', "[Red]#,##0", "[h]:mm", "yyyy\\-mm"]
    own = "".join(f'<numFmt numFmtId="{170 + i}" formatCode="{f.replace(chr(34), "&quot;")}"/>' for i, f in enumerate(formats))
    xfs = "".join(f'<xf numFmtId="{n}"/>' for n in (0, 14, *range(170, 176), 22))
    values = [("45356", 0), ("45356", 1), ("45356", 2), ("45356.5", 3), ("3.5", 4), ("12", 5), ("0.25", 6), ("45356", 7), ("45356.75", 8), ("1", 1), ("60", 1), ("61", 1), ("x", 1)]
    cells = "".join(f'<c s="{s}"><v>{v}</v></c>' for v, s in values)
    for name, rule in (("a.xlsx", ""), ("b.xlsx", '<workbookPr date1904="1"/>')):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("xl/workbook.xml", f'<workbook {SHEET} {REL}>{rule}<sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
            z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
            z.writestr("xl/styles.xml", f"<styleSheet {SHEET}><numFmts>{own}</numFmts><cellXfs>{xfs}</cellXfs></styleSheet>")
            z.writestr("xl/worksheets/s1.xml", f"<worksheet {SHEET}><sheetData><row>{cells}</row></sheetData></worksheet>")
    a, b = (r.tables[0].matrix[0] for r in read_office(spark, str(tmp_path)).orderBy("path").collect())
    day = "2024-03-05 00:00:00"
    assert a == ["45356", day, "45356", "2024-03-05 12:00:00", "3.5", "12", "06:00:00", day, "2024-03-05 18:00:00", "1900-01-01 00:00:00", "1900-02-29 00:00:00".replace("02-29", "03-01"), "1900-03-01 00:00:00", "x"]
    assert b[1] == "2028-03-06 00:00:00"


def test_files_are_dealt_by_bytes(tmp_path):
    from doclathe.sources.office import OfficeReader

    for i in range(5):
        (tmp_path / f"{i}.docx").write_bytes(b"x" * 100)
    planned = OfficeReader({"path": str(tmp_path), "bytes_per_partition": "250"}).partitions()
    assert [len(p.paths) for p in planned] == [2, 2, 1]
