from zipfile import ZipFile

import pytest

from textlake.sources import office

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, rows, inline=False):
    """A small workbook: strings shared or inline, numbers as they are, None leaves a cell out."""
    shared, xml = [], []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, x in enumerate(row):
            ref = f"{chr(65 + c)}{r}"
            if x is None:
                continue
            if isinstance(x, int):
                cells.append(f'<c r="{ref}"><v>{x}</v></c>')
            elif inline:
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{x}</t></is></c>')
            else:
                shared.append(x)
                cells.append(f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>')
        xml.append(f'<row r="{r}">{"".join(cells)}</row>')
    with ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="s" r:id="rId7"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Target="worksheets/own.xml"/></Relationships>')
        z.writestr("xl/worksheets/own.xml", f"<worksheet {NS}><sheetData>{''.join(xml)}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>{''.join(f'<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>' for s in shared)}</sst>")


def document(path, paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p[:2]}</w:t><w:tab/><w:t>{p[2:]}</w:t></w:r></w:p>" for p in paragraphs)
    with ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')


def test_workbooks_of_both_layouts_and_damaged_ones(spark, tmp_path):
    workbook(tmp_path / "西湖断桥.xlsx", [["切词数", "匹配词数", "文本字数", "文本内容"], [3, 2, 40, " x" * 200], ["5a", None, "no", ""], [0, 0, 9, ""], [None, 1]])
    workbook(tmp_path / "letters.xlsx", [["A", "B", "C", "D"], [1, 2, 3, "text"]], inline=True)
    workbook(tmp_path / "金山寺.xlsx", [["序号", "地点名", "文本内容（全）"], [1, "金山寺", " a place "], [2, "金山寺", ""], [3]])
    workbook(tmp_path / "other.xlsx", [["x", "y"], [1, 2]])
    (tmp_path / "broken.xlsx").write_bytes(b"PK no archive")
    (tmp_path / "empty.xlsx").write_bytes(b"")  # Spark's source leaves out files of no bytes
    (tmp_path / "note.txt").write_text("not a sheet")
    rows = office.read_workbooks(spark, str(tmp_path)).collect()
    got = sorted((r.path.rsplit("/", 1)[1], r.row, r.tokens, r.matches, r.words, (r.text or "")[:7]) for r in rows if r.error is None)
    assert [g for g in got if not g[0].startswith(("西", "金"))] == [("letters.xlsx", 1, 1, 2, 3, "text")]
    paths = {r.path.rsplit("/", 1)[1] for r in rows}
    assert len(paths) == 5 and {p for p in paths if p.isascii()} == {"letters.xlsx", "other.xlsx", "broken.xlsx"}
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows if r.error) == ["broken.xlsx", "other.xlsx"]
    wide = sorted((r.row, r.tokens, r.matches, r.words, len(r.text), len(r.summary)) for r in rows if r.error is None and r.text != "text" and r.text != "a place")
    assert wide == [(1, 3, 2, 40, 399, 300), (2, 5, 0, 0, 0, 0), (4, 0, 1, 0, 0, 0)]
    assert [(r.tokens, r.matches, r.words) for r in rows if r.text == "a place"] == [(0, 1, 7)]


def test_places_by_file_name(spark, tmp_path):
    rows = spark.createDataFrame([("file:/x/west lake bridge.xlsx", 1), ("file:/x/west lake bridge.xlsx", 2), ("file:/lake/y.xlsx", 3)], "path string, row int")
    names = spark.createDataFrame([("bridge", "Bridge", 1), ("lake", "Lake", 2)], "part string, place string, rank int")
    assert sorted((r.row, r.place) for r in office.places(rows, names, "?").collect()) == [(1, "Bridge"), (2, "Bridge"), (3, "?")]


def test_documents_and_plain_texts(spark, tmp_path):
    document(tmp_path / "a.docx", ["one paragraph", "another"])
    document(tmp_path / "b.docx", ["hidden"])
    (tmp_path / "b.txt").write_text("﻿plain wins", encoding="utf-8")
    (tmp_path / "bad.docx").write_bytes(b"x")
    (tmp_path / "latin.txt").write_bytes(b"\xff\xfe\xfa")
    got = {r.path.rsplit("/", 1)[1]: (r.text, bool(r.error)) for r in office.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": ("on\te paragraph\n\nan\tother", False), "b.txt": ("plain wins", False), "bad.docx": (None, True), "latin.txt": (None, True)}
    assert office.load_text(spark, str(tmp_path / "b")).first().text == "plain wins"
    for stem in ("c", "none/x"):
        with pytest.raises(FileNotFoundError):
            office.load_text(spark, str(tmp_path / stem))
