"""Workbooks made by hand, read as tables."""

import zipfile
from html import escape

import pytest

from graphloom.sources import sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def workbook(path, rows, shared=True, name="Data"):
    """A workbook with a sheet before the one wanted."""
    strings, cells = [], []
    for r, row in enumerate(rows, 1):
        out = []
        for c, v in enumerate(row):
            ref = (chr(65 + c) if c < 26 else "A" + chr(65 + c - 26)) + str(r)
            if v is None:
                continue
            if isinstance(v, bool):
                out.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                out.append(f'<c r="{ref}"><v>{v}</v></c>')
            elif shared:
                strings.append(v)
                out.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
            else:
                out.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
        cells.append(f'<row r="{r}">{"".join(out)}</row>')
    si = "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r><rPh><t>no</t></rPh></si>" if k % 2 else f"<si><t>{escape(s)}</t></si>" for k, s in enumerate(strings))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Other" r:id="r1"/><sheet name="{name}" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData><row><c><v>9</v></c></row></sheetData></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {MAIN}><sheetData>{''.join(cells)}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>{si}</sst>")


def test_sheets_of_many_files(spark, tmp_path):
    head = ["species", "Symbol", None, "PMID", *[f"c{k}" for k in range(30)]]
    workbook(tmp_path / "a.xlsx", [head, ["Human", "TP53", None, 12.5, *range(30)], [], ["Mouse", None, "x", None], [None, "<MDM2>", None, True]])
    workbook(tmp_path / "b.xlsx", [["Symbol", "species"], *[[f"G{k}", "Human"] for k in range(2500)]], shared=False)
    df = sheets.read_xlsx(spark, str(tmp_path), "Data")
    assert df.columns == ["species", "Symbol", "PMID", *[f"c{k}" for k in range(30)], "pos", "file"]
    rows = df.orderBy("file", "pos").collect()
    assert len(rows) == 2503 and tuple(rows[0])[:3] == ("Human", "TP53", "12.5") and rows[0].c29 == "29" and rows[0].c26 == "26"
    assert tuple(rows[1])[:3] == ("Mouse", None, None) and tuple(rows[2])[:3] == (None, "<MDM2>", "true") and rows[3].Symbol == "G0" and rows[3].PMID is None
    few = sheets.read_xlsx(spark, str(tmp_path / "*.xlsx"), "Data", ["Symbol", "none"])
    assert few.columns == ["Symbol", "none", "pos", "file"] and few.where("none IS NULL").count() == 2503
    assert [r.pos for r in sheets.read_xlsx(spark, str(tmp_path / "a.xlsx")).collect()] == []


def test_a_bad_file_is_named(spark, tmp_path):
    workbook(tmp_path / "good.xlsx", [["a"], ["x"]])
    (tmp_path / "zbad.xlsx").write_bytes(b"PK no workbook")
    with pytest.raises(Exception, match=r"zbad\.xlsx can't be read as a workbook"):
        sheets.read_xlsx(spark, str(tmp_path), "Data").count()
    with pytest.raises(Exception, match=r"good\.xlsx can't be read.*no sheet 'None such'"):
        sheets.read_xlsx(spark, str(tmp_path / "good.xlsx"), "None such", ["a"]).count()


def test_cell_markers_from_a_workbook(spark, tmp_path):
    from graphloom.sources import adapters as A

    workbook(tmp_path / "m.xlsx", [["species", "cancer_type", "Symbol", "cell_name", "tissue_type", "cellontology_id", "PMID"], ["Human", "Normal", "cd4", "T cell", "Blood", "CL_1", 1], ["Mouse", "Normal", "cd8", "T cell", "Blood", "CL_1", 2]])
    rows = A.marker_rows(sheets.read_xlsx(spark, str(tmp_path / "m.xlsx"), "Data"))
    assert [tuple(r) for r in rows.orderBy("pos").collect()] == [("Human", "Normal", "cd4", "T cell", "Blood", "CL_1", "1", 1), ("Mouse", "Normal", "cd8", "T cell", "Blood", "CL_1", "2", 2)]
    assert [r.name for r in A.cell_nodes(rows, "Human", "Normal").collect()] == ["T cell"]
