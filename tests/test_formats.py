"""Files of every format, against what stands in them."""

import io
import zipfile

from quarry.sources import formats as f


def workbook() -> bytes:
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} {rel}><sheets><sheet name="One" r:id="a"/><sheet name="Empty" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>region</t></si><si><r><t>va</t></r><r><t>lor</t></r></si></sst>")
        rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>Sur</t></is></c><c r="C2"><v>3.5</v></c></row><row><c r="C3"><v>4</v></c></row>'
        z.writestr("xl/worksheets/s1.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/worksheets/s2.xml", f"<worksheet {main}><sheetData/></worksheet>")
    return out.getvalue()


def test_every_format_goes_to_its_reader(spark):
    files = {
        "a/t.md": b"# Title\nSome text\xc3", "a/p.html": b"<html><body><p>Hello</p><nav>x</nav></body></html>", "a/j.json": b'{"title": "T", "body": "B"}',
        "a/u.json": b'{"x": {"y": ["one", "two \\"q\\""]}}', "a/c.csv": "país;n\nPerú;3\nbad\n;4\n".encode("cp1252"), "a/x.xlsx": workbook(),
        "a/broken.xlsx": b"no zip", "a/d.pdf": b"%PDF", "a/i.png": b"\x89", "a/n.exe": b"",
    }
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files.items()], "path string, content binary")
    got = {r.path: (r.format, r.text) for r in f.documents(df, {"pdf": lambda c: f"{len(c)} bytes"}).collect()}
    assert got == {
        "a/t.md": ("md", "# Title\nSome text"), "a/p.html": ("html", "Hello"), "a/j.json": ("json", "# T\n\nB"), "a/u.json": ("json", 'one\ntwo "q"'),
        "a/c.csv": ("csv", "país: Perú | n: 3\nn: 4"), "a/x.xlsx": ("xlsx", "# One\nregion: Sur | valor: 3.5\nvalor: 4\n\n# Empty"), "a/broken.xlsx": ("xlsx", None),
        "a/d.pdf": ("pdf", "4 bytes"), "a/i.png": ("img", None),
    }


def test_tables_are_cut_and_say_so():
    rows = [["k"], *[[str(i)] for i in range(501)]]
    assert f.table_text([("", rows)])[1] and not f.table_text([("", rows[:501])])[1]
    assert f.table_text([("", rows)])[0].count("\n") == 499
    assert f.delimiter("a|b\n1|2") == "|" and f.delimiter("plain\nlines, here") == "," and f.delimited(b"") == []
