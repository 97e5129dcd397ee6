import zipfile
import zlib

import pytest

from tabloom.sources import records, workbooks


def test_csv(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('Name,,Name,Pay\n"Doe, J", x ,1,38.0\n,,,\nB,y,2,"1,000"\n')
    rows = records.read_csv(spark, str(p)).collect()
    assert records.header_names(["Name", "", "Name", "Pay"]) == ["Name", "column_2", "Name (2)", "Pay"]
    assert [r["Pay"] for r in rows] == ["38", "1,000"] and [r["_row_index"] for r in rows] == [1, 2] and rows[0]["column_2"] == "x"
    chunks = records.chunks_records(records.read_csv(spark, str(p))).collect()
    assert chunks[0]["text"] == "Name: Doe, J; column_2: x; Name (2): 1; Pay: 38"


def test_xlsx(spark, tmp_path):
    p = tmp_path / "a.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="S" sheetId="1"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Head</t></si><si><t>v</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>N</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>38.0</v></c></row></sheetData></worksheet>')
    assert records.sheet_names(spark, str(p)) == ["S"]
    r = records.read_source(spark, str(p), "xlsx").first()
    assert (r["Head"], r["column_2"], r["N"], r["_sheet"]) == ("v", "", "38", "S")
    with pytest.raises(records.SourceUnreadable):
        records.read_source(spark, str(p), "gif")


def test_typed_cells_of_swapped_sheets(spark, tmp_path):
    main, rel = "http://purl.oclc.org/ooxml/spreadsheetml/main", "http://purl.oclc.org/ooxml/officeDocument/relationships"
    link = lambda i, kind, to: f'<Relationship Id="{i}" Type="{rel}/{kind}" Target="{to}"/>'
    graph = lambda *x: f'<Relationships xmlns="r">{"".join(x)}</Relationships>'
    cells = '<c r="A2" s="1"><v>45292</v></c><c s="2"><v>45292.75</v></c><c r="D2" s="3"><v>0.5</v></c><c s="4"><v>1.25</v></c><c><v>38.0</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="str"><v>x</v></c><c t="s"><v>0</v></c><c s="5"><v>45292</v></c><c><v>0.1</v></c><c t="d"><v>2024-05-06T00:00:00</v></c><c s="1"><v>59</v></c><c><v>12345678901234567890</v></c>'
    p = tmp_path / "a.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("_rels/.rels", graph(link("w", "officeDocument", "/book/main.xml")))
        z.writestr("book/main.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="A" sheetId="1" r:id="x2"/><sheet name="B" sheetId="2" r:id="x1"/></sheets></workbook>')
        z.writestr("book/_rels/main.xml.rels", graph(link("x1", "worksheet", "worksheets/sheet1.xml"), link("x2", "worksheet", "/book/worksheets/sheet2.xml"), link("s", "styles", "looks.xml"), link("t", "sharedStrings", "words.xml")))
        z.writestr("book/words.xml", f'<sst xmlns="{main}"><si><r><t>two </t></r><r><t>runs</t></r><rPh><t>hint</t></rPh></si></sst>')
        z.writestr("book/looks.xml", f'<styleSheet xmlns="{main}"><numFmts><numFmt numFmtId="170" formatCode="[h]:mm"/><numFmt numFmtId="171" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="22"/><xf numFmtId="20"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
        z.writestr("book/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>of B</t></is></c></row></sheetData></worksheet>')
        z.writestr("book/worksheets/sheet2.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c t="inlineStr"><is><t>of A</t></is></c></row><row r="2">{cells}</row></sheetData></worksheet>')
    found = dict(workbooks.sheets(p.read_bytes()))
    assert list(found) == ["A", "B"] and found["B"] == [["of B"]] and found["A"][0] == ["of A"]
    want = ["2024-01-01", "2024-01-01 18:00", "", "12:00:00", "1 day, 6:00:00", "38", "True", "#N/A", "x", "two runs", "45292", "0.1", "2024-05-06", "1900-02-28", "12345678901234567890"]
    assert found["A"][1] == want
    assert records.read_xlsx(spark, str(p), "A").first()["of A"] == "2024-01-01" and records.sheet_names(spark, str(p)) == ["A", "B"]


def test_docx_and_text(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = tmp_path / "a.docx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    rows = records.read_source(spark, str(p), "docx").orderBy("part").collect()
    assert [(r["text"], r["element_type"], r["heading_path"]) for r in rows] == [("Top", "heading", "Top"), ("Body", "paragraph", "Top"), ("a | b", "table_row", "Top")]
    t = tmp_path / "a.txt"
    t.write_text("One. Two.\n\nThree.")
    assert [r["text"] for r in records.read_source(spark, str(t), "txt").orderBy("part").collect()] == ["One. Two.", "Three."]


def pdf(pages, packed=False):
    """A small PDF: a catalog, a tree of pages, one content stream each."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(len(pages))) + b"] /Count %d >>" % len(pages)}
    for i, content in enumerate(pages):
        data = zlib.compress(content)
        objects[3 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (4 + 2 * i)
        objects[4 + 2 * i] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream"
    if packed:
        inner = [(n, o) for n, o in objects.items() if b"stream" not in o]
        head, body, at = [], b"", 0
        for n, o in inner:
            head.append(b"%d %d" % (n, at))
            body += o + b" "
            at = len(body)
            del objects[n]
        first = b" ".join(head) + b" "
        data = zlib.compress(first + body)
        objects[99] = b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode >>\nstream\n" % (len(inner), len(first)) + data + b"\nendstream"
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n" % n + o + b"\nendobj" for n, o in objects.items()) + b"\n%%EOF"


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(spark, tmp_path, packed):
    p = tmp_path / "a.pdf"
    p.write_bytes(pdf([b"BT /F1 12 Tf 72 720 Td (Hello \\(there\\)) Tj 0 -14 Td [(Wor) -20 (ld)] TJ ET", b"BT (Second) Tj ET"], packed))
    rows = records.read_source(spark, str(p), "pdf").orderBy("part").collect()
    assert [(r["text"], r["heading_path"]) for r in rows] == [("Hello (there)", "page 1"), ("World", "page 1"), ("Second", "page 2")]
    scan = tmp_path / "scan.pdf"
    scan.write_bytes(pdf([b"q 10 0 0 10 0 0 cm /Im1 Do Q"], packed))
    with pytest.raises(Exception, match="holds no text"):
        records.read_source(spark, str(scan), "pdf").collect()


def test_rtf_html_json(spark, tmp_path):
    r = tmp_path / "a.rtf"
    r.write_text(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}{\info{\title T}}\f0\b One\b0  line\par Two \{x\}\par}")
    assert [x["text"] for x in records.read_source(spark, str(r), "rtf").orderBy("part").collect()] == ["One line", "Two {x}"]
    h = tmp_path / "a.html"
    h.write_text("<html><head><style>p{}</style><title>T</title></head><body><p>A &amp; <b>B</b></p><script>x()</script><ul><li>C</li></ul></body></html>")
    assert [x["text"] for x in records.read_source(spark, str(h), "html").orderBy("part").collect()] == ["T", "A & B", "C"]
    j = tmp_path / "a.json"
    j.write_text('{"a": 1, "b": {"c": "x"}}\n{"a": 2, "b": {"c": null}}\n')
    assert [x["text"] for x in records.read_source(spark, str(j), "json").orderBy("_row_index").collect()] == ["a: 1; b.c: x", "a: 2"]


def test_package_diff(spark, tmp_path):
    for name, parts in (("a.docx", {"x": "1", "y": "2", "z": "3"}), ("b.docx", {"x": "1", "y": "9", "w": "4"})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in parts.items():
                z.writestr(k, v)
    rows = records.package_diff(spark, str(tmp_path / "a.docx"), str(tmp_path / "b.docx")).collect()
    assert {(r["part"], r["status"]) for r in rows} == {("x", "same"), ("y", "changed"), ("z", "removed"), ("w", "added")}
