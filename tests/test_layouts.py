"""Tables of PDF and RTF files: cells equal to the planted ones."""

from tabloom.sources import layouts


def test_pdf_tables(spark):
    rows = [["Test", "Limit", "Batch A-1"], ["Assay (HPLC)", "95.0 – 105.0 %", "99.1"], ["Wasser", "", "0,2"], ["", "", "n/a"], ["Größe µm", "NMT 5", ""]]
    at = [40.0, 200.0, 380.0]
    page = [(40.0, 740.0, "A heading of the page")] + [(at[k], 700.0 - 14 * i, c) for i, r in enumerate(rows) for k, c in enumerate(r) if c]
    page += [(40.0, 600.0, "Prose between the tables."), (40, 580, "one"), (120, 580, "two"), (40, 566, "three"), (120, 566, "four")]
    files = spark.createDataFrame([("a.pdf", bytearray(layouts.plain_pdf([page, [(40, 700, "No table here")]])))], "path string, content binary")
    got = layouts.document_tables(files).collect()
    assert [(r["page"], r["table_no"], r["row_no"], r["cells"]) for r in got] == [(1, 0, i, r) for i, r in enumerate(rows)] + [(1, 1, 0, ["one", "two"]), (1, 1, 1, ["three", "four"])]


def test_text_operators():
    font = layouts.Font({1: "A", 2: "ffi", 3: "B"}, {1: 600.0, 2: 1000.0, 3: 600.0}, 1)
    content = rb"q 2 0 0 2 10 0 cm BT /F1 10 Tf 12 TL 5 100 Td (\001\002) Tj T* [(\001) -4000 (\003)] TJ 0 -20 TD (\003) ' ET Q BT /F9 8 Tf 1 0 0 1 3 4 Tm (plain \(x\)) Tj ET"
    runs = layouts.text_runs(content, {b"F1": font})
    assert [(round(x), round(y), round(e), round(s), t) for x, y, e, s, t in runs] == [(20, 200, 52, 20, "Affi"), (20, 176, 32, 20, "A"), (112, 176, 124, 20, "B"), (20, 96, 32, 20, "B"), (3, 4, 39, 8, "plain (x)")]
    assert layouts._map(b"begincodespacerange <00> <ff> endcodespacerange 1 beginbfrange <01> <03> <0041> <05> <06> [<00660069> <0042>] endbfrange") == ({1: "A", 2: "B", 3: "C", 5: "fi", 6: "B"}, 1)


def test_rtf_tables(spark):
    row = lambda *c: r"\trowd\cellx100\cellx200 " + "".join(rf"\pard\intbl {x}\cell" for x in c) + r"\row "
    text = r"{\rtf1\ansi " + row("Name", r"\b Value\b0 ") + row(r"Gr\'f6\'dfe \{x\}", r"\u181 ?m") + r"\pard Between.\par " + row("z", "") + "}"
    files = spark.createDataFrame([("a.rtf", bytearray(text.encode("latin-1"))), ("b.rtf", bytearray(b"{\\rtf1 none}"))], "path string, content binary")
    got = [(r["table_no"], r["cells"]) for r in layouts.document_tables(files).collect()]
    assert got == [(0, ["Name", "Value"]), (0, ["Größe {x}", "µm"]), (1, ["z", ""])]
