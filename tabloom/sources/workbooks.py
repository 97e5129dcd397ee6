"""Cells of xlsx packages as typed text, and small packages from tables.

A package is a graph: its relationships say which part is the workbook, and those of the workbook which parts are the sheets, the shared
strings and the styles. File names mean nothing. A number is a date if the number format of its cell's style is one. Dates are ISO,
with hours and minutes unless it is midnight; a time of day alone is HH:MM:SS; whole numbers have no point; truth values are True and
False. Tags are compared without their namespace, since packages come in two.

Null and edge cases: an empty cell is an empty text; cells and rows without a reference follow the one before; formulas give their
stored value; phonetic hints are no text; a package without relationships has its sheets in the order of its part names.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

#: Numbers of built-in formats that show a date or a time.
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def children(node, name: str) -> Iterator:
    return (c for c in node if local(c.tag) == name) if node is not None else iter(())


class Package:
    """Parts of a zip by name, and where their relationships lead."""

    def __init__(self, data: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.names = set(self.zip.namelist())

    def xml(self, part: str | None):
        return ElementTree.fromstring(self.zip.read(part)) if part in self.names else None

    def links(self, part: str) -> list[tuple[str, str, str]]:
        """(id, kind, part) of a part's relationships; the package's own for an empty name."""
        folder, name = posixpath.split(part)
        root = self.xml(posixpath.join(folder, "_rels", f"{name}.rels"))
        found = []
        for r in children(root, "Relationship"):
            if r.get("TargetMode") != "External":
                target = posixpath.normpath(posixpath.join("/", folder, r.get("Target", "")))
                found.append((r.get("Id", ""), r.get("Type", "").rpartition("/")[2], target.lstrip("/")))
        return found


def is_date_format(code: str) -> bool:
    """Whether a format code shows a date or a time: it has a letter of one outside quotes, escapes and brackets."""
    bare = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.split(";")[0], flags=re.I)
    return "general" not in bare.lower() and re.search(r"[dmyhs]", bare, re.I) is not None


def date_styles(root) -> tuple[set[int], set[int]]:
    """Numbers of the cell styles whose numbers are dates, and of those that are spans of hours."""
    if root is None:
        return set(), set()
    codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter() if local(f.tag) == "numFmt"}
    formats = [int(x.get("numFmtId", 0)) for part in children(root, "cellXfs") for x in children(part, "xf")]
    dates = {i for i, f in enumerate(formats) if (is_date_format(codes[f]) if f in codes else f in DATE_FORMATS)}
    return dates, {i for i, f in enumerate(formats) if re.search(r"\[(h+|m+|s+)\]", codes.get(f, "[h]" if f == 46 else ""), re.I)}


def date_text(serial: float, from_1904: bool, span: bool = False) -> str:
    """A date of the calendar that counts days. In that of 1900 day 60 never was, so earlier days are one off."""
    since = timedelta(seconds=round(serial * 86400))
    if span:
        return str(since)
    if 0 <= serial < 1:
        return str(datetime.min + since)[11:19]
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31) if serial < 60 else datetime(1899, 12, 30)
    at = start + since
    return at.date().isoformat() if not (at.hour or at.minute or at.second) else at.isoformat(sep=" ", timespec="minutes")


def number_text(raw: str) -> str:
    if not re.search(r"[.eE]", raw):
        return str(int(raw))
    x = float(raw)
    return str(int(x)) if x.is_integer() else str(x)


def column_of(reference: str) -> int:
    at = 0
    for ch in re.match(r"[A-Z]+", reference)[0]:
        at = at * 26 + ord(ch) - 64
    return at


def _texts(node) -> str:
    """Text of a string item: its own and that of its runs."""
    return "".join(t.text or "" for part in [node, *children(node, "r")] for t in children(part, "t"))


def sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows) of each sheet in the workbook's order."""
    p = Package(data)
    book = next((t for _, kind, t in p.links("") if kind == "officeDocument"), "xl/workbook.xml")
    links = p.links(book)
    part = lambda kind: next((t for _, k, t in links if k == kind), posixpath.join(posixpath.dirname(book), f"{kind}.xml"))
    shared = [_texts(si) for si in children(p.xml(part("sharedStrings")), "si")]
    dates, spans = date_styles(p.xml(part("styles")))
    root = p.xml(book)
    from_1904 = any(x.get("date1904", "0") in ("1", "true") for x in children(root, "workbookPr"))
    by_id = {i: t for i, _, t in links}
    plain = sorted((n for n in p.names if re.search(r"worksheets/[^/]+\.xml$", n)), key=lambda n: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", n)])

    def value(c) -> str:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return "".join(_texts(x) for x in children(c, "is"))
        raw = next((v.text or "" for v in children(c, "v")), "")
        if raw == "" or kind in ("str", "e"):
            return raw
        if kind == "s":
            return shared[int(raw)]
        if kind == "b":
            return "True" if raw.strip() in ("1", "true") else "False"
        if kind == "d":
            at = datetime.fromisoformat(raw)
            return at.date().isoformat() if not (at.hour or at.minute or at.second) else at.isoformat(sep=" ", timespec="minutes")
        style = int(c.get("s", 0))
        return date_text(float(raw), from_1904, style in spans) if style in dates else number_text(raw)

    for i, s in enumerate(x for group in children(root, "sheets") for x in children(group, "sheet")):
        link = next((v for k, v in s.attrib.items() if k.startswith("{") and local(k) == "id"), None)
        where = by_id.get(link) or (plain[i] if i < len(plain) else None)
        rows: list[list[str]] = []
        for data_ in children(p.xml(where), "sheetData"):
            for row in children(data_, "row"):
                at = int(row.get("r", len(rows) + 1))
                rows += [[] for _ in range(at - 1 - len(rows))]
                cells: list[str] = []
                for c in children(row, "c"):
                    to = column_of(c.get("r")) if c.get("r") else len(cells) + 1
                    cells += [""] * (to - 1 - len(cells)) + [value(c)]
                rows.append(cells)
        yield s.get("name"), rows


# Writing


def _cell(v, number: dict[str, int]) -> str:
    if v is None:
        return "<c/>"
    if isinstance(v, bool):
        return f'<c t="b"><v>{int(v)}</v></c>'
    if isinstance(v, datetime):
        days = (v - datetime(1899, 12, 30)) / timedelta(days=1)
        return f'<c s="{1 if days == int(days) else 2}"><v>{days!r}</v></c>'
    if isinstance(v, int | float):
        return f"<c><v>{v!r}</v></c>"
    return f'<c t="s"><v>{number.setdefault(str(v), len(number))}</v></c>'


def package(tables: Iterable[tuple[str, Iterable[Iterable]]]) -> bytes:
    """An xlsx package of (sheet name, rows): texts, numbers, truth values and datetimes stay what they are."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    number: dict[str, int] = {}
    parts, listed, links = {}, [], []
    for i, (name, rows) in enumerate(tables, 1):
        body = "".join(f"<row>{''.join(_cell(v, number) for v in row)}</row>" for row in rows)
        parts[f"xl/worksheets/part{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
        listed.append(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>')
        links.append(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/part{i}.xml"/>')
    links += [f'<Relationship Id="s{k}" Type="{rel}/{k}" Target="{k}.xml"/>' for k in ("sharedStrings", "styles")]
    graph = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'
    parts["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{"".join(listed)}</sheets></workbook>'
    parts["xl/_rels/workbook.xml.rels"] = graph.format("".join(links))
    parts["xl/sharedStrings.xml"] = f'<sst xmlns="{main}">{"".join(f"<si><t xml:space={chr(34)}preserve{chr(34)}>{escape(t)}</t></si>" for t in number)}</sst>'
    parts["xl/styles.xml"] = f'<styleSheet xmlns="{main}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/></cellXfs></styleSheet>'
    parts["_rels/.rels"] = graph.format(f'<Relationship Id="b" Type="{rel}/officeDocument" Target="xl/workbook.xml"/>')
    ct = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    kinds = {"xl/workbook.xml": "sheet.main", "xl/sharedStrings.xml": "sharedStrings", "xl/styles.xml": "styles"} | {n: "worksheet" for n in parts if "worksheets/" in n}
    over = "".join(f'<Override PartName="/{n}" ContentType="{ct}.{k}+xml"/>' for n, k in kinds.items())
    parts["[Content_Types].xml"] = f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{over}</Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts, reverse=True):
            z.writestr(name, parts[name])
    return out.getvalue()
