"""Tables of PDF and RTF files, as rows of cells.

A PDF page has no tables, only texts at places. Its content is run through the operators that move and show text; fonts give the
characters of their codes (their ToUnicode maps, else Windows Latin) and widths. Texts on one height are a line; in a line, texts whose gap
is about a word's are one cell. Lines of several cells that follow each other are a table, whose columns are the stretches that the cells
of its fullest lines take. RTF says where its rows and cells end.

Null and edge cases: a cell that a line lacks is an empty text; a line of one cell ends a table unless it lies under a later column; a
table has two rows and two columns at least; a file without tables gives no rows; codes that a font does not map are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tabloom.sources.records import _pdf_objects, _pdf_stream

TABLES = "path string, page int, table_no int, row_no int, cells array<string>"
#: Gaps in parts of the letter size: the least between words, and the least between cells.
WORD_GAP, CELL_GAP = 0.15, 1.0

_TOKEN = re.compile(rb"\((?:\\.|[^()\\]|\((?:\\.|[^()\\])*\))*\)|<<|>>|<[0-9A-Fa-f\s]*>|/[^\s/\[\]<>()%]*|[\[\]]|[+-]?(?:\d+\.?\d*|\.\d+)|[A-Za-z'\"*]+[0-9]*\*?|%[^\r\n]*", re.S)


@dataclass
class Font:
    text: dict[int, str]
    widths: dict[int, float]
    size: int  # bytes of a code

    def read(self, raw: bytes) -> tuple[str, float]:
        """Text of a string's codes, and its width at size 1."""
        codes = [int.from_bytes(raw[i : i + self.size], "big") for i in range(0, len(raw) - self.size + 1, self.size)]
        known = self.text or {c: bytes([c]).decode("cp1252", "ignore") for c in set(codes) if c < 256}
        return "".join(known.get(c, "") for c in codes), sum(self.widths.get(c, 500.0) for c in codes) / 1000


def _unicode(hexed: bytes) -> str:
    return bytes.fromhex(hexed.decode()).decode("utf-16-be", "replace")


def _map(cmap: bytes) -> tuple[dict[int, str], int]:
    """Characters of codes, and the bytes of a code, of a ToUnicode stream."""
    found: dict[int, str] = {}
    space = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            found[int(a, 16)] = _unicode(b)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for a, b, single, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            low, high = int(a, 16), int(b, 16)
            if several:
                found |= {low + i: _unicode(x) for i, x in enumerate(re.findall(rb"<([0-9A-Fa-f]+)>", several))}
            else:
                first = _unicode(single)
                found |= {low + i: first[:-1] + chr(ord(first[-1]) + i) for i in range(min(high - low, 65535) + 1)}
    return found, len(space[1]) // 2 if space else 1


def _ref(objects: dict[int, bytes], body: bytes, key: bytes) -> bytes:
    """Value of a key: what it refers to, or what stands there."""
    if m := re.search(rb"/" + key + rb"\s+(\d+)\s+\d+\s+R", body):
        return objects.get(int(m[1]), b"")
    m = re.search(rb"/" + key + rb"\b", body)
    return body[m.end() :] if m else b""


def _fonts(objects: dict[int, bytes], page: bytes) -> dict[bytes, Font]:
    holder, out = page, {}
    while b"/Resources" not in holder and b"/Parent" in holder:
        holder = _ref(objects, holder, b"Parent")
    listed = _ref(objects, _ref(objects, holder, b"Resources"), b"Font")
    for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed.split(b">>")[0]):
        font = objects.get(int(number), b"")
        text, size = _map(_pdf_stream(_ref(objects, font, b"ToUnicode"))) if b"/ToUnicode" in font else ({}, 2 if b"/Type0" in font else 1)
        first = re.search(rb"/FirstChar\s+(\d+)", font)
        listed_widths = re.search(rb"\[([^\]]*)\]", _ref(objects, font, b"Widths"))
        widths = {int(first[1]) + i: float(w) for i, w in enumerate(listed_widths[1].split())} if first and listed_widths else {}
        out[name] = Font(text, widths, size)
    return out


def _bytes(token: bytes) -> bytes:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex(digits.decode() + "0" * (len(digits) % 2))
    named = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}
    return re.sub(rb"\\([0-7]{1,3}|.)", lambda e: bytes([int(e[1], 8) & 255]) if e[1].isdigit() else named.get(e[1], e[1]), token[1:-1], flags=re.S)


def _times(a: tuple, b: tuple) -> tuple:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def text_runs(content: bytes, fonts: dict[bytes, Font]) -> list[tuple[float, float, float, float, str]]:
    """(x, y, end, size, text) of what a page shows."""
    unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
    out, stack, saved, whole, matrix, line = [], [], [], unit, unit, unit
    font, size, leading, spacing = Font({}, {}, 1), 1.0, 0.0, 0.0

    def move(x: float, y: float) -> None:
        nonlocal matrix, line
        line = matrix = _times((1, 0, 0, 1, x, y), line)

    def show(raw: bytes) -> None:
        nonlocal matrix
        text, wide = font.read(raw)
        shift = wide * size + spacing * len(text)
        at, to = _times(matrix, whole), _times(_times((1, 0, 0, 1, shift, 0), matrix), whole)
        if text.strip():
            out.append((at[4], at[5], to[4], abs(size * at[3]) or abs(size), text))
        matrix = _times((1, 0, 0, 1, shift, 0), matrix)

    for token in _TOKEN.findall(content):
        if token[:1] == b"%":
            continue
        if token[:1] in b"(<[]/+-.0123456789" or token == b">>":
            stack.append(token)
            continue
        numbers = [float(x) for x in stack if re.fullmatch(rb"[+-]?(?:\d+\.?\d*|\.\d+)", x)]
        strings = [_bytes(x) for x in stack if x[:1] == b"(" or (x[:1] == b"<" and x != b"<<")]
        if token == b"q":
            saved.append(whole)
        elif token == b"Q" and saved:
            whole = saved.pop()
        elif token == b"cm" and len(numbers) >= 6:
            whole = _times(tuple(numbers[-6:]), whole)
        elif token == b"BT":
            matrix = line = unit
        elif token == b"Tf" and numbers:
            name = next((x[1:] for x in stack if x[:1] == b"/"), b"")
            font, size = fonts.get(name, Font({}, {}, 1)), numbers[-1]
        elif token == b"TL" and numbers:
            leading = numbers[-1]
        elif token == b"Tc" and numbers:
            spacing = numbers[-1]
        elif token in (b"Td", b"TD") and len(numbers) >= 2:
            leading = -numbers[-1] if token == b"TD" else leading
            move(numbers[-2], numbers[-1])
        elif token == b"Tm" and len(numbers) >= 6:
            matrix = line = tuple(numbers[-6:])
        elif token in (b"T*", b"'", b'"'):
            move(0, -leading)
        if token in (b"Tj", b"'", b'"') and strings:
            show(strings[-1])
        elif token == b"TJ":
            for x in stack:
                if x[:1] in b"(<":
                    show(_bytes(x))
                elif x not in (b"[", b"]"):
                    matrix = _times((1, 0, 0, 1, -float(x) / 1000 * size, 0), matrix)
        stack = []
    return out


def lines_of(runs: list[tuple[float, float, float, float, str]]) -> list[list[tuple[float, float, str]]]:
    """Lines from top to bottom, each of its cells (start, end, text) from left to right."""
    lines: list[list[tuple]] = []
    for r in sorted(runs, key=lambda r: -r[1]):
        if lines and abs(lines[-1][0][1] - r[1]) <= 0.4 * max(r[3], 1.0):
            lines[-1].append(r)
        else:
            lines.append([r])
    out = []
    for line in lines:
        cells: list[list] = []
        for x, _, end, size, text in sorted(line):
            gap = x - cells[-1][1] if cells else None
            if gap is None or gap > CELL_GAP * size:
                cells.append([x, end, text])
            else:
                cells[-1][1:] = [max(end, cells[-1][1]), cells[-1][2] + (" " if gap > WORD_GAP * size and not cells[-1][2].endswith(" ") else "") + text]
        out.append([(a, b, " ".join(t.split())) for a, b, t in cells])
    return out


def tables_of(lines: list[list[tuple[float, float, str]]]) -> list[list[list[str]]]:
    """Tables of a page: stretches of lines, their cells put into columns."""
    groups: list[list] = [[]]
    for line in lines:
        inside = groups[-1] and len(line) == 1 and line[0][0] > groups[-1][-1][0][1]
        if len(line) > 1 or inside:
            groups[-1].append(line)
        elif groups[-1]:
            groups.append([])
    out = []
    for group in groups:
        most = max((len(x) for x in group), default=0)
        columns: list[list[float]] = []
        for a, b, _ in sorted(c for line in group if len(line) == most for c in line):
            if columns and a <= columns[-1][1]:
                columns[-1][1] = max(b, columns[-1][1])
            else:
                columns.append([a, b])
        if len(group) < 2 or len(columns) < 2:
            continue
        rows = []
        for line in group:
            row = [""] * len(columns)
            for a, b, text in line:
                far = lambda c: max(0.0, c[0] - b, a - c[1])  # noqa: B023, E731
                k = min(range(len(columns)), key=lambda i: (far(columns[i]), abs(columns[i][0] - a)))  # noqa: B023
                row[k] = f"{row[k]} {text}".strip()
            rows.append(row)
        out.append(rows)
    return out


def pdf_pages(data: bytes) -> Iterator[list[list[tuple[float, float, str]]]]:
    """Lines of each page, in the order of the page tree."""
    objects = _pdf_objects(data)
    root = next((_ref(objects, o, b"Pages") for o in objects.values() if re.search(rb"/Type\s*/Catalog\b", o)), b"")

    def walk(body: bytes, depth: int) -> Iterator[bytes]:
        if kids := re.search(rb"/Kids\s*\[([^\]]*)\]", body):
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]) if depth < 50 else ():
                yield from walk(objects.get(int(k), b""), depth + 1)
        elif re.search(rb"/Type\s*/Page\b", body):
            refs = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
            content = b"\n".join(_pdf_stream(objects.get(int(r), b"")) for r in re.findall(rb"(\d+)\s+\d+\s+R", refs[1])) if refs else b""
            yield lines_of(text_runs(content, _fonts(objects, body)))

    yield from walk(root, 0)


def rtf_tables(data: bytes) -> list[list[list[str]]]:
    """Tables of an RTF text: its rows, parted where a paragraph stands outside."""
    text = data.decode("latin-1")
    plain = lambda t: re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), t)
    bare = lambda t: " ".join(re.sub(r"\\u(-?\d+) ?\??", lambda m: chr(int(m[1]) % 65536), plain(t)).replace("\\line", " ").split())
    clean = lambda t: re.sub(r"\\([\\{}])", r"\1", re.sub(r"\\[a-zA-Z]+-?\d* ?|(?<!\\)[{}]", "", bare(t)))
    tables: list[list[list[str]]] = [[]]
    end = 0
    for m in re.finditer(r"\\trowd\b(.*?)\\row\b", text, re.S):
        if tables[-1] and clean(text[end : m.start()]).strip():
            tables.append([])
        tables[-1].append([clean(c).strip() for c in re.split(r"\\cell\b", m[1])[:-1]])
        end = m.end()
    return [t for t in tables if t]


def _tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for path, data in zip(b["path"], b["content"], strict=True):
            data = bytes(data)
            pages = [rtf_tables(data)] if data[:5] == b"{\\rtf" else map(tables_of, pdf_pages(data))
            n, out = 0, []
            for page, tables in enumerate(pages, 1):
                for rows in tables:
                    out += [(path, page, n, i, cells) for i, cells in enumerate(rows)]
                    n += 1
            yield pd.DataFrame(out, columns=["path", "page", "table_no", "row_no", "cells"])


def document_tables(files: DataFrame) -> DataFrame:
    """path, page, table_no, row_no, cells of the tables in PDF and RTF files (path, content)."""
    return files.select("path", "content").mapInPandas(_tables, TABLES)


def read_document_tables(spark: SparkSession, path: str) -> DataFrame:
    return document_tables(spark.read.format("binaryFile").load(path))


def plain_pdf(pages: list[list[tuple[float, float, str]]], size: float = 10.0) -> bytes:
    """A PDF of texts at places, in a font whose codes are numbered as the texts need them and mapped by ToUnicode."""
    letters = sorted({ch for page in pages for *_, t in page for ch in t})
    code = {ch: i + 1 for i, ch in enumerate(letters)}
    cmap = "begincodespacerange <0000> <FFFF> endcodespacerange\n" + "".join(f"1 beginbfchar <{code[ch]:04X}> <{ch.encode('utf-16-be').hex()}> endbfchar\n" for ch in letters)
    bodies = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{5 + 2 * i} 0 R' for i in range(len(pages)))}] /Resources << /Font << /F1 3 0 R >> >> >>"]
    bodies += ["<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>", f"<< /Length {len(cmap)} >>\nstream\n{cmap}\nendstream"]
    for i, page in enumerate(pages):
        shown = "".join(f"1 0 0 1 {x} {y} Tm <{''.join(f'{code[ch]:04X}' for ch in t)}> Tj\n" for x, y, t in page)
        content = f"BT /F1 {size} Tf\n{shown}ET"
        bodies += [f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * i} 0 R >>", f"<< /Length {len(content)} >>\nstream\n{content}\nendstream"]
    return ("%PDF-1.4\n" + "".join(f"{i} 0 obj\n{b}\nendobj\n" for i, b in enumerate(bodies, 1)) + "trailer << /Root 1 0 R >>\n").encode("latin-1")
