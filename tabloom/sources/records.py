"""Record and chunk readers: csv, xlsx, docx, pdf, rtf, text, html, json, XML case reports, term dictionaries.

Files are found and read by Spark (csv, text, binaryFile), so paths may be in any store; office formats are unzipped on the
executors. All cells are text. Header rules: a blank header is column_N, a repeated one gets (2), (3), ...; rows without
any value are dropped; each record keeps _row_index and _sheet."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tabloom.functions.text import clean_cell, record_text
from tabloom.operators.retrieval import SentenceChunks
from tabloom.sources import workbooks

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


class SourceUnreadable(ValueError):
    pass


def header_names(raw: list[str | None]) -> list[str]:
    out: list[str] = []
    for i, h in enumerate(raw, 1):
        name = (h or "").strip() or f"column_{i}"
        n, unique = 2, name
        while unique in out:
            unique = f"{name} ({n})"
            n += 1
        out.append(unique)
    return out


def _records(df: DataFrame, columns: list[str], sheet: str) -> DataFrame:
    """Cleaned cells, blank rows dropped, rows numbered from 1 in file order without gathering them in one task."""
    d = df.select(*[clean_cell(F.col(f"`{a}`")).alias(b) for a, b in zip(df.columns, columns, strict=True)])
    some = F.lit(False)
    for c in columns:
        some = some | (F.col(f"`{c}`") != "")
    d = d.withColumn("_id", F.monotonically_increasing_id()).where(some).withColumn("_part", F.spark_partition_id())
    starts = d.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    numbered = d.join(F.broadcast(starts), "_part").withColumn("_row_index", (F.col("_from") + F.row_number().over(W.partitionBy("_part").orderBy("_id"))).cast("long"))
    return numbered.withColumn("_sheet", F.lit(sheet)).select(*[f"`{c}`" for c in columns], "_row_index", "_sheet")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=False, inferSchema=False, multiLine=True, quote='"', escape='"', mode="PERMISSIVE")
    first = raw.first()
    if first is None:
        raise SourceUnreadable(f"{path} is empty")
    columns = header_names(list(first))
    body = raw.withColumn("_at", F.monotonically_increasing_id()).where(F.col("_at") > 0).drop("_at")
    return _records(body, columns, "csv")


def _sheet_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of all sheets, with a row -1 that names each sheet."""
    for b in batches:
        for data in b["content"]:
            for no, (name, rows) in enumerate(workbooks.sheets(data)):
                yield pd.DataFrame({"sheet": name, "no": no, "at": range(-1, len(rows)), "cells": [[], *rows]})


def _workbook(spark: SparkSession, path: str) -> DataFrame:
    """sheet, no, at, cells of a workbook, unzipped on an executor. By its format a sheet has at most 1,048,576 rows."""
    return sheet_rows(spark.read.format("binaryFile").load(path))


def sheet_rows(packages: DataFrame) -> DataFrame:
    """sheet, no, at (-1: the sheet itself), cells of xlsx packages in a column content."""
    return packages.select("content").mapInPandas(_sheet_rows, "sheet string, no int, at int, cells array<string>")


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    return [r["sheet"] for r in _workbook(spark, path).where("at = -1").orderBy("no").collect()] if path.endswith(".xlsx") else ["csv"]


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Records of one sheet; only its header comes to the driver."""
    w = _workbook(spark, path)
    w = w.where(F.col("sheet") == sheet) if sheet else w.where("no = 0")
    top = {r["at"]: r for r in w.where("at <= 0").collect()}
    if -1 not in top:
        raise SourceUnreadable(f"no sheet {sheet!r}; there are {', '.join(sheet_names(spark, path))}" if sheet else f"{path} is not there")
    if 0 not in top:
        raise SourceUnreadable(f"sheet {top[-1]['sheet']!r} is empty")
    columns = header_names(list(top[0]["cells"]))
    body = w.where("at > 0").select(*[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(f"c{i}") for i in range(len(columns))])
    return _records(body, columns, top[-1]["sheet"])


CHUNKS = "path string, part int, text string, element_type string, heading_path string"


def _docx(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for path, data in zip(b["path"], b["content"], strict=True):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_WORD}body")
            headings: list[str] = []
            for el in body:
                if el.tag == f"{_WORD}tbl":
                    for row in el.iter(f"{_WORD}tr"):
                        cells = ["".join(t.text or "" for t in c.iter(f"{_WORD}t")).strip() for c in row.iter(f"{_WORD}tc")]
                        out.append((path, len(out), " | ".join(cells), "table_row", " > ".join(headings)))
                    continue
                text = "".join(t.text or "" for t in el.iter(f"{_WORD}t")).strip()
                style = next((s.get(f"{_WORD}val", "") for s in el.iter(f"{_WORD}pStyle")), "")
                if not text:
                    continue
                if m := re.match(r"(?i)heading\s?(\d)", style):
                    headings = [*headings[: int(m[1]) - 1], text]
                    out.append((path, len(out), text, "heading", " > ".join(headings)))
                else:
                    out.append((path, len(out), text, "paragraph", " > ".join(headings)))
        yield pd.DataFrame(out, columns=["path", "part", "text", "element_type", "heading_path"])


def chunks_docx(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_docx, CHUNKS)


def _pdf_objects(data: bytes) -> dict[int, bytes]:
    """Objects by number, those of object streams included."""
    found = {int(m[1]): m[2] for m in re.finditer(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", data, re.S)}
    for body in list(found.values()):
        if b"/ObjStm" in body[:400]:
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", body)[1]) for k in (b"N", b"First"))
            inner = _pdf_stream(body)
            head = [int(x) for x in inner[:first].split()][: 2 * n]
            places = [*head[1::2], len(inner) - first]
            for number, a, b in zip(head[0::2], places, places[1:]):
                found.setdefault(number, inner[first + a : first + b])
    return found


def _pdf_stream(body: bytes) -> bytes:
    m = re.search(rb"stream\r?\n(.*?)\r?\n?endstream", body, re.S)
    if not m:
        return b""
    return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in body[: m.start()] else m[1]


def _pdf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from tabloom.sources import layouts

    for b in batches:
        out = []
        for path, data in zip(b["path"], b["content"], strict=True):
            before = len(out)
            for no, lines in enumerate(layouts.pdf_pages(bytes(data)), 1):
                out += [(path, len(out) - before + i, " ".join(text for *_, text in cells), "paragraph", f"page {no}") for i, cells in enumerate(lines)]
            if len(out) == before:
                raise SourceUnreadable(f"{path} holds no text: a scan has to be read by a person or by OCR first")
        yield pd.DataFrame(out, columns=["path", "part", "text", "element_type", "heading_path"])


def chunks_pdf(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the text layer, page by page and from top to bottom, in the characters that the fonts map their codes to; a file
    without text is refused."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_pdf, CHUNKS)


def rtf_text(c: F.Column) -> F.Column:
    """Paragraphs of an RTF text, without its groups of fonts, colours, styles and information, and without control words."""
    # Escaped braces and backslashes stand aside as control characters until the groups are gone.
    kept = F.replace(F.replace(F.replace(c, F.lit("\\\\"), F.lit("\x03")), F.lit("\\{"), F.lit("\x01")), F.lit("\\}"), F.lit("\x02"))
    bare = F.regexp_replace(kept, r"(?s)\{\\(?:\*|fonttbl|colortbl|stylesheet|info|pict)(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\}", "")
    lines = F.regexp_replace(bare, r"\\(?:par|line|page|sect|row)\b ?", "\n")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(lines, r"\\tab\b ?|\\cell\b ?", "\t"), r"\\'[0-9a-fA-F]{2}", "?"), r"\\[a-zA-Z]+-?\d* ?|[{}]", "")
    return F.filter(F.transform(F.split(F.translate(plain, "\x01\x02\x03", "{}\\"), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def chunks_rtf(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return raw.select("path", F.posexplode(rtf_text(F.col("value"))).alias("part", "text")).select("path", "part", "text", F.lit("paragraph").alias("element_type"), F.lit("").alias("heading_path"))


def chunks_records(records: DataFrame) -> DataFrame:
    """`k: v; k: v` per record."""
    columns = [c for c in records.columns if not c.startswith("_")]
    return records.select("_row_index", record_text(columns).alias("text"), F.lit("record").alias("element_type"), F.col("_sheet").alias("heading_path"))


def chunks_text(spark: SparkSession, path: str, most: int = 700) -> DataFrame:
    """Paragraphs parted by blank lines, cut at sentence ends."""
    spark.udtf.register("sentence_chunks", SentenceChunks)
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    raw.createOrReplaceTempView("_tabloom_raw_text")
    return spark.sql(f"SELECT path, c.part, c.text, 'paragraph' AS element_type, '' AS heading_path FROM _tabloom_raw_text, LATERAL sentence_chunks(value, {int(most)}) c")


def read_cases(spark: SparkSession, path: str, row_tag: str = "safetyreport") -> DataFrame:
    """Case reports from XML by Spark's own reader."""
    return spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false").load(path)


def read_dictionary(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Term hierarchy; the columns llt and pt are needed."""
    d = spark.read.csv(path, header=True, inferSchema=False)
    d = d.toDF(*[c.strip().lower() for c in d.columns])
    if not {"llt", "pt"} <= set(d.columns):
        raise SourceUnreadable("a dictionary needs the columns llt and pt")
    level = [c for c in ("llt", "pt", "hlt", "hlgt", "soc") if c in d.columns]
    return d.select(*[F.trim(c).alias(c) for c in level]).where("pt <> ''").withColumn("version", F.lit(version)).dropDuplicates(level)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())


def _json(spark: SparkSession, path: str) -> DataFrame:
    """JSON records, one a line, as text cells named by their path."""
    from tabloom.operators.usage import flatten

    flat = flatten(spark.read.option("primitivesAsString", True).json(path))
    return _records(flat.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in flat.columns]), flat.columns, "json")


def read_source(spark: SparkSession, path: str, fmt: str, sheet: str | None = None) -> DataFrame:
    """Records of csv and xlsx, chunks of the others."""
    readers = {"csv": lambda: read_csv(spark, path), "xlsx": lambda: read_xlsx(spark, path, sheet), "docx": lambda: chunks_docx(spark, path), "pdf": lambda: chunks_pdf(spark, path), "rtf": lambda: chunks_rtf(spark, path), "txt": lambda: chunks_text(spark, path), "html": lambda: chunks_html(_whole(spark, path), "path", "value"), "json": lambda: chunks_records(_json(spark, path)), "xml": lambda: read_cases(spark, path)}
    if fmt.lower() not in readers:
        raise SourceUnreadable(f"{fmt!r} cannot be read; use one of {', '.join(readers)}")
    return readers[fmt.lower()]()


# Tables inside documents


def clean_table(rows: F.Column) -> F.Column:
    """Cells trimmed, rows without any value dropped."""
    return F.filter(F.transform(rows, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))


def table_identity(caption: F.Column) -> F.Column:
    """struct<table_id, title> of a caption such as `Table 14.1.2: Demographics`."""
    shape = r"(?i)^\s*table\s+([0-9A-Z]+(?:[.\-][0-9A-Z]+)*)\s*[:.\-–]?\s*(.*)$"
    ident = F.regexp_extract(caption, shape, 1)
    return F.struct(F.when(ident != "", ident).alias("table_id"), F.trim(F.when(ident != "", F.regexp_extract(caption, shape, 2)).otherwise(caption)).alias("title"))


#: Roles of laboratory table headers, the first that fits.
HEADER_ROLES = (
    ("test", r"(?i)\b(test|parameter|attribute|analysis)\b"), ("criterion", r"(?i)\b(criteri|limit|specification|acceptance)"), ("method", r"(?i)\b(method|procedure)\b"),
    ("unit", r"(?i)^\s*units?\s*$"), ("batch", r"(?i)\b(batch|lot)\b"), ("timepoint", r"(?i)\b(month|week|year|initial|time ?point)s?\b"), ("result", r"(?i)\b(result|value|found)\b"),
)


def header_role(c: F.Column) -> F.Column:
    out = F.lit(None).cast("string")
    for role, shape in reversed(HEADER_ROLES):
        out = F.when(c.rlike(shape), role).otherwise(out)
    return out


def batch_of(header: F.Column) -> F.Column:
    """Batch number of a header; none in a condition or a time point."""
    n = F.regexp_extract(header, r"(?i)\b(?:batch|lot)\s*(?:no\.?|number|#)?\s*[:#]?\s*([A-Z0-9][A-Z0-9\-/]{2,})", 1)
    return F.when((n != "") & ~header.rlike(r"(?i)°\s*c|\d\s*c\s*/|% ?rh|\bmonths?\b"), n)


# Sinks


def write_records(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "append") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those with the same keys (parquet has no MERGE)."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def permitted_values(branches: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """Values that the branches of a field allow: the drop-downs of a data-entry sheet."""
    return branches.groupBy(field).agg(F.array_sort(F.collect_set(value)).alias("permitted"))


# Pages


def html_blocks(html: F.Column) -> F.Column:
    """Texts of a page's blocks in order: scripts, styles and comments gone, block tags as breaks, other tags as nothing."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</(script|style|noscript)\s*>|<!--.*?-->", " ")
    lines = F.regexp_replace(bare, r"(?i)</?(p|div|br|li|ul|ol|tr|td|th|table|h[1-6]|section|article|header|footer|nav|title|body|head|html)\b[^>]*>", "\n")
    plain = F.regexp_replace(lines, r"<[^>]*>", "")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(sign))
    return F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r]+", " "))), lambda x: x != "")


def chunks_html(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """id, part, text of the blocks of each page."""
    return pages.select(F.col(ident).alias("id"), F.posexplode(html_blocks(F.col(html))).alias("part", "text")).withColumn("element_type", F.lit("paragraph"))


def chunks_json(lines: DataFrame, ident: str, json: str, schema: str) -> DataFrame:
    """One chunk per JSON record, `path: value` of its leaves in the order of the schema."""
    from tabloom.operators.usage import flatten

    flat = flatten(lines.select(F.col(ident).alias("_id"), F.from_json(F.col(json), schema).alias("r")).select("_id", "r.*"))
    return flat.select(F.col("_id").alias("id"), record_text([c for c in flat.columns if c != "_id"]).alias("text"), F.lit("record").alias("element_type"))


def header_row(rows: F.Column, least: int = 2) -> F.Column:
    """Place (from 0) of the first row of a table with so many headers of a known role; null where there is none."""
    known = F.transform(rows, lambda r: F.size(F.filter(r, lambda c: header_role(c).isNotNull())))
    at = F.array_position(F.transform(known, lambda n: n >= least), True)
    return F.when(at > 0, at - 1)


def package_parts(spark: SparkSession, path: str) -> DataFrame:
    """part, sha256, size of each file inside office packages: what two versions of one are compared by."""

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for where, data in zip(b["path"], b["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    out += [(where, n, hashlib.sha256(z.read(n)).hexdigest(), z.getinfo(n).file_size) for n in z.namelist()]
            yield pd.DataFrame(out, columns=["path", "part", "sha256", "size"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parts, "path string, part string, sha256 string, size long")


def package_diff(spark: SparkSession, before: str, after: str) -> DataFrame:
    """part, status (added, removed, changed, same) of two versions of a package."""
    from tabloom.operators.usage import row_diff

    return row_diff(package_parts(spark, before), package_parts(spark, after), "part", ["sha256"])


def laboratory_table(rows: DataFrame, headers: str, cells: str) -> DataFrame:
    """Rows (headers array, cells array<string>) of a laboratory table as role -> cell, the first column of each role. Cells
    under headers without a role are left out."""
    roles = F.transform(F.col(headers), header_role)
    pairs = F.filter(F.arrays_zip(roles.alias("role"), F.col(cells).alias("cell")), lambda x: x["role"].isNotNull())
    first = F.filter(F.array_distinct(roles), lambda r: r.isNotNull())
    return rows.withColumn("by_role", F.map_from_arrays(first, F.transform(first, lambda r: F.get(F.filter(pairs, lambda x: x["role"] == r), F.lit(0))["cell"])))
