"""Documents from files: one row per file, errors as a column instead of an exception.

``read_documents`` lists the files with Spark's binary source and parses each where it is read.  Text,
Markdown and HTML are decoded in Python and reduced by JVM expressions; office formats are zip archives
of XML, read with the standard library.  A format that needs a library which is not installed gives an
error row that names it.
"""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import media_type, strip_html, strip_markdown

_OUT = "path string, size long, modified timestamp, media_type string, text string, error string"


def decode(data: bytes) -> str:
    """UTF-8, else Latin-1."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def csv_text(data: bytes, most_rows: int | None = None) -> str:
    """``header: value | ...`` per row, of all rows or the first ``most_rows``; blank cells and rows shorter than the header are left out."""
    rows = csv.reader(io.StringIO(decode(data)))
    header = next(rows, [])
    lines = []
    for row in rows:
        if len(lines) == most_rows:
            break
        if len(row) >= len(header):
            lines.append(" | ".join(f"{h}: {v}" for h, v in zip(header, row, strict=False) if v.strip()))
    return "\n".join(lines)


def json_text(data: bytes, most_items: int | None = None) -> str:
    """Indented rendering; items of lists are numbered, and cut at ``most_items`` if that is given."""

    def lines(value: Any, depth: int) -> Iterator[str]:
        pad = "  " * depth
        if isinstance(value, dict):
            for k, v in value.items():
                if isinstance(v, (dict, list)):
                    yield f"{pad}{k}:"
                    yield from lines(v, depth + 1)
                else:
                    yield f"{pad}{k}: {v}"
        elif isinstance(value, list):
            for i, v in enumerate(value[:most_items], 1):
                yield f"{pad}Item {i}:"
                yield from lines(v, depth + 1)
        else:
            yield f"{pad}{value}"

    return "\n".join(lines(json.loads(decode(data)), 0))


def xml_text(data: bytes) -> str:
    """``tag: text`` of each element with text; what does not parse is returned as it is."""
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        return decode(data)
    return "\n".join(f"{e.tag.rsplit('}', 1)[-1]}: {e.text.strip()}" for e in root.iter() if e.text and e.text.strip())


def docx_text(data: bytes) -> str:
    """Paragraphs that are not blank, blank lines between."""
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    return "\n\n".join(p for p in paragraphs if p.strip())


def xlsx_text(data: bytes, most_rows: int | None = None) -> str:
    """Every sheet's rows, or its first ``most_rows``, cells that are filled joined by `` | ``."""
    m = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    book = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{m}t")) for s in ET.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{m}si")]
    out = []
    for name in sorted(n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        for row in list(ET.fromstring(book.read(name)).iter(f"{m}row"))[:most_rows]:
            cells = []
            for c in row.iter(f"{m}c"):
                v = c.find(f"{m}v")
                text = "".join(t.text or "" for t in c.iter(f"{m}t")) if c.get("t") == "inlineStr" else None if v is None else shared[int(v.text)] if c.get("t") == "s" else v.text
                if text:
                    cells.append(text)
            out.append(" | ".join(cells))
    return "\n".join(out)


def pdf_text(data: bytes) -> str:
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("PDF needs the pypdf library") from e
    return "\n\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)


def _no_doc(data: bytes) -> str:
    raise ValueError("the old .doc format is not supported")


#: Media type -> parser.  HTML and Markdown are only decoded here; see ``read_documents``.
PARSERS: dict[str, Callable[[bytes], str]] = {
    "text/plain": decode,
    "text/html": decode,
    "text/markdown": decode,
    "text/csv": csv_text,
    "application/json": json_text,
    "application/xml": xml_text,
    "application/pdf": pdf_text,
    "application/msword": _no_doc,
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": docx_text,
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": xlsx_text,
}


def parse(kind: str, data: bytes, most_rows: int | None = None, most_items: int | None = None) -> tuple[str | None, str | None]:
    """(text, error).  Rows of tables and items of lists are all kept unless a limit is given."""
    parser = PARSERS.get(kind)
    if parser is None:
        return None, f"unsupported file type: {kind}"
    try:
        if parser in (csv_text, xlsx_text):
            return parser(data, most_rows), None
        return (json_text(data, most_items) if parser is json_text else parser(data)), None
    except Exception as e:  # a broken file is a row with an error, whatever broke
        return None, f"{type(e).__name__}: {e}"


def read_documents(spark: SparkSession, path: str, pattern: str | None = None, most_rows: int | None = None, most_items: int | None = None) -> DataFrame:
    """path, size, modified, media_type, text, error of every file below ``path``."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), media_type(F.col("path")).alias("media_type"), "content")
    return parsed(files, most_rows, most_items)


def parsed(files: DataFrame, most_rows: int | None = None, most_items: int | None = None) -> DataFrame:
    """``files`` (path, size, modified, media_type, content) with text and error in place of the content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [parse(k, bytes(c), most_rows, most_items) for k, c in zip(pdf["media_type"], pdf["content"], strict=True)]
            yield pdf.drop(columns="content").assign(text=[f[0] for f in found], error=[f[1] for f in found])

    texts = files.select("path", "size", "modified", "media_type", "content").mapInPandas(run, _OUT)
    text = F.when(F.col("media_type") == "text/html", strip_html(F.col("text"))).when(F.col("media_type") == "text/markdown", strip_markdown(F.col("text"))).otherwise(F.col("text"))
    return texts.withColumn("text", text)


def read_sql(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a query in another database, read in parallel if ``partitionColumn`` and bounds are given."""
    reader = spark.read.format("jdbc").option("url", url)
    if "partitionColumn" in options:
        reader = reader.option("dbtable", f"({query}) q")
    else:
        reader = reader.option("query", query)
    return reader.options(**options).load()


def latest_upload(uploads: DataFrame) -> DataFrame:
    """(source_id, file_id): the newest finished file of each source."""
    return uploads.where("status = 'completed'").groupBy("source_id").agg(F.max_by("file_id", F.struct("uploaded_at", "file_id")).alias("file_id"))


def merged_config(explicit: DataFrame, defaults: DataFrame) -> DataFrame:
    """(source_id, config): explicit settings over the source's defaults."""
    from ..functions.properties import merge_over

    return defaults.select("source_id", F.col("config").alias("d")).join(explicit.select("source_id", F.col("config").alias("x")), "source_id", "left").select("source_id", merge_over(F.col("d"), F.col("x")).alias("config"))
