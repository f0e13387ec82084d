"""Files of a folder as rows: scan, text, routing, extraction; reads go through Spark, so any store it reaches will do."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V

# --- fixed values: what is ingested, by extension -----------------------------------------------------------------------
TEXT = "md txt java xml yml yaml json properties sql vue js ts html css py sh".split()
DOCUMENT = "pdf xlsx xls docx doc pptx".split()
IMAGE = "png jpg jpeg gif svg webp".split()


def scan(spark: SparkSession, folder: str, extensions: list[str] | None = None) -> DataFrame:
    """path (relative), extension, size, modified, content (binary) of the files to ingest; build, hidden and system files are left out before their contents are read."""
    allowed = extensions or TEXT + DOCUMENT + IMAGE
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = re.sub(r"^\w+:/*", "/", folder).rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:/*", "/"), "^" + re.escape(root), "")
    name = F.substring_index("path", "/", -1)
    skip = "(^|/)(" + "|".join(map(re.escape, V.SKIP_DIRS)) + ")/"
    rows = files.select(path.alias("path"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", name.alias("_name"))
    return rows.where(F.col("extension").isin(allowed) & ~F.col("path").rlike(skip) & ~F.col("_name").rlike(r"^(\.|\._|Thumbs\.db$|desktop\.ini$)")).drop("_name")


def text_of(content: Column, most: int = V.INGEST_CHARS) -> Column:
    return F.substring(F.decode(content, "UTF-8"), 1, most)


def route(extension: Column) -> Column:
    """How a file is read: text, an extractor of its own, recognition of an image, or not at all."""
    return F.when(extension.isin(TEXT), "TEXT").when(extension.isin(DOCUMENT), "NATIVE").when(extension.isin(IMAGE), "IMAGE").otherwise("NONE")


def placeholder(path: Column) -> Column:
    return F.concat(F.lit("[Image file: "), path, F.lit("]"))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(node: ET.Element) -> str:
    return "".join(x.text or "" for x in node.iter() if _local(x.tag) == "t")


def docx_text(data: bytes) -> str | None:
    """Paragraphs in order; tables under a heading of their own, a row to a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(x for x in ET.fromstring(z.read("word/document.xml")) if _local(x.tag) == "body")
    out, tables = [], 0
    for part in body:
        if _local(part.tag) == "p":
            if line := _texts(part).strip():
                out.append(line)
        elif _local(part.tag) == "tbl":
            tables += 1
            out.append(f"=== Table: {tables} ===")
            for row in (x for x in part if _local(x.tag) == "tr"):
                if any(line := [_texts(c).strip() for c in row if _local(c.tag) == "tc"]):
                    out.append(" | ".join(line))
    return "\n".join(out) or None


def pptx_text(data: bytes) -> str | None:
    """Slides in order under headings, a line to a paragraph; empty slides are left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))]
        for number, name in sorted(names):
            lines = [t for p in ET.fromstring(z.read(name)).iter() if _local(p.tag) == "p" and (t := _texts(p).strip())]
            if lines:
                out.append("\n".join([f"=== Slide: {number} ===", *lines]))
    return "\n\n".join(out) or None


def xlsx_text(data: bytes) -> str | None:
    """Sheets in order under headings, cells joined by commas; blank rows are left out."""
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = [_texts(x) for x in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        sheets = [x.attrib["name"] for x in ET.fromstring(z.read("xl/workbook.xml")).iter() if _local(x.tag) == "sheet"]
        for number, sheet in enumerate(sheets, 1):
            if f"xl/worksheets/sheet{number}.xml" not in z.namelist():
                continue
            lines = []
            for row in (x for x in ET.fromstring(z.read(f"xl/worksheets/sheet{number}.xml")).iter() if _local(x.tag) == "row"):
                cells = []
                for c in row:
                    v = next((x.text or "" for x in c if _local(x.tag) == "v"), "")
                    cells.append(shared[int(v)] if c.attrib.get("t") == "s" and v else _texts(c) if c.attrib.get("t") == "inlineStr" else v)
                if any(x.strip() for x in cells):
                    lines.append(",".join(cells))
            if lines:
                out.append("\n".join([f"=== Sheet: {sheet} ===", *lines]))
    return "\n\n".join(out) or None


def pages_text(pages: list[str]) -> str | None:
    """Pages under headings; blank ones are left out."""
    kept = [f"=== Page: {n} ===\n{p.strip()}" for n, p in enumerate(pages, 1) if p and p.strip()]
    return "\n\n".join(kept) or None


EXTRACTORS: dict[str, Callable[[bytes], str | None]] = {"docx": docx_text, "pptx": pptx_text, "xlsx": xlsx_text}


def register_extractor(extension: str, extract: Callable[[bytes], str | None]) -> None:
    """Adds an extractor, for formats (pdf, doc, xls, images) that need a library."""
    EXTRACTORS[extension.lower()] = extract


def extract(files: DataFrame) -> DataFrame:
    """path, extension, text, mode of scanned files; text is null where no extractor is registered or a file can't be read (mode FAILED)."""
    known = dict(EXTRACTORS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, ext, data in zip(frame["path"], frame["extension"], frame["content"], strict=True):
                try:
                    out.append((path, ext, known[ext](data), "NATIVE") if ext in known else (path, ext, None, "UNSUPPORTED"))
                except (KeyError, ValueError, StopIteration, zipfile.BadZipFile, ET.ParseError):
                    out.append((path, ext, None, "FAILED"))
            yield pd.DataFrame(out, columns=["path", "extension", "text", "mode"])

    routed = files.withColumn("_route", route(F.col("extension")))
    plain = routed.where("_route = 'TEXT'").select("path", "extension", text_of(F.col("content")).alias("text"), F.lit("TEXT").alias("mode"))
    image = routed.where("_route = 'IMAGE'").select("path", "extension", placeholder(F.col("path")).alias("text"), F.lit("IMAGE").alias("mode"))
    native = routed.where("_route = 'NATIVE'").select("path", "extension", "content").mapInPandas(run, "path string, extension string, text string, mode string")
    return plain.unionByName(image).unionByName(native.withColumn("text", F.substring("text", 1, V.INGEST_CHARS)))
