"""Reading heterogeneous files as rows, distributed over the files.

Files are listed with Spark's ``binaryFile`` source; contents are read only for the formats a
reader needs. Delimited, JSON and XML files use Spark's own readers where one schema is wanted
(``read_csv``, ``read_json``, ``read_xml``); ``file_rows`` reads files of all formats at once into
(path, ordinal, schema, fields, kinds) with fields as a map of text in the order of the file and
kinds as what each value is, for matching against a catalog and typed loads.
"""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions import files

ROWS = "path string, ordinal bigint, schema bigint, fields map<string,string>, kinds array<string>, error string"
#: Files above this size are no single task's: delimited ones are read by Spark's own reader, in splits.
LARGE_FILE = 256 << 20
INTEGER, DECIMAL = re.compile(r"[+-]?\d+\Z"), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\Z")


def list_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, length, modification_time, content, extension, is_media): files, folders recursively. Unused columns are not read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return df.withColumnRenamed("modificationTime", "modification_time").withColumn("extension", files.extension("path")).withColumn("is_media", files.is_media("path"))


def read_csv(spark: SparkSession, path: str, infer: bool = False) -> DataFrame:
    """Delimited files with a header; texts stay texts unless ``infer``."""
    return spark.read.csv(path, header=True, inferSchema=infer, multiLine=True, escape='"')


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON files: a list gives its objects, an object one row, a scalar none."""
    df = spark.read.option("multiLine", True).json(path)
    return df.where("false") if df.columns == ["_corrupt_record"] else df.drop("_corrupt_record")


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """XML records of one tag; attributes lose their prefix, values stay texts."""
    df = spark.read.format("xml").option("rowTag", row_tag).option("inferSchema", "false").option("attributePrefix", "_").load(path)
    return df.select(*[F.col(f"`{c}`").alias(c[1:] if c.startswith("_") else c) for c in df.columns])


def sniff_delimiter(text: Column | str) -> Column:
    """',' or tab when the header has several filled fields and the next ten lines as many, else null."""
    t = F.col(text) if isinstance(text, str) else text
    lines = F.split(F.regexp_replace(t, "\r\n?", "\n"), "\n", -1)
    filled = lambda s, d: F.size(F.filter(F.split(s, d, -1), lambda x: F.trim(x) != ""))
    body = F.slice(lines, 2, 10)
    ok = lambda d: (F.size(lines) > 1) & (filled(lines[0], d) > 1) & F.forall(F.filter(body, lambda s: F.trim(s) != ""), lambda s: filled(s, d) == filled(lines[0], d))
    return F.when(ok(","), ",").when(ok("\t"), "\t")


def decode_text(raw: bytes) -> str:
    """UTF-8, else Latin-1 (which takes every byte)."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def ini_pairs(text: str) -> dict[str, str]:
    pairs = (line.split("=", 1) for line in text.splitlines() if "=" in line and not line.lstrip().startswith("#"))
    return {k.strip(): v.strip() for k, v in pairs}


def docx_text(raw: bytes) -> str:
    """Paragraphs of a DOCX file joined by line ends."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(space + "t")) for p in root.iter(space + "p"))


def pdf_text(raw: bytes) -> str:
    """Page texts of a PDF; '' where no parser is installed."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return ""
    return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(raw)).pages)


@F.pandas_udf(T.StringType())
def full_text(content: pd.Series, extension: pd.Series) -> pd.Series:
    """The text of a file: text families as they are, documents by their parser, '' for what can't be read."""

    def one(raw: bytes | None, ext: str) -> str:
        if raw is None:
            return ""
        try:
            return docx_text(raw) if ext == "docx" else pdf_text(raw) if ext == "pdf" else decode_text(bytes(raw)).replace("\x00", "")
        except Exception:  # broken containers
            return ""

    return pd.Series([one(c, e) for c, e in zip(content, extension)])


class _Table(HTMLParser):
    """The cells of the first table."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[tuple[str, str]]] = []
        self.depth, self.done, self.cell = 0, False, None

    def handle_starttag(self, tag, attrs):
        if self.done:
            return
        if tag == "table":
            self.depth += 1
        elif self.depth and tag == "tr":
            self.rows.append([])
        elif self.depth and tag in ("td", "th"):
            self._close()
            self.cell = [tag, ""]

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._close()
        elif tag == "table" and self.depth:
            self._close()
            self.depth -= 1
            self.done = self.depth == 0

    def handle_data(self, data):
        if self.cell is not None:
            self.cell[1] += data

    def _close(self):
        if self.cell is not None and self.rows:
            self.rows[-1].append((self.cell[0], self.cell[1].strip()))
        self.cell = None


def html_rows(text: str) -> list[dict]:
    p = _Table()
    p.feed(text)
    heads = [t for row in p.rows for kind, t in row if kind == "th"] or [t for _, t in (p.rows[0] if p.rows else [])]
    return [dict(zip(heads, (t for _, t in row))) for row in p.rows[1:] if heads and len(row) == len(heads)]


def xml_rows(text: str) -> list[dict]:
    root = ET.fromstring(text)

    def one(e: ET.Element) -> dict:
        row = dict(e.attrib)
        if e.text and e.text.strip():
            row["text"] = e.text.strip()
        for c in e:
            row[c.tag] = c.text.strip() if c.text else ""
        return row

    return [one(c) for c in root] or [one(root)]


def nested_rows(value: object) -> list[dict]:
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else [value] if isinstance(value, dict) else []


def text_rows(text: str) -> list[dict]:
    lines = text.splitlines()
    for d in (",", "\t"):
        filled = lambda s: sum(bool(x.strip()) for x in s.split(d))  # noqa: B023, E731
        if len(lines) > 1 and filled(lines[0]) > 1 and all(filled(s) == filled(lines[0]) for s in lines[1:11] if s.strip()):
            return list(csv.DictReader(io.StringIO(text), delimiter=d))
    return []


def column_kind(values: list[str | None]) -> str:
    """What a column of texts holds: integer (no blanks), double, boolean or string."""
    filled = [v for v in values if v]
    if filled and all(map(INTEGER.match, filled)):
        return "integer" if len(filled) == len(values) else "double"
    if filled and all(map(DECIMAL.match, filled)):
        return "double"
    return "boolean" if filled and all(v in ("True", "False", "TRUE", "FALSE", "true", "false") for v in filled) else "string"


class Typed(str):
    """A text that stands for a value of another kind."""

    kind: str


def typed_columns(rows: list[dict]) -> list[dict]:
    """Rows of texts with each column's values marked by its kind; blanks become null."""
    kinds = {k: column_kind([r.get(k) for r in rows]) for k in (rows[0] if rows else {})}

    def one(k: str, v: str | None) -> str | None:
        if not v or kinds.get(k, "string") == "string":
            return v or None
        out = Typed(v)
        out.kind = kinds[k]
        return out

    return [{k: one(k, v) for k, v in r.items()} for r in rows]


def excel_rows(raw: bytes) -> list[dict]:
    df = pd.read_excel(io.BytesIO(raw), dtype=str)  # needs an optional engine
    return df.where(df.notna(), None).to_dict("records")


def parse_rows(raw: bytes, ext: str) -> list[dict]:
    """Rows of one file by extension; PDF and DOCX have none, unknown types are tried as delimited text."""
    if ext in ("pdf", "docx"):
        return []
    if ext in ("xlsx", "xls"):
        return excel_rows(raw)
    text = decode_text(raw)
    if ext == "csv":
        return typed_columns([{k: v for k, v in r.items() if k is not None} for r in csv.DictReader(io.StringIO(text.lstrip("﻿")))])
    if ext == "json":
        return nested_rows(json.loads(text))
    if ext in ("yaml", "yml"):
        import yaml

        return nested_rows(yaml.safe_load(text))
    if ext == "xml":
        return xml_rows(text)
    if ext in ("html", "htm"):
        return html_rows(text)
    if ext in ("ini", "cfg", "conf"):
        return [p] if (p := ini_pairs(text)) else []
    return text_rows(text)


def _as_text(v: object) -> str | None:
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)


def kind_of(v: object) -> str | None:
    """integer, double, boolean, string or json of a parsed value; null for none."""
    if v is None:
        return None
    if isinstance(v, Typed):
        return v.kind
    return "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "double" if isinstance(v, float) else "string" if isinstance(v, str) else "json"


def schema_id(names: list[str]) -> int:
    """A number for a list of names in order."""
    import xxhash

    return xxhash.xxh3_64_intdigest("\x00".join(names)) - (1 << 63)


def file_rows(listed: DataFrame) -> DataFrame:
    """(path, ordinal, schema, fields, kinds, error): the rows of all files; ``schema`` numbers the names of a file's first row.

    A file that can't be read is one row with its error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, raw, ext in zip(pdf["path"], pdf["content"], pdf["extension"]):
                out = []
                try:
                    rows = parse_rows(bytes(raw), ext)
                    number = schema_id([str(k) for k in rows[0] if k is not None]) if rows else None
                    for i, row in enumerate(rows):
                        named = {str(k): v for k, v in row.items() if k is not None}
                        out.append((path, i, number, {k: _as_text(v) for k, v in named.items()}, [kind_of(v) for v in named.values()], None))
                except Exception as e:  # noqa: BLE001
                    out = [(path, None, None, None, None, f"{type(e).__name__}: {e}"[:500])]
                for i in range(0, len(out), 10_000):
                    yield pd.DataFrame(out[i : i + 10_000], columns=["path", "ordinal", "schema", "fields", "kinds", "error"]).astype({"ordinal": "Int64", "schema": "Int64"})

    return listed.where(~F.col("is_media") & (F.col("length") <= LARGE_FILE)).select("path", "content", "extension").mapInPandas(run, ROWS)


def large_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows of one large delimited file as ``file_rows`` gives them, read in splits; records hold no line breaks."""
    df = spark.read.csv(path, header=True, inferSchema=True, escape='"')
    kinds = {"int": "integer", "bigint": "integer", "double": "double", "boolean": "boolean"}
    of = [kinds.get(f.dataType.simpleString(), "double" if f.dataType.simpleString().startswith("decimal") else "string") for f in df.schema.fields]
    texts = spark.read.csv(path, header=True, escape='"')
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in texts.columns]
    fields = F.map_from_arrays(F.array(*[F.lit(c) for c in texts.columns]), F.array(*columns))
    found = F.array(*[F.when(c.isNotNull(), F.lit(k)) for c, k in zip(columns, of)])
    return texts.select(F.lit(path).alias("path"), F.monotonically_increasing_id().alias("ordinal"), F.lit(schema_id(texts.columns)).alias("schema"), fields.alias("fields"), found.alias("kinds"), F.lit(None).cast("string").alias("error"))


@F.pandas_udf(T.ArrayType(T.StringType()))
def header_names(content: pd.Series, extension: pd.Series) -> pd.Series:
    """The column names of delimited and spreadsheet files, null for others and for what can't be read."""

    def one(raw: bytes | None, ext: str) -> list[str] | None:
        try:
            if ext == "csv" and raw is not None:
                return next(csv.reader(io.StringIO(decode_text(bytes(raw)).lstrip("﻿"))), [])
            if ext in ("xlsx", "xls") and raw is not None:
                return [str(c) for c in pd.read_excel(io.BytesIO(bytes(raw)), nrows=0).columns]
        except Exception:  # broken containers, no parser
            pass
        return None

    return pd.Series([one(c, e) for c, e in zip(content, extension)], dtype=object)


@F.pandas_udf(T.StringType())
def size_caption(content: pd.Series, kind: pd.Series, name: pd.Series) -> pd.Series:
    """The size of an image that can be decoded, else kind and name of a media file."""

    def one(raw, k, n):
        if k == "image":
            try:
                from PIL import Image

                w, h = Image.open(io.BytesIO(raw)).convert("RGB").size
                return f"An image with dimensions {w}x{h} pixels"
            except Exception:  # no decoder, or no image
                pass
        return f"{k.capitalize()} file {n}"

    return pd.Series([one(c, k, n) for c, k, n in zip(content, kind, name)])


def media_captions(listed: DataFrame) -> DataFrame:
    """(path, modality, caption): size captions of images that can be decoded, names for other media."""
    rows = listed.where("is_media").withColumn("modality", files.media_type("path"))
    return rows.select("path", "modality", size_caption("content", "modality", files.file_name("path")).alias("caption"))
