"""Files of a folder tree as rows: listing without reading, exclusion rules, and text of common formats."""

from __future__ import annotations

import email
import email.policy
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normal_path

# Formats that can be read, with their kind and media type.
FORMATS = {
    "txt": ("text", "text/plain"),
    "md": ("markdown", "text/markdown"),
    "csv": ("file", "text/csv"),
    "html": ("html", "text/html"),
    "htm": ("html", "text/html"),
    "eml": ("email", "message/rfc822"),
    "docx": ("document", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    "pptx": ("presentation", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    "xlsx": ("spreadsheet", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    "pdf": ("pdf", "application/pdf"),
}
EXCLUDED_NAMES = (r"\..*", r"~\$.*", r"thumbs\.db", r"desktop\.ini")


def glob_pattern(glob: str) -> str:
    """A file-name pattern (*, ?) as a regular expression for whole paths or names."""
    body = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in glob.lower())
    return f"^{body}$"


def listed(spark: SparkSession, folder: str, excluded_directories: tuple[str, ...] = (), excluded_globs: tuple[str, ...] = (), includes: tuple[str, ...] = (), area: str | None = None) -> DataFrame:
    """(path, norm_path, area, name, ext, size, modified) of the files below `folder`; contents are not read.

    Hidden and temporary names, directories on the list and paths that fit an excluded pattern are left out.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    root = F.regexp_replace(F.lit(folder.rstrip("/")), "^file:/*", "/")
    local = F.regexp_replace("path", "^[a-z]+:/*", "/")
    rows = raw.withColumn("relative", F.substring(local, F.length(root) + 2, F.length(local)))
    rows = rows.withColumn("norm_path", normal_path(F.col("relative")))
    rows = rows.withColumns({"name": F.regexp_extract("norm_path", "([^/]*)$", 1), "area": F.when(F.contains("norm_path", F.lit("/")), F.split("norm_path", "/")[0])})
    out = ~F.col("name").rlike("^(" + "|".join(EXCLUDED_NAMES) + ")$") & ~F.col("norm_path").rlike("(^|/)\\.[^/]*/")
    for d in excluded_directories:
        out = out & ~F.concat(F.lit("/"), F.col("norm_path")).contains(f"/{d.lower().strip('/')}/")
    for g in excluded_globs:
        out = out & ~F.col("name").rlike(glob_pattern(g)) & ~F.col("norm_path").rlike(glob_pattern(g))
    if includes:
        wanted = F.lit(False)
        for g in includes:
            wanted = wanted | F.col("norm_path").rlike(glob_pattern(g))
        out = out & wanted
    if area:
        out = out & (F.col("area") == area.lower())
    ext = F.nullif(F.regexp_extract("name", "\\.([^.]+)$", 1), F.lit(""))
    return rows.where(out).select("path", "relative", "norm_path", "area", "name", ext.alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def document_type(ext: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for k, v in FORMATS.items() for x in (k, v[0])))[F.lower(ext)], F.lit("file"))


def mime_type(ext: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for k, v in FORMATS.items() for x in (k, v[1])))[F.lower(ext)], F.lit("application/octet-stream"))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def html_to_text(html: str | None) -> str | None:
    """Text pieces of a page, a line each, scripts and styles left out."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    return "\n".join(parser.parts)


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    return html.map(html_to_text)


def plain(data: bytes) -> str:
    """UTF-8, with or without a mark, else Windows-1252; line ends as newlines."""
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("cp1252", "replace")
    return text.replace("\r\n", "\n").replace("\r", "\n")


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _runs(node) -> str:
    return "".join((n.text or "") if _local(n) == "t" else "\t" if _local(n) == "tab" else "" for n in node.iter())


def _docx(z: zipfile.ZipFile) -> str:
    body = next(n for n in ElementTree.fromstring(z.read("word/document.xml")) if _local(n) == "body")
    out = []
    for node in body:
        if _local(node) == "p":
            out.append(_runs(node))
        elif _local(node) == "tbl":
            for row in (n for n in node if _local(n) == "tr"):
                out.append(" | ".join(_runs(c).strip() for c in row if _local(c) == "tc"))
    return "\n".join(x for x in out if x.strip())


def _numbered(names: list[str], pattern: str) -> list[tuple[int, str]]:
    return sorted((int(m[1]), n) for n in names if (m := re.fullmatch(pattern, n)))


def _pptx(z: zipfile.ZipFile) -> str:
    out = []
    for i, name in _numbered(z.namelist(), r"ppt/slides/slide(\d+)\.xml"):
        lines = [_runs(n) for n in ElementTree.fromstring(z.read(name)).iter() if _local(n) == "p"]
        out += [f"--- Slide {i} ---", *(x for x in lines if x.strip())]
    return "\n".join(out)


def _xlsx(z: zipfile.ZipFile) -> str:
    strings = [_runs(n) for n in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    sheets = [n for n in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(n) == "sheet"]
    names = [name for _, name in _numbered(z.namelist(), r"xl/worksheets/sheet(\d+)\.xml")]
    targets = {}
    if "xl/_rels/workbook.xml.rels" in z.namelist():
        targets = {n.get("Id"): "xl/" + n.get("Target").removeprefix("/xl/") for n in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    relation = lambda n: next((v for k, v in n.attrib.items() if k.rpartition("}")[2] == "id" and k != "id"), None)
    titled = [(n.get("name"), targets.get(relation(n), names[i] if i < len(names) else None)) for i, n in enumerate(sheets)]
    out = []
    for title, name in titled:
        if name not in z.namelist():
            continue
        out.append(f"--- Sheet: {title} ---")
        for row in (n for n in ElementTree.fromstring(z.read(name)).iter() if _local(n) == "row"):
            cells = []
            for c in row:
                value = next((n.text for n in c if _local(n) == "v"), None)
                value = strings[int(value)] if c.get("t") == "s" and value is not None else _runs(c) if c.get("t") == "inlineStr" else value
                if value and value.strip():
                    cells.append(value.strip())
            if cells:
                out.append("\t".join(cells))
    return "\n".join(out)


def _eml(data: bytes) -> str:
    m = email.message_from_bytes(data, policy=email.policy.default)
    out = [f"{h}: {m[h]}" for h in ("Subject", "From", "To", "Cc", "Date") if m[h]]
    body = m.get_body(("plain",))
    text = body.get_content() if body else html_to_text(page.get_content()) if (page := m.get_body(("html",))) else ""
    names = [a.get_filename() for a in m.iter_attachments() if a.get_filename()]
    return "\n".join([*out, "", text.strip(), *([f"Attachments: {', '.join(names)}"] if names else [])]).replace("\r\n", "\n")


def text_of(ext: str | None, data: bytes | None) -> tuple[str, str | None, str | None]:
    """(status, text, error): extracted, unsupported, unavailable or failed; a bad file never stops the others."""
    ext = (ext or "").lower()
    if data is None:
        return "unavailable", None, None
    try:
        if ext in ("txt", "md", "csv"):
            return "extracted", plain(data), None
        if ext in ("html", "htm"):
            return "extracted", html_to_text(plain(data)), None
        if ext == "eml":
            return "extracted", _eml(data), None
        if ext in ("docx", "pptx", "xlsx"):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return "extracted", {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx}[ext](z), None
        return "unsupported", None, None  # PDF among them: no reader for it is installed
    except Exception as error:
        return "failed", None, f"{type(error).__name__}: {error}"


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("status", "text", "error")]))
def extracted(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_of(e, c) for e, c in zip(ext, content)], columns=["status", "text", "error"])


def documents(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """The listed files with content hash, type, status and text; contents are read for these alone."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")
    rows = raw.join(files, "path").withColumn("x", extracted("ext", "content"))
    return rows.select(*files.columns, F.sha2("content", 256).alias("content_hash"), document_type(F.col("ext")).alias("document_type"), mime_type(F.col("ext")).alias("mime_type"), "x.*")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    """Article sidecars (JSON) with the text of the page or markdown file they name; the hash falls back to the text's."""
    schema = "id string, title string, source_url string, category string, folder string, modified_at string, crawled_at string, article_text string, content_hash string, raw_html_path string, markdown_path string"
    meta = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(folder)
    need = F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("source_url").isNotNull()
    rows = meta.where(need).withColumn("_name", F.regexp_extract(normal_path(F.coalesce("markdown_path", "raw_html_path")), "([^/]*)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{md,html}").load(folder)
    bodies = files.select(F.lower(F.regexp_extract("path", "([^/]*)$", 1)).alias("_name"), F.decode("content", F.lit("UTF-8")).alias("markdown"))
    rows = rows.join(bodies, "_name", "left").drop("_name")
    return rows.withColumn("content_hash", F.coalesce("content_hash", F.sha2(F.coalesce("article_text", "markdown", F.lit("")), 256)))
