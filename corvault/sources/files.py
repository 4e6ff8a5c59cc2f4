"""Readers: files to Markdown, one row for each file, and chunk files to rows.

Files are read as binary rows; a registry maps extensions to converters of bytes to Markdown, and
more can be registered.  A file that can't be converted gives a row with its error, and the rest go on.
"""

from __future__ import annotations

import base64
import hashlib
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvault.functions import text as T
from corvault.operators.chunking import contacts_on_lines
from corvault.sources import pdf

Converter = Callable[[bytes, str], str]
_converters: dict[str, Converter] = {}
#: Extensions of plain text and of images.
TEXT = "txt md csv json xml yaml yml log ini cfg conf toml".split()
IMAGES = "png jpg jpeg gif bmp tiff webp".split()


def register(extensions: list[str], convert: Converter) -> None:
    for e in extensions:
        _converters.setdefault(e, convert)


def supported() -> list[str]:
    return sorted(_converters)


def convert(content: bytes, name: str, by: str | None = None) -> str:
    """Bytes of a file to Markdown by its extension, or by the converter of a name."""
    if by is not None:
        return _named[by](content, name)
    ext = name.rpartition(".")[2].lower()
    if ext not in _converters:
        raise ValueError(f"unsupported file type: {name}")
    return _converters[ext](content, name)


def table_lines(rows: list[list[str]]) -> str:
    """Rows under a header as "header: cell" lines, rows parted by ---; empty cells are left out."""
    if not rows:
        return ""
    width = max(map(len, rows))
    head, *body = [[*r, *[""] * (width - len(r))] for r in rows]
    if not body:
        return " | ".join(x for x in head if x)
    blocks = ["\n".join(f"{h}: {c}" if h else c for h, c in zip(head, r) if c.strip()) for r in body]
    return "\n---\n".join(b for b in blocks if b)


def table_markdown(rows: list[list[str]]) -> str:
    """Rows as a table of bars; bars within cells are escaped, short rows filled up."""
    if not rows:
        return ""
    width = max(map(len, rows))
    cells = [[c.replace("|", "\\|").replace("\n", " ") for c in [*r, *[""] * (width - len(r))]] for r in rows]
    bar = lambda r: "| " + " | ".join(r) + " |"
    return "\n".join([bar(cells[0]), bar(["---"] * width), *map(bar, cells[1:])])


def image_marker(name: str) -> str:
    return f"##{name}##"


#: Fixed value: the largest image that is taken from a page.
MOST_IMAGE = 10 * 1024 * 1024


def data_image(uri: str) -> tuple[str, bytes] | None:
    """(name, content) of an image within a page; None where it isn't one or is too large.  The name is made from the content."""
    m = re.fullmatch(r"data:image/([a-zA-Z0-9.+-]+)((?:;[^,;]*)*),(.*)", uri, re.S)
    if not m or len(m[3]) > 2 * MOST_IMAGE:
        return None
    try:
        raw = base64.b64decode(m[3]) if ";base64" in m[2] else html.unescape(m[3]).encode()
    except ValueError:
        return None
    ext = {"jpeg": "jpg", "svg+xml": "svg"}.get(m[1].lower(), m[1].lower())
    return (f"{hashlib.sha1(raw).hexdigest()[:12]}.{ext}", raw) if 0 < len(raw) <= MOST_IMAGE else None


def data_name(uri: str) -> str:
    got = data_image(uri)
    return got[0] if got else "image"


def media(content: bytes, name: str) -> list[tuple[str, str, bytes]]:
    """(name in the archive, new name, content) of the pictures of an office file, numbered in the order of their names; paths that lead out are left out."""
    stem = PurePosixPath(name).stem
    out = []
    if not zipfile.is_zipfile(io.BytesIO(content)):
        return out
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for i, n in enumerate(sorted(n for n in z.namelist() if re.match(r"(?:word|ppt|xl)/media/", n) and not n.endswith("/")), 1):
            path = PurePosixPath(n.replace("\\", "/"))
            if not path.is_absolute() and ".." not in path.parts:
                out.append((n, f"{stem}_{i:03d}{path.suffix or '.png'}", z.read(n)))
    return out


def _pictures(z: zipfile.ZipFile, part: str, names: dict[str, str]) -> dict[str, str]:
    """Relation ids of a part to the new names of its pictures."""
    folder, _, file = part.rpartition("/")
    rels = f"{folder}/_rels/{file}.rels"
    if rels not in z.namelist():
        return {}
    out = {}
    for r in _xml(z, rels):
        target = _attr(r, "Target") or ""
        at = str(PurePosixPath(folder, target)) if not target.startswith("/") else target[1:]
        parts: list[str] = []
        for x in at.split("/"):
            parts = parts[:-1] if x == ".." else [*parts, x]
        if "/".join(parts) in names:
            out[_attr(r, "Id") or ""] = names["/".join(parts)]
    return out


class _Html(HTMLParser):
    """Markdown of a page's content; scripts, styles, navigation and the page's own header and footer are left out."""

    DROPPED = {"script", "style", "noscript", "nav", "title", "head"}
    BLOCKS = {"p", "div", "section", "article", "ul", "ol", "table", "blockquote", "main", "body", "html"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.text = ""
        self.stack: list[str] = []
        self.skip = 0
        self.href: list[str | None] = []
        self.rows: list[list[str]] | None = None
        self.pre = False

    def flush(self, before: str = "") -> None:
        t = self.text if self.pre else re.sub(r"\s+", " ", self.text).strip()
        if t.strip():
            self.parts.append(before + t)
        self.text = ""

    def _drops(self, tag: str) -> bool:
        return tag in self.DROPPED or (tag in ("header", "footer") and self.stack and self.stack[-1] == "body")

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "meta", "link", "input"):
            if not self.skip:
                if tag == "br":
                    self.text += "\n" if self.pre else " "
                if tag == "img":
                    a = dict(attrs)
                    src = a.get("src") or ""
                    self.text += image_marker(data_name(src)) if src.startswith("data:image/") else f"![{a.get('alt') or ''}]({src})"
            return
        if self._drops(tag):
            self.skip += 1
        self.stack.append(tag)
        if self.skip:
            return
        if tag in self.BLOCKS or re.fullmatch("h[1-6]|li|pre", tag):
            self.flush()
        if tag in ("strong", "b"):
            self.text += "**"
        if tag in ("em", "i"):
            self.text += "*"
        if tag == "code" and not self.pre:
            self.text += "`"
        if tag == "a":
            h = html.unescape(dict(attrs).get("href") or "").lstrip("".join(map(chr, range(33))))
            scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", h)
            self.href.append(h if h and (not scheme or scheme[1].lower() in ("http", "https", "mailto", "ftp")) else None)
            self.text += "[" if self.href[-1] else ""
        if tag == "pre":
            self.pre = True
        if tag == "table":
            self.rows = []
        if tag == "tr" and self.rows is not None:
            self.rows.append([])

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        while self.stack:
            top = self.stack.pop()
            self._close(top)
            if top == tag:
                break

    def _close(self, tag):
        if self.skip:
            if self._drops(tag):
                self.skip -= 1
            return
        if m := re.fullmatch("h([1-6])", tag):
            self.flush("#" * int(m[1]) + " ")
        elif tag == "li":
            self.flush("- ")
        elif tag == "pre":
            code = self.text.strip("\n")
            self.text, self.pre = "", False
            self.parts.append(f"```\n{code}\n```")
        elif tag in ("strong", "b"):
            self.text += "**"
        elif tag in ("em", "i"):
            self.text += "*"
        elif tag == "code" and not self.pre:
            self.text += "`"
        elif tag == "a" and self.href:
            h = self.href.pop()
            self.text += f"]({h})" if h else ""
        elif tag in ("td", "th") and self.rows:
            self.rows[-1].append(re.sub(r"\s+", " ", self.text).strip())
            self.text = ""
        elif tag == "table" and self.rows is not None:
            self.parts.append(table_lines([r for r in self.rows if r]))
            self.rows = None
        elif tag in self.BLOCKS:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text += data

    def result(self) -> str:
        self.close()
        self.flush()
        return "\n\n".join(p for p in self.parts if p)


def html_markdown(page: str) -> str:
    p = _Html()
    p.feed(page)
    return p.result()


def _xml(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name))


def _local(e) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _runs(e, text_tag: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if _local(x) == text_tag)


def docx(content: bytes, name: str) -> str:
    """Paragraphs with headings and lists and the markers of their pictures, then tables; fields of a table of contents are left out."""
    names = {n: new for n, new, _ in media(content, name)}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        pictures = _pictures(z, "word/document.xml", names)
        body = next(x for x in _xml(z, "word/document.xml") if _local(x) == "body")
        edges = {_runs(p).strip() for n in z.namelist() if re.fullmatch(r"word/(?:header|footer)\d*\.xml", n) for p in _xml(z, n).iter() if _local(p) == "p"}
    parts, tables = [], []
    for e in body:
        if _local(e) == "tbl":
            tables.append(table_lines([[_runs(c).strip() for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]))
        if _local(e) != "p":
            continue
        style = next((_attr(x, "val") or "" for x in e.iter() if _local(x) == "pStyle"), "").lower()
        shown = [pictures[r] for x in e.iter() if _local(x) == "blip" and (r := _attr(x, "embed")) in pictures]
        t = _runs(e).strip()
        if shown and not t:
            parts += map(image_marker, shown)
            continue
        if not t or style.startswith("toc") or t in edges or any(_local(x) == "instrText" and "TOC" in (x.text or "") for x in e.iter()):
            continue
        m = re.search(r"heading\s*([1-6])", style)
        bullet = "list" in style or any(_local(x) == "numPr" for x in e.iter())
        parts.append("#" * int(m[1]) + " " + t if m else "- " + t if bullet else t)
        parts += map(image_marker, shown)
    return "\n\n".join([*parts, *(t for t in tables if t)])


def docx_fast(content: bytes, name: str) -> str:
    """Paragraphs with three levels of headings and lists, and tables of bars; no pictures, nothing is left out.  Chosen by name only."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = next(x for x in _xml(z, "word/document.xml") if _local(x) == "body")
    parts, tables = [], []
    for e in body:
        if _local(e) == "tbl":
            rows = [[_runs(c).strip() for c in r if _local(c) == "tc"] for r in e if _local(r) == "tr"]
            rows = ["| " + " | ".join(r) + " |" for r in rows if any(r)]
            if len(rows) >= 2:
                tables += [rows[0], "|" + "---|" * rows[0].count(" | ") + "---|", *rows[1:]]
        elif _local(e) == "p" and (t := _runs(e).strip()):
            style = next((_attr(x, "val") or "" for x in e.iter() if _local(x) == "pStyle"), "").lower()
            m = re.search(r"heading\s*([1-3])", style)
            parts.append("#" * int(m[1]) + " " + t if m else "- " + t if "list" in style else t)
    return re.sub(r"\n{3,}", "\n\n", "\n\n".join([*parts, *tables])).strip() + "\n"


def xlsx(content: bytes, name: str, sheet: str | int | None = None) -> str:
    """The rows of every sheet, or of one by name or number, as header: cell lines; several sheets have headings."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [_runs(s) for s in _xml(z, "xl/sharedStrings.xml") if _local(s) == "si"] if "xl/sharedStrings.xml" in z.namelist() else []
        titles = [_attr(s, "name") or "" for s in _xml(z, "xl/workbook.xml").iter() if _local(s) == "sheet"]
        files = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        out = []
        chosen = [(i, f) for i, f in enumerate(files) if sheet is None or sheet in (i, titles[i] if i < len(titles) else None)]
        if not chosen and files:
            raise ValueError(f"no sheet {sheet!r} in {name}")
        for i, f in chosen:
            rows = []
            for r in (x for x in _xml(z, f).iter() if _local(x) == "row"):
                row: list[str] = []
                for c in (x for x in r if _local(x) == "c"):
                    letters = re.match("[A-Z]*", _attr(c, "r") or "")[0]
                    col = 0
                    for ch in letters:
                        col = col * 26 + ord(ch) - 64
                    while letters and len(row) < col - 1:
                        row.append("")
                    v = next((x.text or "" for x in c if _local(x) == "v"), _runs(c))
                    row.append(shared[int(v)] if _attr(c, "t") == "s" and v else v)
                if any(row):
                    rows.append(row)
            body = table_lines(rows)
            out.append(f"## Sheet: {titles[i] if i < len(titles) else i + 1}\n\n{body}" if len(chosen) > 1 else body)
    return "\n\n".join(out)


def pptx(content: bytes, name: str) -> str:
    """Slides with their texts as bullets by level, and tables; slides are parted by rules."""
    out = []
    names = {n: new for n, new, _ in media(content, name) if not new.lower().endswith((".emf", ".wmf"))}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
        for i, f in enumerate(slides, 1):
            lines = [f"## Slide {i}"]
            root = _xml(z, f)
            in_tables = {id(p) for t in root.iter() if _local(t) == "tbl" for p in t.iter() if _local(p) == "p"}
            for p in (x for x in root.iter() if _local(x) == "p" and id(x) not in in_tables):
                if t := _runs(p).strip():
                    level = next((int(_attr(x, "lvl") or 0) for x in p if _local(x) == "pPr"), 0)
                    lines.append("  " * level + "- " + t)
            for t in (x for x in root.iter() if _local(x) == "tbl"):
                lines.append(table_lines([[_runs(c).strip() for c in r if _local(c) == "tc"] for r in t if _local(r) == "tr"]))
            pictures = _pictures(z, f, names)
            lines += [image_marker(pictures[r]) for x in root.iter() if _local(x) == "blip" and (r := _attr(x, "embed")) in pictures]
            out.append("\n".join(lines))
    return "\n\n---\n\n".join(out)


register(TEXT, lambda b, _: b.decode("utf-8", "replace"))
register(["html", "htm"], lambda b, _: html_markdown(b.decode("utf-8", "replace")))
register(["docx"], docx)
register(["xlsx"], xlsx)
register(["pptx"], pptx)
register(["pdf"], lambda b, _: pdf.markdown(pdf.without_edges(pdf.lines(b))))
register(IMAGES, lambda _, name: f"[Image: {name}]\n")
_named: dict[str, Converter] = {"docx-fast": docx_fast}


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, level, size, modified) of the convertible files below ``root``; hidden files are left out, contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return found.where(ext.isin(supported()) & ~F.regexp_extract("path", "([^/]+)$", 1).startswith(".")).select("path", T.level_of_path(F.col("path")).alias("level"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _finished(path, text):
    """What plain text and PDF files go through once they are text: contacts on their own lines, no marks of tables of contents, clean ends."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "pdf", T.clean_markdown(contacts_on_lines(T.strip_toc_markers(text)))).when(ext.isin(TEXT), T.clean_markdown(contacts_on_lines(text))).otherwise(text)


def source_counts(spark: SparkSession, root: str) -> DataFrame:
    """(level, files, bytes) of the convertible files below ``root``; contents aren't read."""
    return discover(spark, root).groupBy("level").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(name, path, size, size_display, modified) of the files right below ``root``, newest first; hidden files are left out."""
    found = spark.read.format("binaryFile").load(root).select("path", "length", "modificationTime")
    mb = 1024 * 1024
    said = F.when(F.col("length") < mb, F.format_string("%.1f KB", F.col("length") / 1024)).otherwise(F.format_string("%.1f MB", F.col("length") / mb))
    rows = found.select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "path", F.col("length").alias("size"), said.alias("size_display"), F.col("modificationTime").alias("modified"))
    return rows.where(~F.col("name").startswith(".")).orderBy(F.desc("modified"), "name")


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, document, level, image_index, image_id, size): pictures in the ``images`` folders of documents, numbered within each by name."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    at = found.where(F.lower("path").rlike(r"/images/[^/]+\.(?:jpg|jpeg|png|webp|gif|bmp)$"))
    named = at.select("path", F.regexp_extract("path", "/([^/]+)/images/[^/]+$", 1).alias("document"), T.level_of_path(F.col("path")).alias("level"), F.col("length").alias("size"))
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy("level", "document").orderBy("path")) - 1
    key = F.md5(F.concat_ws(":", "level", "document", no.cast("string"), F.regexp_extract("path", "([^/]+)$", 1)))
    return named.select("path", "document", "level", no.alias("image_index"), key.alias("image_id"), "size")


def document_folders(spark: SparkSession, root: str) -> DataFrame:
    """(folder, level): folders of documents, which have pictures or files of parents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    folder = F.regexp_extract("path", r"^(.*/[^/]+)/(?:images/[^/]+|[^/]+\.parents\.json)$", 1)
    return found.select(folder.alias("folder")).where("folder != ''").distinct().select("folder", T.level_of_path(F.col("folder")).alias("level"))


def office_media(spark: SparkSession, root: str) -> DataFrame:
    """(path, inner, name, content): the pictures in the office files below ``root``; files that can't be opened give none."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,pptx,xlsx}").load(root).select("path", "content")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found = media(content, path.rpartition("/")[2])
                except (zipfile.BadZipFile, OSError):
                    continue
                cols = [[x[i] for x in found] for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(found), pa.string()), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.binary())], ["path", "inner", "name", "content"])

    return rows.mapInArrow(run, "path string, inner string, name string, content binary")


def described(texts: DataFrame, descriptions: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``texts`` (id, text) with each image marker replaced by its picture's description (name, text), where there is one by the name without extension.

    Markers are taken out, looked up by a join and put back in their places; a text without markers doesn't move.
    """
    mark = "##[^#]+##"
    c = F.col(text_col)
    rows = texts.select(F.col(id_col).alias("id"), c.alias("text"))
    plain = rows.where(~F.coalesce(F.col("text").rlike(mark), F.lit(False)))
    cut = rows.where(F.col("text").rlike(mark)).select("id", F.monotonically_increasing_id().alias("row"), F.regexp_extract_all("text", F.lit(mark), F.lit(0)).alias("m"), F.split("text", mark, -1).alias("between"))
    stem = lambda x: F.regexp_replace(F.regexp_extract(x, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    each = cut.select("id", "row", "between", F.posexplode("m").alias("n", "mark")).withColumn("stem", stem(F.substring("mark", F.lit(3), F.length("mark") - 4)))
    known = descriptions.select(stem(F.col(descriptions.columns[0])).alias("stem"), F.trim(descriptions.columns[1]).alias("said")).dropDuplicates(["stem"])
    joined = each.join(known, "stem", "left").select("id", "row", "between", "n", F.coalesce("said", "mark").alias("said"))
    back = joined.groupBy("id", "row", "between").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "said"))), lambda x: x["said"]).alias("said"))
    whole = F.array_join(F.flatten(F.transform(F.arrays_zip("between", "said"), lambda z: F.array(z["between"], F.coalesce(z["said"], F.lit(""))))), "")
    return plain.unionByName(back.select("id", whole.alias("text")))


def sources_of(outputs: DataFrame, inputs: DataFrame, out_root: str, in_root: str) -> DataFrame:
    """(output, source): the input file of each Markdown file: the one at the same relative path with another extension, else one of the same stem, the first by name."""
    bare = lambda c, root: F.regexp_replace(F.regexp_replace(c, "^" + re.escape(root.rstrip("/")) + "/", ""), r"\.[^./]*$", "")
    i = inputs.select(F.col(inputs.columns[0]).alias("source")).withColumn("rel", bare(F.col("source"), in_root)).withColumn("stem", F.regexp_extract("rel", "([^/]+)$", 1))
    o = outputs.select(F.col(outputs.columns[0]).alias("output")).withColumn("rel", bare(F.col("output"), out_root)).withColumn("stem", F.regexp_extract("rel", "([^/]+)$", 1))
    same = i.groupBy("rel").agg(F.min("source").alias("near"))
    alike = i.groupBy("stem").agg(F.min("source").alias("far"))
    return o.join(same, "rel", "left").join(alike, "stem", "left").select("output", F.coalesce("near", "far").alias("source"))


def pdf_elements(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, elements): PDF files as Markdown, and of each line where it stands in that text, its page and its box."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root).select("path", "content")
    line = pa.struct([("text", pa.string()), ("page", pa.int32()), ("box", pa.list_(pa.float64()))])
    spot = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("page", pa.int32()), ("box", pa.list_(pa.float64())), ("type", pa.string())])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = [], []
            for content in b.column(1).to_pylist():
                try:
                    pages = pdf.without_edges(pdf.lines(content))
                except (ValueError, zipfile.BadZipFile, Exception):  # noqa: BLE001 - one bad file must not stop the others
                    pages = []
                texts.append(pdf.markdown(pages))
                found.append([{"text": t, "page": i, "box": box} for i, p in enumerate(pages, 1) for t, box in p])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(found, pa.list_(line))], ["path", "text", "lines"])

    def place(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, own in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at, spots = 0, []
                for x in own:
                    found = text.find(x["text"], at)
                    if found >= 0:
                        at = found + len(x["text"])
                        spots.append({"start": found, "end": at, "page": x["page"], "box": x["box"], "type": "text"})
                out.append(spots)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(spot))], ["path", "text", "elements"])

    made = rows.mapInArrow(run, "path string, text string, lines array<struct<text:string,page:int,box:array<double>>>")
    done = made.select("path", T.clean_markdown(contacts_on_lines(T.strip_toc_markers(F.col("text")))).alias("text"), "lines")
    return done.mapInArrow(place, "path string, text string, elements array<struct<start:int,end:int,page:int,box:array<double>,type:string>>")


def verified_elements(documents: DataFrame) -> DataFrame:
    """(path, elements, outside, empty, unsorted, wrong_page, covered): whether the elements of :func:`pdf_elements` lie within their text, in order, and on their page."""
    marks = F.regexp_extract_all("text", F.lit("<!-- Page ([0-9]+) -->"), F.lit(1))
    d = documents.select("path", "text", "elements", marks.alias("pages"), F.split("text", "<!-- Page [0-9]+ -->").alias("parts"))
    starts = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x)))
    # the text before a page, and the markers in front of it
    width = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.aggregate(F.slice("pages", F.lit(1), i - 1), F.lit(0), lambda s, x: s + F.length(x) + 14))
    d = d.withColumn("begin", F.zip_with(starts, width, lambda a, b: a + b))
    e = d.select("path", "text", "pages", "begin", F.posexplode_outer("elements").alias("n", "e"))
    before = F.element_at(F.col("begin"), F.array_position("pages", F.col("e.page").cast("string")).cast("int"))
    after = F.get("begin", F.array_position("pages", F.col("e.page").cast("string")).cast("int"))
    from pyspark.sql import Window

    last = F.lag("e.start").over(Window.partitionBy("path").orderBy("n"))
    e = e.withColumn("unsorted", F.col("e.start") < last).withColumn("on_page", (F.col("e.start") >= before) & (F.col("e.end") <= F.coalesce(after, F.length("text"))))
    some = F.col("e").isNotNull()
    return e.groupBy("path").agg(
        F.count_if(some).alias("elements"), F.count_if(some & ((F.col("e.start") < 0) | (F.col("e.end") > F.length("text")))).alias("outside"), F.count_if(some & (F.col("e.end") <= F.col("e.start"))).alias("empty"),
        F.count_if(F.coalesce("unsorted", F.lit(False))).alias("unsorted"), F.count_if(some & ~F.coalesce("on_page", F.lit(False))).alias("wrong_page"),
        F.round(F.coalesce(F.sum(F.col("e.end") - F.col("e.start")), F.lit(0)) / F.greatest(F.lit(1), F.max(F.length("text"))), 4).alias("covered"),
    )


def markdown(spark: SparkSession, root: str, only: DataFrame | None = None) -> DataFrame:
    """(path, level, text, error): every file below ``root`` as Markdown, or why not.  ``only`` (path): just these."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    if only is not None:
        rows = rows.join(only.select("path").distinct(), "path", "left_semi")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    texts.append(convert(content, path.rpartition("/")[2]))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - one bad file must not stop the others
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    done = rows.mapInArrow(run, "path string, text string, error string").withColumn("level", T.level_of_path(F.col("path")))
    return done.withColumn("text", _finished(F.col("path"), F.col("text")))


CHUNK_FILE = (
    "array<struct<text:string,metadata:struct<chunk_index:int,source:string,page:int,bbox:string,chunk_type:string,abstract:string,document_name:string,doc_id:string>>>"
)


def chunk_files(spark: SparkSession, root: str, strategy: str = "auto") -> DataFrame:
    """Rows of the chunk files below ``root`` (``*.chunks.json``, ``*.parents.json``, ``*.children.json``).

    Files that are no such lists give nothing; missing fields get defaults.  ``strategy``: auto, chunk, parent-child, parents-only or children-only.
    """
    kinds = {"chunk": ["chunks"], "parent-child": ["parents", "children"], "parents-only": ["parents"], "children-only": ["children"]}.get(strategy, ["chunks", "parents", "children"])
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.{chunks,parents,children}.json").text(root).select("value", F.col("_metadata.file_path").alias("file_path"))
    kind = T.chunk_kind(F.col("file_path"))
    rows = files.where(kind.isin(kinds)).select("file_path", kind.alias("kind"), F.posexplode(F.from_json("value", CHUNK_FILE)).alias("n", "c")).where("c is not null")
    m = F.col("c.metadata")
    return rows.select(
        F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce(m["chunk_index"], F.col("n")).alias("chunk_index"), F.coalesce(m["source"], F.lit("")).alias("source"), m["page"].alias("page"),
        F.coalesce(m["bbox"], F.lit("")).alias("bbox"), F.coalesce(m["chunk_type"], F.lit("text")).alias("chunk_type"), F.coalesce(m["abstract"], F.lit("")).alias("abstract"),
        F.coalesce(m["document_name"], F.lit("")).alias("document_name"), m["doc_id"].alias("doc_id"), F.when(F.col("kind") == "children", m["doc_id"]).alias("parent_doc_id"),
        (F.col("kind") == "parents").alias("is_parent"), "kind", T.level_of_path(F.col("file_path")).alias("level"), "file_path",
    )


def write_chunk_files(chunks: DataFrame, path: str) -> None:
    """One JSON row for each document: its chunks as an array, in order."""
    item = F.struct("chunk_index", "text", "source", "page", "doc_id")
    chunks.groupBy("file_path").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("chunks")).write.json(path)
