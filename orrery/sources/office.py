"""Workbooks and documents of Office Open XML (.xlsx, .docx, .pptx): zip archives of XML, read with the standard library alone.

A workbook is a data source of Spark with a partition for each sheet; a sheet's XML is read as a stream, row by row, so that a task holds
one row and the workbook's shared strings. Documents become Markdown where their bytes are.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from contextlib import closing, contextmanager
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Number formats of dates and times that need no definition (fixed values).
DATE_FORMATS = frozenset([*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)])
#: What a date format holds outside quotes, escapes and brackets.
_DATE_LETTERS = re.compile(r"[dmyhs]", re.I)
_NOT_LETTERS = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]|_.|\*.')


@contextmanager
def opened(path: str) -> Iterator[zipfile.ZipFile]:
    """The archive at a path that this machine sees, or at a URI that pyarrow's file systems know."""
    scheme = re.match(r"([a-z][a-z0-9+.-]+):", path)
    if scheme and scheme[1] != "file":
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        with system.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
            yield z
    else:
        with zipfile.ZipFile(re.sub(r"^file:(//)?", "", path)) as z:
            yield z


def local_name(tag: str) -> str:
    return tag.rpartition("}")[2]


def attribute(e: ElementTree.Element, name: str, default: str | None = None) -> str | None:
    """An attribute by its name in any namespace."""
    return next((v for k, v in e.attrib.items() if local_name(k) == name), default)


def parts(z: zipfile.ZipFile, part: str, names: frozenset[str]) -> Iterator[ElementTree.Element]:
    """The elements with these names of an XML part, each complete, as the part is read; what has been read is let go."""
    with z.open(part) as f:
        path: list[ElementTree.Element] = []
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if event == "start":
                path.append(e)
                continue
            path.pop()
            if local_name(e.tag) in names and not any(local_name(p.tag) in names for p in path):
                yield e
                if path:
                    path[-1].remove(e)


def relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    """Targets of a part's relations by their ids, as paths in the archive; those outside it as they are."""
    folder, name = posixpath.split(part)
    at = f"{folder}/_rels/{name}.rels"
    if at not in z.namelist():
        return {}
    out = {}
    for r in parts(z, at, frozenset(["Relationship"])):
        target = r.get("Target", "")
        out[r.get("Id", "")] = target if r.get("TargetMode") == "External" else target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
    return out


# --- workbooks


def sheets(z: zipfile.ZipFile) -> dict[str, str]:
    """The sheets' parts by their names, in the workbook's order."""
    targets = relations(z, "xl/workbook.xml")
    found = {e.get("name", ""): targets.get(attribute(e, "id") or "", "") for e in parts(z, "xl/workbook.xml", frozenset(["sheet"]))}
    return {n: p for n, p in found.items() if p in z.namelist()}


def sheet_names(path: str) -> list[str]:
    with opened(path) as z:
        return [*sheets(z)]


def _text(e: ElementTree.Element) -> str:
    """The text of a string item: its runs, without what tells their pronunciation."""
    if local_name(e.tag) == "t":
        return e.text or ""
    return "".join(_text(c) for c in e if local_name(c.tag) in ("t", "r"))


class Workbook:
    """What the cells of all sheets refer to: shared strings, which styles are dates, and the first day of dates."""

    def __init__(self, z: zipfile.ZipFile):
        names = set(z.namelist())
        self.strings = [_text(e) for e in parts(z, "xl/sharedStrings.xml", frozenset(["si"]))] if "xl/sharedStrings.xml" in names else []
        first = next(parts(z, "xl/workbook.xml", frozenset(["workbookPr"])), None)
        self.epoch = datetime(1904, 1, 1) if first is not None and first.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        self.dates: list[bool] = []
        if "xl/styles.xml" in names:
            custom: dict[int, bool] = {}
            for e in parts(z, "xl/styles.xml", frozenset(["numFmts", "cellXfs"])):
                for x in e:
                    if local_name(x.tag) == "numFmt":
                        code = _NOT_LETTERS.sub("", x.get("formatCode", ""))
                        custom[int(x.get("numFmtId", "0"))] = bool(_DATE_LETTERS.search(code)) and "general" not in code.lower()
                    elif local_name(x.tag) == "xf":
                        k = int(x.get("numFmtId", "0"))
                        self.dates.append(custom.get(k, k in DATE_FORMATS))

    def value(self, c: ElementTree.Element) -> object:
        """A cell's value: text, bool, int, float, datetime, or None if it is empty or an error."""
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return next((_text(x) for x in c if local_name(x.tag) == "is"), None)
        v = next((x.text for x in c if local_name(x.tag) == "v"), None)
        if v is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(v)] if int(v) < len(self.strings) else None
        if kind == "str":
            return v
        if kind == "b":
            return v.strip() == "1"
        if kind == "d":
            return datetime.fromisoformat(v.replace("Z", "+00:00")).replace(tzinfo=None)
        number = float(v)
        style = int(c.get("s", "0"))
        if style < len(self.dates) and self.dates[style]:
            return self.epoch + timedelta(milliseconds=round(number * 86_400_000))
        return int(number) if number.is_integer() and abs(number) < 1 << 53 and not re.search(r"[.eE]", v) else number

    def rows(self, z: zipfile.ZipFile, part: str) -> Iterator[list[object]]:
        """A sheet's rows that have a value, as they are read; cells that aren't there are None."""
        for row in parts(z, part, frozenset(["row"])):
            out: list[object] = []
            for c in row:
                if local_name(c.tag) != "c":
                    continue
                at = column_number(c.get("r", "")) if c.get("r") else len(out)
                out += [None] * (at - len(out))
                out.append(self.value(c))
            if any(v is not None and v != "" for v in out):
                yield out


def column_number(reference: str) -> int:
    """The place of a cell's column, from 0: A1 is 0, AA7 is 26."""
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = 26 * n + ord(ch.upper()) - 64
    return n - 1


def headers(first: list[object], width: int) -> list[str]:
    """Column names of a header row: blank ones by their place, repeated ones (without regard to case) with a number."""
    out: list[str] = []
    taken: set[str] = set()
    for i in range(width):
        name = str(first[i]).strip() if i < len(first) and first[i] is not None and str(first[i]).strip() else f"column_{i + 1}"
        own, k = name, 1
        while own.lower() in taken:
            k += 1
            own = f"{name}_{k}"
        taken.add(own.lower())
        out.append(own)
    return out


#: Types of values from the narrowest on; a column of several has the type that holds them all.
_KINDS = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), datetime: T.TimestampNTZType(), str: T.StringType()}


def column_type(kinds: set[type]) -> T.DataType:
    """The type that holds values of these kinds: whole numbers and others are doubles, all other mixtures text."""
    if kinds == {int, float}:
        return T.DoubleType()
    return _KINDS[next(iter(kinds))] if len(kinds) == 1 else T.StringType()


def written(value: object) -> str:
    """A value as text, in a column of mixed values."""
    return "true" if value is True else "false" if value is False else value.isoformat(sep=" ") if isinstance(value, datetime) else str(value)


class SheetPart(InputPartition):
    def __init__(self, sheet: str):
        super().__init__(sheet)
        self.sheet = sheet


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, wanted: list[str], schema: T.StructType, header: bool, by_sheet: bool):
        self.path, self.wanted, self.fields, self.header, self.by_sheet = path, wanted, schema.fields, header, by_sheet

    def partitions(self) -> list[SheetPart]:
        return [SheetPart(n) for n in self.wanted]

    def read(self, partition: SheetPart) -> Iterator[tuple]:
        fields = self.fields[1:] if self.by_sheet else self.fields

        def fit(v: object, kind: T.DataType) -> object:
            if v is None or v == "" and not isinstance(kind, T.StringType):
                return None
            if isinstance(kind, T.StringType):
                return v if isinstance(v, str) else written(v)
            if isinstance(kind, T.DoubleType) and isinstance(v, int):
                return float(v)
            return v

        with opened(self.path) as z:
            book = Workbook(z)
            with closing(book.rows(z, sheets(z)[partition.sheet])) as rows:
                for k, row in enumerate(rows):
                    if k == 0 and self.header:
                        continue
                    own = (fit(row[i] if i < len(row) else None, f.dataType) for i, f in enumerate(fields))
                    yield (partition.sheet, *own) if self.by_sheet else tuple(own)


class WorkbookSource(DataSource):
    """Options: path; sheet (a name; without one, all sheets that share the first one's columns by place, with a column `sheet`); header
    (true: the first row that has a value names the columns, else they are column_1, ...)."""

    @classmethod
    def name(cls) -> str:
        return "orrery_workbook"

    def _header(self) -> bool:
        return self.options.get("header", "true").lower() != "false"

    def _wanted(self, z: zipfile.ZipFile) -> list[str]:
        known, sheet = [*sheets(z)], self.options.get("sheet")
        if sheet is not None and sheet not in known:
            raise ValueError(f"no sheet {sheet!r} in {self.options['path']}; there are {', '.join(known)}")
        return known if sheet is None else [sheet]

    def schema(self) -> T.StructType:
        """The types that hold all values of a column; a column without values is text. Reads the sheets once."""
        names: list[str] = []
        kinds: list[set[type]] = []
        with opened(self.options["path"]) as z:
            book, known = Workbook(z), sheets(z)
            for sheet in self._wanted(z):
                for k, row in enumerate(book.rows(z, known[sheet])):
                    if k == 0 and self._header():
                        names = names or [str(v) if v is not None else "" for v in row]
                        continue
                    kinds += [set() for _ in range(len(row) - len(kinds))]
                    for have, v in zip(kinds, row, strict=False):
                        if v is not None and v != "":
                            have.add(type(v))
        width = max(len(names), len(kinds))
        kinds += [set() for _ in range(width - len(kinds))]
        fields = [T.StructField(n, column_type(k)) for n, k in zip(headers(names, width), kinds, strict=True)]
        return T.StructType(fields if self.options.get("sheet") is not None else [T.StructField("sheet", T.StringType()), *fields])

    def reader(self, schema: T.StructType) -> WorkbookReader:
        with opened(self.options["path"]) as z:
            wanted = self._wanted(z)
        return WorkbookReader(self.options["path"], wanted, schema, self._header(), self.options.get("sheet") is None)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, header: bool = True) -> DataFrame:
    """A sheet of a workbook as a table (the first one by default).

    Formulas have the value that was stored with them, errors and empty cells are null, dates are timestamps without a zone. Rows without
    any value are left out. A column of whole numbers and others is double, of values of several other kinds text.
    """
    spark.dataSource.register(WorkbookSource)
    return spark.read.format(WorkbookSource.name()).option("path", path).option("sheet", sheet if sheet is not None else sheet_names(path)[0]).option("header", str(header).lower()).load()


def read_workbook(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """All sheets of a workbook under each other, with a column `sheet`, a partition for each: for sheets of one layout."""
    spark.dataSource.register(WorkbookSource)
    return spark.read.format(WorkbookSource.name()).option("path", path).option("header", str(header).lower()).load()


# --- documents as Markdown


def _cell(text: str) -> str:
    return text.replace("|", r"\|").replace("\n", " ").strip()


def table_lines(rows: list[list[str]]) -> str:
    """A Markdown table, the first row as its head."""
    width = max(map(len, rows), default=0)
    full = [[*map(_cell, r), *[""] * (width - len(r))] for r in rows]
    if not width:
        return ""
    return "\n".join("| " + " | ".join(r) + " |" for r in [full[0], ["---"] * width, *full[1:]])


def _runs(e: ElementTree.Element, links: dict[str, str]) -> str:
    """The text of a paragraph's runs, bold and italic ones marked, links with their targets."""
    out = []
    for c in e:
        name = local_name(c.tag)
        if name == "r":
            text = "".join(x.text or "" if local_name(x.tag) == "t" else "\t" if local_name(x.tag) == "tab" else "\n" if local_name(x.tag) in ("br", "cr") else "" for x in c)
            style = next((x for x in c if local_name(x.tag) == "rPr"), None)
            on = {local_name(x.tag) for x in style if attribute(x, "val") not in ("0", "false", "none")} if style is not None else set()
            mark = ("**" if "b" in on else "") + ("*" if "i" in on else "")
            body = text.strip()
            out.append(text.replace(body, f"{mark}{body}{mark[::-1]}", 1) if mark and body else text)
        elif name == "hyperlink":
            target = links.get(attribute(c, "id") or "")
            inner = _runs(c, links)
            out.append(f"[{inner}]({target})" if target else inner)
        elif name in ("ins", "smartTag", "sdt", "sdtContent", "fld", "fldSimple"):
            out.append(_runs(c, links))
    return "".join(out).replace("****", "")


def _paragraph(p: ElementTree.Element, links: dict[str, str]) -> str:
    """A paragraph as Markdown: headings by their style or outline level, items of lists indented by level."""
    text = _runs(p, links).strip()
    if not text:
        return ""
    style, level, item = "", None, None
    for pr in (x for x in p if local_name(x.tag) == "pPr"):
        for x in pr:
            name = local_name(x.tag)
            if name == "pStyle":
                style = attribute(x, "val") or ""
            elif name == "outlineLvl":
                level = int(attribute(x, "val") or 0)
            elif name == "numPr":
                item = int(next((attribute(y, "val") for y in x if local_name(y.tag) == "ilvl"), "0") or 0)
    heading = re.fullmatch(r"heading\s*(\d)", style, re.I)
    if heading or style.lower() == "title" or level is not None and level < 6:
        depth = int(heading[1]) if heading else 1 if level is None else level + 1
        return f"{'#' * min(6, max(1, depth))} {text}"
    if item is not None or style.lower().startswith("list"):
        return f"{'  ' * (item or 0)}- {text}"
    return text


def _document(e: ElementTree.Element, links: dict[str, str]) -> list[tuple[str, bool]]:
    """Blocks of a document's body and whether they are items of a list."""
    out = []
    for c in e:
        name = local_name(c.tag)
        if name == "p":
            text = _paragraph(c, links)
            if text:
                out.append((text, text.lstrip().startswith("- ")))
        elif name == "tbl":
            rows = [["\n".join(b for b, _ in _document(cell, links)) for cell in row if local_name(cell.tag) == "tc"] for row in c if local_name(row.tag) == "tr"]
            out.append((table_lines(rows), False))
        elif name in ("sdt", "sdtContent", "body", "ins"):
            out += _document(c, links)
    return out


def docx_markdown(z: zipfile.ZipFile) -> str:
    links = relations(z, "word/document.xml")
    out, before = "", False
    for body in parts(z, "word/document.xml", frozenset(["body"])):
        for text, item in _document(body, links):
            out += ("" if not out else "\n" if item and before else "\n\n") + text
            before = item
    return out


def pptx_markdown(z: zipfile.ZipFile) -> str:
    """Slides in their order: a heading for each, the paragraphs of its shapes, its tables."""
    targets, out = relations(z, "ppt/presentation.xml"), []
    order = [targets.get(attribute(e, "id") or "", "") for e in parts(z, "ppt/presentation.xml", frozenset(["sldId"])) if attribute(e, "id")]
    slides = [targets[i] for e in parts(z, "ppt/presentation.xml", frozenset(["sldId"])) for k, i in e.attrib.items() if k.endswith("}id") and i in targets] or order
    for n, part in enumerate((p for p in slides if p in z.namelist()), 1):
        lines = [f"## Slide {n}"]
        for e in parts(z, part, frozenset(["p", "tbl"])):
            if local_name(e.tag) == "tbl":
                rows = [["".join(t.text or "" for t in cell.iter() if local_name(t.tag) == "t") for cell in row if local_name(cell.tag) == "tc"] for row in e if local_name(row.tag) == "tr"]
                lines.append(table_lines(rows))
            else:
                text = _runs(e, {}).strip()
                lines += [text] if text else []
        out.append("\n\n".join(lines))
    return "\n\n".join(out)


def xlsx_markdown(z: zipfile.ZipFile) -> str:
    """A heading and a table for each sheet."""
    book, out = Workbook(z), []
    for name, part in sheets(z).items():
        rows = [["" if v is None else written(v) for v in r] for r in book.rows(z, part)]
        out.append(f"## {name}" + (f"\n\n{table_lines(rows)}" if rows else ""))
    return "\n\n".join(out)


CONVERTERS: dict[str, Callable[[zipfile.ZipFile], str]] = {"docx": docx_markdown, "pptx": pptx_markdown, "xlsx": xlsx_markdown}


def markdown_of(content: bytes | None, ending: str) -> str | None:
    """The Markdown of a document's bytes; null for endings that aren't Office Open XML and for files that can't be read."""
    convert = CONVERTERS.get(ending.lower())
    if convert is None or content is None:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return convert(z)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError):
        return None


def documents_as_markdown(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rows (path, ending, markdown, n_chars) of documents; markdown is null where a file has no converter or can't be read. Each file is
    converted by the task that reads it, one at a time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    named = files.select("path", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ending"), "content")

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, ending, content in b.itertuples(index=False):
                yield pd.DataFrame({"path": [path], "ending": [ending], "markdown": [markdown_of(content, ending)]})

    out = named.mapInPandas(convert, "path string, ending string, markdown string")
    return out.withColumn("n_chars", F.length("markdown").cast("long"))
