"""Files of any format to text: each goes to the reader of its format.

Web pages, Markdown, plain text and JSON are column expressions; delimited and
spreadsheet files are parsed in Arrow batches, one file in memory at a time.
For formats that need a decoder of their own (``pdf``, ``img``, ``pbf``) a reader
is passed in: a function from a file's bytes to its text.  Without one such files
stay in the result with a null text, so that nothing gets lost silently.
"""

from __future__ import annotations

import csv
import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from functools import reduce
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .pages import markdown
from .structured import TEXT_FIELDS, decoded, json_text, string_leaves

#: The rows of a table that become text; ``truncated`` tells where there were more.
ROWS = 500
DELIMITERS = ",;\t|"
Reader = Callable[[bytes], str]
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _plain(content: bytes) -> str:
    """UTF-8 with or without a mark, else Windows-1252."""
    try:
        return content.decode("utf-8-sig")
    except UnicodeDecodeError:
        return content.decode("cp1252", errors="replace")


def delimiter(text: str) -> str:
    """The delimiter by which most of the first lines have as many cells as the head, and more than one; a comma if none does."""
    lines = [x for x in text.splitlines()[:20] if x.strip()]
    found = []
    for d in DELIMITERS:
        counts = [len(row) for row in csv.reader(lines, delimiter=d)]
        if counts and counts[0] > 1:
            found.append((counts.count(counts[0]), counts[0], -DELIMITERS.index(d), d))
    return max(found)[3] if found else ","


def delimited(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """A delimited file as one table; rows of another length than the head are left out."""
    text = _plain(content)
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter(text)) if any(c.strip() for c in r)]
    return [("", [r for r in rows if len(r) == len(rows[0])])] if rows else []


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if c.isalpha():
            n = n * 26 + ord(c.upper()) - 64
    return n - 1


def spreadsheet(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """The sheets of a workbook by name, in its order; a workbook is a zip of XML."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = lambda name: ElementTree.fromstring(z.read(name))
        names = set(z.namelist())
        text = lambda e: "".join(t.text or "" for t in e.iter(f"{_MAIN}t"))
        shared = [text(e) for e in xml("xl/sharedStrings.xml").iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        targets = {e.get("Id"): e.get("Target") for e in xml("xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in xml("xl/workbook.xml").iter(f"{_MAIN}sheet"):
            rows = []
            for row in xml(posixpath.normpath(posixpath.join("xl", targets[sheet.get(_LINK)])).lstrip("/").removeprefix("xl/xl/")).iter(f"{_MAIN}row"):
                cells: dict[int, str] = {}
                for c in row.iter(f"{_MAIN}c"):
                    value = c.find(f"{_MAIN}v")
                    raw = text(c) if c.get("t") == "inlineStr" else "" if value is None else value.text or ""
                    cells[_column(c.get("r")) if c.get("r") else len(cells)] = shared[int(raw)] if c.get("t") == "s" and raw else raw
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out.append((sheet.get("name") or "", [r for r in rows if any(c.strip() for c in r)]))
        return out


def table_text(tables: list[tuple[str, list[list[str]]]], rows: int = ROWS) -> tuple[str, bool]:
    """``column: value | column: value`` a row, empty cells left out, names of sheets as headings; and whether rows are missing."""
    parts, cut = [], False
    for name, table in tables:
        head, body = (table[0], table[1:]) if table else ([], [])
        cut |= len(body) > rows
        lines = [" | ".join(f"{h}: {v}" for h, v in zip(head, r) if v.strip()) for r in body[:rows]]
        parts.append("\n".join(([f"# {name}"] if name else []) + lines))
    return "\n\n".join(parts), cut


def _with_reader(files: DataFrame, read: Callable[[bytes], tuple[str, bool]]) -> DataFrame:
    """path, format, text, truncated; a file that its reader can't read has a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(whole.num_rows):
                b = whole.slice(k, 1)
                try:
                    text, cut = read(b.column("content")[0].as_py() or b"")
                except Exception:  # broken files are data, whatever a reader makes of them
                    text, cut = None, False
                yield pa.RecordBatch.from_arrays([b.column("path"), b.column("format"), pa.array([text], pa.string()), pa.array([cut])], ["path", "format", "text", "truncated"])

    return files.select("path", "format", "content").mapInArrow(run, "path string, format string, text string, truncated boolean")


def json_documents(files: DataFrame) -> DataFrame:
    """Articles by their known fields, flat records field by field; of other structures all strings in order."""
    parsed = json_text(files.withColumn("json", decoded(F.col("content"))), "json").drop("content")
    known = F.arrays_overlap(F.json_object_keys("json"), F.array(*map(F.lit, TEXT_FIELDS)))
    other = ~F.coalesce(known, F.lit(False)) & F.col("json").rlike("[:\\[,]\\s*[\\[{]|^\\s*\\[")
    parsed = parsed.withColumn("other", other)
    leaves = string_leaves(parsed.where("other").select("path", "json"), "json")
    said = leaves.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "leaf"))), lambda x: x["leaf"]), "\n").alias("said"))
    return parsed.join(said, "path", "left").withColumn("text", F.when(F.col("other"), F.col("said")).otherwise(F.col("text")))


def documents(files: DataFrame, readers: dict[str, Reader] | None = None) -> DataFrame:
    """path, format, text, truncated of ``files`` (path, content); formats that aren't read at all go."""
    known = files.withColumn("format", T.format_of(F.col("path"))).where(F.col("format").isNotNull())
    plain = known.where(F.col("format").isin("md", "html"))
    whole = decoded(F.col("content"))
    parts = [plain.select("path", "format", F.when(F.col("format") == "html", markdown(whole)).otherwise(whole).alias("text"), F.lit(False).alias("truncated"))]
    parts.append(json_documents(known.where("format = 'json'")).select("path", "format", "text", F.lit(False).alias("truncated")))
    own: dict[str, Callable[[bytes], tuple[str, bool]]] = {"csv": lambda c: table_text(delimited(c)), "xlsx": lambda c: table_text(spreadsheet(c))}
    own |= {name: (lambda c, f=f: (f(c), False)) for name, f in (readers or {}).items()}
    parts += [_with_reader(known.where(F.col("format") == name), read) for name, read in own.items()]
    rest = known.where(~F.col("format").isin("md", "html", "json", *own))
    parts.append(rest.select("path", "format", F.lit(None).cast("string").alias("text"), F.lit(False).alias("truncated")))
    return reduce(DataFrame.unionByName, parts)
