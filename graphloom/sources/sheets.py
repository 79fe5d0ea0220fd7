"""XLSX sheets as tables, by the standard library.

Workbooks come through Spark's own binary file source, so they may lie wherever
Spark reads, in any number, and columns that aren't asked for are never made.  A
task walks one workbook's XML as a stream (cells of a row at a time; only the
shared strings are held) and gives its rows as text.  A file that can't be read
is an error that names it.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = 1000


def _strings(book: zipfile.ZipFile) -> list[str]:
    """The shared strings; runs of formatted text are one string, readings (rPh) are none."""
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out: list[str] = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, item in ElementTree.iterparse(f):
            if item.tag == _MAIN + "si":
                out.append(_text(item))
                item.clear()
    return out


def _text(item: ElementTree.Element) -> str:
    parts = [t.text or "" for child in item for t in ([child] if child.tag == _MAIN + "t" else child.findall(_MAIN + "t") if child.tag == _MAIN + "r" else [])]
    return re.sub(r"_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), "".join(parts))


def _sheet(book: zipfile.ZipFile, name: str | None) -> str:
    """The part that holds a sheet of that name, or the first one."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(_MAIN + "sheet"):
        if name in (None, s.get("name")):
            target = links[s.get(_LINK)]
            return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    raise ValueError(f"no sheet {name!r}")


def _column(reference: str) -> int:
    """0 for A, 26 for AA."""
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def rows_of(content: bytes, sheet: str | None = None) -> Iterator[list[str | None]]:
    """Rows of a workbook's sheet; cells that are empty are None, rows without any are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _strings(book)
        with book.open(_sheet(book, sheet)) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != _MAIN + "row":
                    continue
                cells: dict[int, str | None] = {}
                for at, c in enumerate(row.findall(_MAIN + "c")):
                    kind, v = c.get("t", "n"), c.find(_MAIN + "v")
                    inline = c.find(_MAIN + "is")
                    value = _text(inline) if inline is not None else None if v is None or v.text is None else v.text
                    if kind == "s" and value is not None:
                        value = shared[int(value)]
                    elif kind == "b":
                        value = {"1": "true", "0": "false"}.get(value or "", value)
                    elif kind == "e":
                        value = None
                    cells[_column(c.get("r")) if c.get("r") else at] = value
                row.clear()
                if any(v is not None for v in cells.values()):
                    yield [cells.get(k) for k in range(max(cells) + 1)]


def _read(path: str, content: bytes, sheet: str | None) -> Iterator[list[str | None]]:
    try:
        yield from rows_of(content, sheet)
    except Exception as e:  # zip, XML or layout: which file it is matters most
        raise ValueError(f"{path} can't be read as a workbook: {e!r}") from e


def read_xlsx(spark: SparkSession, path: str, sheet: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The columns of all workbooks at ``path`` (a file, folder or pattern) as text,
    with pos, a row's place in its file, and file.

    Names are those of the first row; a file that lacks one gives null there.
    columns: the ones wanted, by default those of the first workbook by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if columns is None:
        first = files.orderBy("path").limit(1).select("path", "content").mapInArrow(lambda b: _heads(b, sheet), "names array<string>").collect()
        columns = [c for c in (first[0].names if first else []) if c]
    wanted = list(dict.fromkeys(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held: list[list] = []
                at: list[int | None] | None = None
                for pos, row in enumerate(_read(file, content.as_py(), sheet)):
                    if at is None:
                        names = [(c or "").strip() for c in row]
                        at = [names.index(c) if c in names else None for c in wanted]
                        continue
                    held.append([file, pos, *(row[k] if k is not None and k < len(row) else None for k in at)])
                    if len(held) == ROWS:
                        yield _batch(held, wanted)
                        held = []
                if held:
                    yield _batch(held, wanted)

    schema = "file string, pos long" + "".join(f", `{c.replace('`', '``')}` string" for c in wanted)
    return files.select("path", "content").mapInArrow(run, schema).select(*[F.col(f"`{c.replace('`', '``')}`") for c in wanted], "pos", "file")


def _heads(batches: Iterator[pa.RecordBatch], sheet: str | None) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            names = [(c or "").strip() for c in next(_read(file, content, sheet), [])]
            yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.string()))], names=["names"])


def _batch(rows: list[list], wanted: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.string(), pa.int64(), *[pa.string()] * len(wanted)]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["file", "pos", *wanted])
