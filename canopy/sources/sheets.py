"""Workbooks (xlsx) as rows of text, parsed on executors, one task per group of files, a sheet streamed row by row."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.session import cut
from canopy.sources.event_files import _fs

# --- fixed values: names of the workbook format --------------------------------------------------
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
ROWS = 2000   # rows of a batch


def _text(element: ElementTree.Element) -> str:
    """All runs of text of an element; phonetic hints do not count."""
    return "".join(t.text or "" for part in element if part.tag != f"{MAIN}rPh" for t in part.iter(f"{MAIN}t"))


def _shared(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, e in ElementTree.iterparse(f):
            if e.tag == f"{MAIN}si":
                out.append(_text(e))
                e.clear()
    return out


def _sheet_file(book: zipfile.ZipFile, sheet: str | int) -> str:
    """Name inside the archive of a sheet, given by name or place."""
    sheets = [(e.get("name"), e.get(LINK)) for e in ElementTree.parse(book.open("xl/workbook.xml")).iter(f"{MAIN}sheet")]
    found = [link for i, (name, link) in enumerate(sheets) if sheet in (name, i)]
    if not found:
        raise ValueError(f"no sheet {sheet!r} among {[n for n, _ in sheets]}")
    targets = {e.get("Id"): e.get("Target") for e in ElementTree.parse(book.open("xl/_rels/workbook.xml.rels")).getroot()}
    target = targets[found[0]]
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def column_number(ref: str) -> int:
    """Place of a cell's column: A is 0, Z 25, AA 26."""
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _value(cell: ElementTree.Element, shared: list[str]) -> str | None:
    kind, v = cell.get("t"), cell.find(f"{MAIN}v")
    if kind == "inlineStr":
        inner = cell.find(f"{MAIN}is")
        return _text(inner) if inner is not None else None
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return "True" if v.text == "1" else "False"
    return None if kind == "e" else v.text


def sheet_rows(content: bytes, sheet: str | int = 0) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cells from the first column on) of the rows that hold anything."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = _shared(book)
        with book.open(_sheet_file(book, sheet)) as f:
            number = 0
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{MAIN}row":
                    continue
                number = int(e.get("r") or number + 1)
                cells: list[str | None] = []
                for i, c in enumerate(e.iter(f"{MAIN}c")):
                    at = column_number(c.get("r")) if c.get("r") else max(i, len(cells))
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = _value(c, shared)
                e.clear()
                if any(x not in (None, "") for x in cells):
                    yield number, cells


def read_sheet(spark: SparkSession, paths: list[str], sheet: str | int = 0) -> DataFrame:
    """Rows of one sheet of every workbook as text, columns named by each sheet's first row that holds anything; all names found
    become columns, in alphabetical order, after file and row. Absent, empty and error cells are null, blank rows are left out, of
    equal headers in a sheet the first one counts, columns without header do not; headers file and row get a _ behind them. A file that is no workbook, or has no such
    sheet, is an error that names it. Numbers are given as they are stored, dates as their serial numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, names = [], None
                try:
                    for number, cells in sheet_rows(content.as_buffer().to_pybytes(), sheet):
                        if names is None:
                            names = [(i, c.strip()) for i, c in enumerate(cells) if c and c.strip()]
                            names = [x for j, x in enumerate(names) if x[1] not in {n for _, n in names[:j]}]
                            continue
                        held.append((path, number, [(n, cells[i]) for i, n in names if i < len(cells) and cells[i] not in (None, "")]))
                        if len(held) == ROWS:
                            yield _batch(held)
                            held = []
                except (zipfile.BadZipFile, KeyError, ValueError, ElementTree.ParseError) as e:
                    raise ValueError(f"{path} is no readable workbook: {e}") from e
                yield _batch(held)

    def _batch(held: list) -> pa.RecordBatch:
        files, numbers, cells = zip(*held) if held else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(numbers, pa.int64()), pa.array(cells, pa.map_(pa.string(), pa.string()))], ["file", "row", "cells"])

    books = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(paths)
    rows = cut(books.select("path", "content").mapInArrow(run, "file string, row long, cells map<string,string>"), "sheet")
    names = sorted(r["n"] for r in rows.select(F.explode(F.map_keys("cells")).alias("n")).distinct().collect())
    shown = {n: f"{n}_" if n in ("file", "row") else n for n in names}
    return rows.filter(F.size("cells") > 0).select("file", "row", *[F.col("cells")[n].alias(shown[n]) for n in names])


def _column_name(i: int) -> str:
    name = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        name = chr(65 + r) + name
    return name


def write_sheets(df: DataFrame, path: str, name: str = "rows") -> None:
    """df's columns as text in one workbook per partition of df, below path: part-<n>.xlsx, header first. Strings are shared strings. A
    sheet holds 1,048,576 rows at most, so larger tables need more partitions."""
    columns = df.columns
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, strings, rows = TaskContext.get().partitionId(), {}, []
        for cells in [columns, *(r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(len(columns)))))]:
            at = [f'<c r="{_column_name(i)}{len(rows) + 1}" t="s"><v>{strings.setdefault(c, len(strings))}</v></c>' for i, c in enumerate(cells) if c is not None]
            rows.append(f'<row r="{len(rows) + 1}">{"".join(at)}</row>')
        out = io.BytesIO()
        main = MAIN[1:-1]
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
            book.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/sharedStrings.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sharedStrings+xml"/></Types>')
            book.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{LINK[1:-3]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            book.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{main}" xmlns:r="{LINK[1:-3]}"><sheets><sheet name="{escape(name)}" sheetId="1" r:id="rId1"/></sheets></workbook>')
            book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{LINK[1:-3]}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{LINK[1:-3]}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
            book.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{main}"><sheetData>{"".join(rows)}</sheetData></worksheet>')
            book.writestr("xl/sharedStrings.xml", f'<?xml version="1.0" encoding="UTF-8"?><sst xmlns="{main}">' + "".join(f'<si><t xml:space="preserve">{escape(s)}</t></si>' for s in strings) + "</sst>")
        yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}.xlsx"]), pa.array([out.getvalue()])], ["name", "content"])

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(path)
        fs.create_dir(root, recursive=True)
        for b in run(batches):
            with fs.open_output_stream(f"{root}/{b.column(0)[0].as_py()}") as f:
                f.write(b.column(1)[0].as_py())
            yield pa.RecordBatch.from_arrays([b.column(0)], ["name"])

    text.mapInArrow(save, "name string").write.format("noop").mode("overwrite").save()
