"""Government exports: CSV with preambles in several encodings, and workbooks, to text rows with metadata.

Spark lists and reads the files and deals them to tasks; a task decodes one file at a time with the standard library.
"""

from __future__ import annotations

import csv
import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import COLUMN_ALIASES, COLUMN_MAP, ENCODINGS, OFFICETEL, ROW_HOUSE
from ..operators.ranks import small
from .scratch import keep

RAW = list(COLUMN_MAP)
RAW_OFFICETEL = [c for c in RAW if c != "주택유형"]
CELLS = "source_file string, source_sheet string, _sheet int, housing_category string, source_cond_gu string, source_cond_period string, _seq long, " + ", ".join(f"`{c}` string" for c in RAW)
INFO = ("source_file string, source_sheet string, _sheet int, encoding string, header_line_index int, header_inferred boolean, housing_category string, "
        "source_cond_gu string, source_cond_period string, n_rows long, n_repeated_header_rows int, ok boolean, error string")
SPREADSHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


class HeaderNotFound(ValueError):
    """No header, and no known number of columns."""


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the exports below `folder`; lock files of an open workbook don't count."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{csv,xlsx}").load(folder)
    return files.where(~F.element_at(F.split("path", "/"), -1).startswith("~$")).select("path", "content")


def decode(data: bytes) -> tuple[str, str]:
    """The text and the first encoding that reads all of it."""
    for name in ENCODINGS:
        try:
            return data.decode(name), name
        except UnicodeDecodeError:
            continue
    raise UnicodeError(f"none of {ENCODINGS} fits")


def is_header(cells) -> bool:
    return [str(c or "").strip().strip('"') for c in cells[:2]] == ["NO", "시군구"]


def conditions(lines) -> dict[str, str]:
    """`key : value` lines above a header."""
    found = {}
    for line in lines:
        key, colon, value = (line or "").strip().strip('"').partition(" : ")
        if colon:
            found[key.strip()] = value.strip()
    return found


def csv_rows(data: bytes) -> tuple[str, list[str], list[list[str]]]:
    """Encoding, the lines above the header, and the rows from the header on."""
    text, encoding = decode(data)
    lines = text.splitlines()
    at = next((i for i, line in enumerate(lines) if is_header(next(csv.reader([line]), []))), None)
    if at is None:
        raise HeaderNotFound(f"no header in {len(lines)} lines ({encoding})")
    return encoding, lines[:at], [r for r in csv.reader(io.StringIO("\n".join(lines[at:]))) if r]


def cell_text(value: str | None, kind: str | None, shared: list[str]) -> str:
    """A workbook cell as a CSV would show it: 1.0 as 1."""
    if value is None:
        return ""
    if kind == "s":
        return shared[int(value)]
    if kind in (None, "n"):
        try:
            return str(int(float(value))) if float(value).is_integer() else value
        except ValueError:
            return value
    return value


def sheets(data: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """Name and non-blank rows of each sheet of a workbook."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in x.iter(f"{SPREADSHEET}t")) for x in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{SPREADSHEET}sheet"):
            target = targets[sheet.get(f"{RELATION}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(book.read(target if target in names else posixpath.join("xl", target))).iter(f"{SPREADSHEET}row"):
                cells: list[str] = []
                for c in row.iter(f"{SPREADSHEET}c"):
                    column = 0
                    for letter in (x for x in c.get("r", "") if x.isalpha()):
                        column = column * 26 + ord(letter) - 64
                    cells += [""] * (column - 1 - len(cells))
                    if c.get("t") == "inlineStr":
                        cells.append("".join(t.text or "" for t in c.iter(f"{SPREADSHEET}t")))
                    else:
                        value = c.find(f"{SPREADSHEET}v")
                        cells.append(cell_text(None if value is None else value.text, c.get("t"), shared))
                if any(x.strip() for x in cells):
                    rows.append(cells)
            yield sheet.get("name"), rows


def sheet_frame(rows: list[list[str]]) -> tuple[list[str], list[list[str]], dict, int | None, int]:
    """(columns, body, conditions, header line or None if inferred, header rows repeated in the body)."""
    at = next((i for i, r in enumerate(rows) if is_header(r)), None)
    if at is not None:
        header, body, found = [h.strip() for h in rows[at]], rows[at + 1 :], conditions(r[0] for r in rows[:at] if r)
    else:
        wide = max(map(len, rows), default=0)
        first = [*rows[0], "", ""] if rows else ["", ""]
        header = {len(RAW): RAW, len(RAW_OFFICETEL): RAW_OFFICETEL}.get(wide)
        if not (first[0].isdigit() and first[1].startswith(("서울", "경기", "인천")) and header):
            raise HeaderNotFound(f"no header, and {wide} columns say nothing")
        body, found = rows, {}
    again = sum(map(is_header, body))
    body = [(r + [""] * len(header))[: len(header)] for r in body if not is_header(r)]
    return header, body, found, at, again


def standard_columns(header: list[str], hint: str) -> tuple[list[str], str]:
    """Names after aliases, and the category; raises if a required column is missing."""
    names = [COLUMN_ALIASES.get(h, h) for h in header]
    category = OFFICETEL if "주택유형" not in names or OFFICETEL in hint else ROW_HOUSE
    missing = [c for c in RAW_OFFICETEL if c not in names]
    if missing:
        raise HeaderNotFound(f"missing columns: {missing}")
    return names, category


def tables_of(path: str, data: bytes) -> Iterator[tuple[dict, list[dict]]]:
    """(facts, rows) of each table of a file; a table that can't be read has ok false and no rows."""
    name = unquote(path.rsplit("/", 1)[-1])
    try:
        if name.lower().endswith(".csv"):
            encoding, above, rows = csv_rows(data)
            found = [(None, encoding, [*[[x] for x in above], *rows])]
        else:
            found = [(sheet, "xlsx", rows) for sheet, rows in sheets(data)]
    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
        yield {"source_file": path, "_sheet": 0, "ok": False, "error": str(e)}, []
        return
    for i, (sheet, encoding, rows) in enumerate(found):
        facts = {"source_file": path, "source_sheet": sheet, "_sheet": i, "encoding": encoding, "ok": True}
        try:
            header, body, cond, at, again = sheet_frame(rows)
            names, category = standard_columns(header, cond.get("실거래구분", "") + (sheet or "") + name)
        except HeaderNotFound as e:
            yield facts | {"ok": False, "error": str(e)}, []
            continue
        facts |= {"header_line_index": at, "header_inferred": at is None, "housing_category": category, "n_rows": len(body), "n_repeated_header_rows": again,
                  "source_cond_gu": cond.get("시군구"), "source_cond_period": cond.get("계약일자")}
        where = {c: names.index(c) for c in RAW if c in names}
        yield facts, [{c: r[where[c]] if c in where else OFFICETEL for c in RAW} for r in body]


def _names(schema: str) -> list[str]:
    return [c.rsplit(" ", 1)[0].strip("`") for c in schema.split(", ")]


#: What is read of a file: a row for each table with its facts (`_seq` NULL), and the rows of the table.
PARSED = CELLS + ", " + ", ".join(c for c in INFO.split(", ") if c.split()[0] not in _names(CELLS))


def parsed(files: DataFrame) -> DataFrame:
    """Facts and rows of all tables, from one decoding of each file."""
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[c.rsplit(" ", 1)[1]]) for name, c in zip(_names(PARSED), PARSED.split(", "))])
    own = ("source_file", "source_sheet", "_sheet", "housing_category", "source_cond_gu", "source_cond_period")

    def run(batches):
        for batch in batches:
            for path, data in zip(batch.column("path"), batch.column("content")):
                for facts, body in tables_of(path.as_py(), data.as_py()):
                    yield pa.RecordBatch.from_pylist([facts], schema=schema)
                    told = {c: facts.get(c) for c in own}
                    for at in range(0, len(body), PARSED_ROWS):
                        yield pa.RecordBatch.from_pylist([{**r, **told, "_seq": at + i} for i, r in enumerate(body[at : at + PARSED_ROWS])], schema=schema)

    return files.select("path", "content").repartition("path").mapInArrow(run, PARSED)


#: Rows that a task hands on at once.
PARSED_ROWS = 50_000


def table_facts(found: DataFrame) -> DataFrame:
    """One row per table of `parsed`: what was found, and errors; tables are numbered in the order of file and sheet."""
    facts = found.where("_seq IS NULL").select(*_names(INFO))  # a row per table: few enough for one ordering
    return facts.withColumn("source_table_id", F.row_number().over(Window.orderBy("source_file", "_sheet")) - 1)


def load_all(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, tables) of all exports below `folder`; unreadable tables keep their number and give no rows.

    What was read is written once to the shared folder, and both come from there.
    """
    found, _ = keep(parsed(discover(spark, folder)))
    tables = table_facts(found)
    seen = tables.agg(F.count("*"), F.count_if("ok")).first()
    if not seen[0]:
        raise FileNotFoundError(f"no exports in {folder}")
    if not seen[1]:
        raise RuntimeError("no table could be read")
    ids = tables.select("source_file", "_sheet", "source_table_id")
    rows = found.where("_seq IS NOT NULL").select(*[f"`{c}`" for c in _names(CELLS)])
    return rows.join(small(ids), ["source_file", "_sheet"]).drop("_sheet"), tables


def header_line(lines: DataFrame, key: str, at: str = "line_no", line: str = "line", first: str = "NO", second: str = "시군구") -> DataFrame:
    """(key, header_at): the first line of each text whose first two fields are the header's; NULL if none is."""
    fields = F.split(F.col(line), ",")
    bare = [F.trim(F.replace(F.get(fields, F.lit(i)), F.lit('"'), F.lit(""))) for i in (0, 1)]
    return lines.groupBy(key).agg(F.min(F.when((bare[0] == first) & (bare[1] == second), F.col(at))).alias("header_at"))


def condition_map(lines: Column) -> Column:
    """A map of the `key : value` entries in an array of lines; the last of equal keys counts."""
    pairs = F.filter(lines, lambda x: F.instr(x, " : ") > 0)
    entries = F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, " : ", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, " : ") + 3, F.length(x))).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)
