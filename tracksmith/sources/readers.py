"""Readers: file kinds by their ending, CSV, JSON, Parquet and spreadsheets, directories of spreadsheets, records."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from typing import Any
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import date_num, day_of_serial, iso, time_of_serial
from ..schema import TRUCK_POINTS, columns as schema_columns

# Endings and the kind of file they tell; columns of a truck sheet, in order.
KINDS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".xlsx": "excel", ".xls": "excel", ".parquet": "parquet"}
TRUCK_SHEET = ("code", "patent", "day", "hour", "lat", "lon", "direction", "commune", "velocity", "temperature", "temp2")


def kind_of(path: str) -> str:
    """The kind of a file, by its ending in any case."""
    ending = re.search(r"\.[^./\\]+$", path.rstrip("/").lower())
    if not ending or ending[0] not in KINDS:
        raise ValueError(f"Unsupported file type: {path}")
    return KINDS[ending[0]]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects or one object a line, told apart by the first character that is no space."""
    first = spark.read.text(path).select(F.ltrim("value").alias("v")).where("v <> ''").first()
    return spark.read.option("multiLine", bool(first and first.v.startswith("["))).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def _sheet_file(z: zipfile.ZipFile, sheet: str | None) -> str:
    """The part that holds a sheet (without a name, the first), by the workbook's relationships."""
    sheets = ElementTree.fromstring(z.read("xl/workbook.xml")).findall(".//m:sheet", _NS)
    names = [s.get("name") for s in sheets]
    if sheet is not None and sheet not in names:
        raise ValueError(f"no sheet {sheet!r} among {names}")
    at = names.index(sheet) if sheet is not None else 0
    if "xl/_rels/workbook.xml.rels" not in z.namelist():
        return f"xl/worksheets/sheet{at + 1}.xml"
    own = sheets[at].get(f"{{{_NS['r']}}}id")
    target = next(r.get("Target") or "" for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")) if r.get("Id") == own)
    return target.lstrip("/") if target.startswith("/") else f"xl/{target}"


def _old_sheet_rows(content: bytes, sheet: str | None) -> list[list[Any]]:
    """A sheet of the binary format of .xls, by pandas; that needs its reader, xlrd."""
    try:
        found = pd.read_excel(io.BytesIO(content), sheet_name=0 if sheet is None else sheet, header=None, dtype=object)
    except ImportError as e:
        raise ValueError("sheets of the old binary format need the package xlrd; save the file as .xlsx") from e
    return [[None if pd.isna(v) else v for v in row] for row in found.to_numpy(dtype=object).tolist()]


def sheet_rows(content: bytes, sheet: str | None = None) -> list[list[Any]]:
    """The cells of one sheet of a spreadsheet, as text or numbers; the first sheet unless one is named."""
    if not content.startswith(b"PK"):
        return _old_sheet_rows(content, sheet)
    ns = _NS
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        texts = []
        if "xl/sharedStrings.xml" in z.namelist():
            texts = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        out = []
        for row in ElementTree.fromstring(z.read(_sheet_file(z, sheet))).findall(".//m:row", ns):
            cells: list[Any] = []
            for c in row.findall("m:c", ns):
                letters = re.match(r"[A-Z]*", c.get("r") or "")[0]  # type: ignore[index]
                place = 0
                for ch in letters:
                    place = place * 26 + ord(ch) - 64
                cells += [None] * (place - 1 - len(cells))
                value = c.find("m:v", ns)
                if c.get("t") == "s" and value is not None:
                    cells.append(texts[int(value.text)])  # type: ignore[arg-type]
                elif c.get("t") == "inlineStr":
                    cells.append("".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")))
                else:
                    cells.append(None if value is None else value.text)
            out.append(cells)
    return out


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, header: bool = True, columns: tuple[str, ...] | None = None, drop_last_row: bool = False) -> DataFrame:
    """Sheets as text columns, with `_path` and `_row`. A sheet is a file's unit: each is parsed by one task."""
    if columns is None:

        def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield pd.DataFrame({"names": [[str(c) for c in (sheet_rows(bytes(x), sheet)[:1] or [[]])[0]] for x in batch.content]})

        first = spark.read.format("binaryFile").load(path).select("content").limit(1).mapInPandas(heads, "names array<string>").first() if header else None
        columns = tuple(first.names) if first else ()
    n = len(columns)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch.path, batch.content, strict=True):
                rows = sheet_rows(bytes(content), sheet)[1 if header else 0 :]
                rows = rows[:-1] if drop_last_row else rows
                cells = [[None if v is None else str(v) for v in [*r, *[None] * n][:n]] for r in rows]
                yield pd.DataFrame([[file, i, *c] for i, c in enumerate(cells)], columns=["_path", "_row", *columns], dtype=object)

    schema = "_path string, _row long" + "".join(f", `{c}` string" for c in columns)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, schema)


def read_truck_sheets(spark: SparkSession, path: str, sheet: str = "Hoja1", drop_last_row: bool = False) -> DataFrame:
    """Truck points from sheets of eleven columns. Files whose name holds $ or ~ are skipped; days are serials or "d-m-Y"."""
    files = read_excel(spark, path, sheet, True, TRUCK_SHEET, drop_last_row).where(~F.rlike(F.element_at(F.split("_path", "/"), -1), F.lit(r"[$~]|%24|%7E")))
    day = F.when(F.rlike("day", F.lit(r"^\d+-\d+-\d+$")), day_of_serial("day").cast("timestamp")).otherwise(time_of_serial(F.floor(F.col("day").try_cast("double"))))
    hour = F.col("hour").try_cast("double")
    ts = F.timestamp_micros(F.unix_micros(day) + F.round((hour - F.floor(hour)) * 86_400).cast("long") * 1_000_000)
    number = lambda c: F.col(c).try_cast("double").alias(c)
    rows = files.withColumn("ts", ts).select(
        F.col("code").alias("truckId"), F.date_format("ts", "HH:mm:ss").alias("time"), number("velocity"), number("lat"), number("lon"), date_num("ts").alias("dateNum"),
        "patent", "direction", number("temperature"), "commune", iso("ts").alias("timestamp"), "ts", F.col("_row").alias("seq"),
    )
    return rows.select(schema_columns(TRUCK_POINTS))


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """The file or folder, by its kind; any URI that Spark reads will do."""
    readers = {"csv": read_csv, "json": read_json, "parquet": read_parquet, "excel": lambda s, p: read_excel(s, p).drop("_path", "_row")}
    return readers[kind_of(path)](spark, path)


def from_records(spark: SparkSession, records: list[dict[str, Any]] | dict[str, Any]) -> DataFrame:
    """Records of a request: one object or a list of them, of any shape, through JSON."""
    given = [records] if isinstance(records, dict) else list(records)
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in given]))
