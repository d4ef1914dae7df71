"""Scans: CSV, workbooks, word lists, lexicons, JSON, and a probe of encodings."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.lexicons import precomposed
from ..schema import HARMONISED

_CSV = {"header": "true", "multiLine": "true", "escape": '"', "quote": '"'}


def csv_inferred(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file with a header; types are inferred unless given, bad rows fail."""
    reader = spark.read.options(**_CSV, mode="FAILFAST")
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", "true").csv(path)


def csv_with_nullable_ids(spark: SparkSession, path: str, schema: T.StructType = HARMONISED) -> DataFrame:
    """The harmonised CSV: ids may be missing, missing splits are NONE, missing domain and topic empty."""
    return spark.read.options(**_CSV, mode="FAILFAST").schema(schema).csv(path).fillna({"source_split": "NONE", "domain": "", "topic": ""})


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _sheet(data: bytes, sheet: str | None) -> Iterator[list[str | None]]:
    """The rows of a workbook's sheet (the first where none is named) as text."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        names = {s.get("name"): s.get(_REL) for s in book.iterfind("m:sheets/m:sheet", _NS)}
        if sheet is not None and sheet not in names:
            raise ValueError(f"no sheet {sheet!r}; there are {', '.join(names)}")
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = targets[names[sheet] if sheet is not None else next(iter(names.values()))].lstrip("/")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        root = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
        for row in root.iterfind("m:sheetData/m:row", _NS):
            cells: dict[int, str | None] = {}
            for c in row.iterfind("m:c", _NS):
                at = 0
                for letter in re.match(r"[A-Z]+", c.get("r", "A"))[0]:
                    at = at * 26 + ord(letter) - 64
                value = c.find("m:v", _NS)
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
                else:
                    text = None if value is None else value.text
                    if c.get("t") == "s" and text is not None:
                        text = shared[int(text)]
                cells[at - 1] = text
            yield [cells.get(k) for k in range(max(cells) + 1)] if cells else []


class _Workbook(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.path, self.sheet = schema, options["path"], options.get("sheet")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]  # a sheet is one stream of XML

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as file:
            rows = _sheet(file.read(), self.sheet)
        header = next(rows, [])
        places = {name: k for k, name in enumerate(header)}
        for row in rows:
            out = []
            for f in self.schema.fields:
                k = places.get(f.name)
                text = row[k] if k is not None and k < len(row) else None
                if text is not None and not isinstance(f.dataType, T.StringType):
                    text = int(float(text)) if isinstance(f.dataType, (T.LongType, T.IntegerType)) else float(text)
                out.append(text)
            yield tuple(out)


class ExcelSource(DataSource):
    """``spark.read.format("excel")``: options ``path`` and ``sheet``; a header row names the columns."""

    @classmethod
    def name(cls) -> str:
        return "excel"

    def schema(self) -> T.StructType:
        with open(self.options["path"], "rb") as file:
            header = next(_sheet(file.read(), self.options.get("sheet")), [])
        return T.StructType([T.StructField(h or f"_c{k}", T.StringType()) for k, h in enumerate(header)])

    def reader(self, schema: T.StructType) -> _Workbook:
        return _Workbook(schema, dict(self.options))


def excel(spark: SparkSession, path: str, sheet: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A sheet of a workbook on a path that all executors see."""
    spark.dataSource.register(ExcelSource)
    reader = spark.read.format("excel").option("path", path)
    if sheet is not None:
        reader = reader.option("sheet", sheet)
    return (reader.schema(schema) if schema is not None else reader).load()


def word_list(spark: SparkSession, path: str, normalise: bool = False) -> list[str]:
    """The entries of a word list, in its order: blank lines and those that start with # are skipped."""
    rows = spark.read.text(path, wholetext=True).select("value").collect()
    entries = [line.strip() for r in rows for line in r.value.splitlines()]
    entries = [e for e in entries if e and not e.startswith("#")]
    return list(dict.fromkeys(precomposed(e) if normalise else e for e in entries))


def polarity_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(word, polarity): each line parted at its last blank; pos and neg, any case, others left out."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '#')")
    parts = lines.select(F.trim(F.regexp_extract("line", r"^(.*\S)\s+(\S+)$", 1)).alias("word"), F.lower(F.regexp_extract("line", r"^(.*\S)\s+(\S+)$", 2)).alias("polarity"))
    return parts.where("word <> '' and polarity in ('pos', 'neg')").distinct()


def json_config(path: str) -> dict:
    """A small JSON file of settings: thresholds, orders, lexicons."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def encoding_probe(spark: SparkSession, path: str, encodings: tuple[str, ...] = ("utf-8", "utf-8-sig", "latin-1", "cp1252")) -> DataFrame:
    """(path, bytes, encoding, readable): which encodings each file decodes under."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), "content")

    def probe(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for p, n, content in zip(pdf["path"], pdf["bytes"], pdf["content"]):
                for e in encodings:
                    try:
                        bytes(content).decode(e)
                        out.append((p, n, e, True))
                    except UnicodeDecodeError:
                        out.append((p, n, e, False))
            yield pd.DataFrame(out, columns=["path", "bytes", "encoding", "readable"])

    return files.mapInPandas(probe, "path string, bytes long, encoding string, readable boolean")
