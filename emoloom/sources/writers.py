"""Sinks: CSV with a byte order mark, Parquet, JSON and Markdown reports, matrices."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def parquet(df: DataFrame, path: str, by: list[str] = ()) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def csv_with_bom(df: DataFrame, path: str) -> None:
    """CSV parts whose first field name starts with the mark U+FEFF, as spreadsheet programs want it."""
    first = df.columns[0]
    df.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").options(header="true", escape='"', quote='"', encoding="UTF-8").csv(path)


def _plain(x):
    """NumPy's and Spark's values as JSON knows them."""
    if hasattr(x, "item"):
        return x.item()
    if hasattr(x, "tolist"):
        return x.tolist()
    if hasattr(x, "asDict"):
        return x.asDict(recursive=True)
    return str(x)


def json_report(report: dict | DataFrame, path: str) -> None:
    """A report of bounded size; a table's rows become a list."""
    if isinstance(report, DataFrame):
        report = [r.asDict(recursive=True) for r in report.collect()]
    with open(path, "w", encoding="utf-8") as file:
        json.dump(report, file, ensure_ascii=False, indent=2, default=_plain)


def markdown_table(df: DataFrame, title: str = "") -> str:
    """A report table of bounded size as Markdown."""
    head = f"## {title}\n\n" if title else ""
    lines = [f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}"]
    for r in df.collect():
        lines.append("| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in r) + " |")
    return head + "\n".join(lines) + "\n"


def saved_matrix(values: DataFrame, path: str) -> None:
    """A matrix in long form or as vectors, as Parquet."""
    values.write.mode("overwrite").parquet(path)


def once(spark: SparkSession, path: str, make: Callable[[], DataFrame], key: str | None = None) -> DataFrame:
    """The table at ``path``; made and written where it isn't there.  With a
    ``key``, rows whose key is there already aren't made again."""
    from pyspark.errors import AnalysisException

    try:
        have = spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)
    if key is not None:
        make().join(have.select(key), key, "left_anti").write.mode("append").parquet(path)
        have = spark.read.parquet(path)
    return have


def as_json(df: DataFrame, out: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(out))
