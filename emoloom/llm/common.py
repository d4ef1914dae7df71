"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import spread

_SHIPPED: set[str] = set()
_TABLES: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rows_of(df: DataFrame, **columns) -> DataFrame:
    """Some columns of a table, a small one's rows spread over all cores before
    Python reads them."""
    return spread(df.select(*(c.alias(k) for k, c in columns.items())))


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the Python workers of every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp()) / f"{root.name}.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, spark.checkpoint.dir; on one machine a
    temporary one where it is unset (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="emoloom-") if sc.applicationId not in _OWN else "")


_OWN: dict[str, str] = {}


def cut(df: DataFrame, what: str = "stage") -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: the
    lineage ends there, and a lost executor loses nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/emoloom-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _TABLES:
        atexit.register(_drop_tables)
    _TABLES.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _drop_tables() -> None:
    for spark, path in _TABLES:
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session is gone: the folder belongs to the cluster
            pass


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """Where a public vocabulary file lies; ``folder`` is a parameter, with
    TOKENIZER_DIR and /opt/tokenizers after it."""
    return os.path.join(folder or os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), name)


_KEPT: dict[str, object] = {}


def kept(key: str, make):
    """``make()``, once in each Python worker for a key (a fresh one a query)."""
    if key not in _KEPT:
        while len(_KEPT) >= 4:
            _KEPT.pop(next(iter(_KEPT)))
        _KEPT[key] = make()
    return _KEPT[key]


def fresh_key() -> str:
    return uuid.uuid4().hex


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
