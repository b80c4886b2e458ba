"""Sources: files to sheets of string columns with dense row numbers."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

from veilframe.errors import Unsupported
from veilframe.sources import archive, logs, pcap, plain
from veilframe.sources import sql as sql_source

READERS: dict[str, Callable[..., DataFrame]] = {
    "csv": plain.read_csv,
    "json": plain.read_json,
    "jsonl": plain.read_json,
    "txt": plain.read_txt,
    "log": logs.read_log,
    "sql": sql_source.read_sql,
    "db": archive.read_sqlite,
    "sqlite": archive.read_sqlite,
    "sqlite3": archive.read_sqlite,
    "xlsx": archive.read_xlsx,
    "pcap": pcap.read_pcap,
    "pcapng": pcap.read_pcap,
}


def detect(path: str) -> str:
    """The format by suffix, in either case."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lstrip(".").lower()
    if suffix not in READERS:
        raise Unsupported(f"unknown format of {path}")
    return suffix


def load(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    """A file (or folder, or glob, of one format) as a sheet."""
    return READERS[format or detect(path)](spark, path, **options)
