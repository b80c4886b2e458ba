"""Server logs: Apache combined and common, syslog, application logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.functions import regex
from veilframe.operators.sheet import ROW
from veilframe.sources.plain import lines

#: Non-empty lines that the format is told from.
PROBE_LINES = 10


@dataclass(frozen=True)
class LogFormat:
    name: str
    pattern: str
    fields: tuple[str, ...]


# Patterns and field names. Of formats that match equally often the later one holds.
FORMATS = (
    LogFormat(
        "combined",
        r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"',
        ("remote_host", "ident", "remote_user", "time_local", "request", "status", "body_bytes_sent", "http_referer", "http_user_agent"),
    ),
    LogFormat("common", r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-)$', ("remote_host", "ident", "remote_user", "time_local", "request", "status", "body_bytes_sent")),
    LogFormat("syslog", r"^(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w\-./]+)(?:\[(\d+)\])?:\s*(.*)$", ("timestamp", "host", "process", "pid", "message")),
    LogFormat(
        "app",
        r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+(INFO|WARN|ERROR|DEBUG|TRACE|FATAL|CRITICAL|NOTICE)\s*(?:\[([^\]]+)\])?\s*(.*)$",
        ("timestamp", "level", "thread", "message"),
    ),
)


def detect_format(probe: DataFrame) -> LogFormat | None:
    """The format that most of the probed lines (column value) have; None if no line has any."""
    counts = probe.select(*[F.count_if(F.col("value").rlike(regex.translate(f.pattern))).alias(f.name) for f in FORMATS]).first()
    best = max(FORMATS, key=lambda f: (counts[f.name], FORMATS.index(f)))
    return best if counts[best.name] else None


def parsed(text: Column, log: LogFormat) -> list[Column]:
    """Columns of a line; null where the line has another form, empty where an optional part is missing."""
    java = regex.translate(log.pattern)
    hit = text.rlike(java)
    columns = []
    for i, name in enumerate(log.fields, 1):
        value = F.regexp_extract(text, java, i)
        if name == "request":
            words = F.split(F.trim(value), r"\s+")
            for k, part in enumerate(("request_method", "request_url", "request_protocol")):
                columns.append(F.when(hit, F.when(F.size(words) == 3, words[k]).otherwise("")).alias(part))
            continue
        if name == "body_bytes_sent":
            value = F.when(value == "-", "0").otherwise(value)
        columns.append(F.when(hit, value).alias(name))
    return columns


def read_log(spark: SparkSession, path: str, log: LogFormat | None = None) -> DataFrame:
    """The fields of the detected (or given) format and raw_line; without a format one column, line."""
    rows = lines(spark, path)
    log = log or detect_format(spark.read.option("lineSep", "\n").text(path).filter("trim(value) <> ''").limit(PROBE_LINES).withColumn("value", F.regexp_replace("value", r"\r\z", "")))
    if log is None:
        return rows.withColumnRenamed("value", "line")
    return rows.select(ROW, *parsed(F.col("value"), log), F.col("value").alias("raw_line"))
