"""HTTP requests of traffic captures, as an outside dissector prints them."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.errors import DataSourceError, DependencyMissing, Unsupported
from veilframe.operators.sheet import ROW, number_rows

# Columns, and the dissector's fields they come from.
COLUMNS = ("frame_no", "src_ip", "dst_ip", "method", "host", "uri", "body", "user_agent")
FIELDS = ("frame.number", "ip.src", "ip.dst", "http.request.method", "http.host", "http.request.uri", "http.file_data", "http.user_agent")


def decoded_body(hexadecimal: Column) -> Column:
    """Text of a hex string: pairs that aren't hex and an odd last digit are skipped, invalid UTF-8 becomes U+FFFD."""
    pairs = F.regexp_extract_all(hexadecimal, F.lit("(?s).."), F.lit(0))
    clean = F.array_join(F.filter(pairs, lambda p: p.rlike("(?s)^[0-9A-Fa-f]{2}$")), "")
    return F.make_valid_utf8(F.unhex(clean).cast("string"))


def parse_lines(text: DataFrame) -> DataFrame:
    """The columns of tab-separated lines (column value); blank lines are skipped, missing fields empty."""
    parts = F.split("value", "\t", -1)
    get = lambda i: F.coalesce(F.get(parts, F.lit(i)), F.lit(""))
    rows = text.filter("trim(value) <> ''")
    return rows.select(*[(decoded_body(get(i)) if name == "body" else get(i)).alias(name) for i, name in enumerate(COLUMNS)])


def find_dissector(given: str | None = None) -> str:
    found = shutil.which(given or "tshark")
    if not found:
        raise DependencyMissing(f"{given or 'tshark'} is needed to read captures")
    return found


def read_pcap(spark: SparkSession, path: str, tshark: str | None = None) -> DataFrame:
    """HTTP requests of captures. Each task gives the bytes of a file to the dissector, which executors must have too."""
    program = find_dissector(tshark)

    def dissect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                with tempfile.NamedTemporaryFile(suffix=".pcap") as file:
                    file.write(data)
                    file.flush()
                    command = [program, "-q", "-r", file.name, "-Y", "http.request", "-T", "fields"]
                    for f in FIELDS:
                        command += ["-e", f]
                    try:
                        done = subprocess.run([*command, "-E", "separator=\t", "-E", "occurrence=f"], capture_output=True, check=False)
                    except OSError as e:
                        raise DependencyMissing(str(e)) from None
                error = done.stderr.decode("utf-8", "replace")
                if done.returncode:
                    raise Unsupported(error) if "valid" in error or "isn't a capture file" in error else DataSourceError(error)
                yield pa.RecordBatch.from_arrays([pa.array(done.stdout.decode("utf-8", "replace").splitlines(), pa.string())], ["value"])

    text = spark.read.format("binaryFile").load(path).select("content").mapInArrow(dissect, "value string")
    return number_rows(parse_lines(text), in_files=False)


def read_dissected(spark: SparkSession, path: str) -> DataFrame:
    """The same from tab-separated files that the dissector printed before; needs no outside program."""
    text = spark.read.option("lineSep", "\n").text(path).withColumn("value", F.regexp_replace(F.make_valid_utf8("value"), r"\r\z", ""))
    return number_rows(parse_lines(text), in_files=False).select(ROW, *COLUMNS)
