"""SQL scripts as a source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.operators.sheet import ROW, number_rows
from veilframe.plans.script import ScriptRunner
from veilframe.sources.plain import require_utf8


def read_sql(spark: SparkSession, path: str) -> DataFrame:
    """The result of a script's queries as a sheet of strings. The script is a program, so the driver reads it whole; its queries run as Spark SQL."""
    require_utf8(spark, path)
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    result = ScriptRunner(spark).script(text).result
    if result is None:
        return spark.createDataFrame([], f"{ROW} long")
    return number_rows(result, in_files=False)
