"""The same rules on streams. Rule columns are stateless, so they run on a stream as they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.functions.masking import mask
from veilframe.operators.extract import extract
from veilframe.operators.sheet import ROW
from veilframe.plans.rules import Rule


def mask_stream(stream: DataFrame, rules: dict[str, Rule | None]) -> DataFrame:
    """The stream with the named columns masked."""
    return stream.withColumns({c: mask(F.col(f"`{c}`"), r) for c, r in rules.items()})


def extract_stream(stream: DataFrame, column: str, rules: Sequence[Rule], key: str) -> DataFrame:
    """Candidates found in a stream's text column; `key` names the row they come from (source_row)."""
    return extract(stream.select(F.col(key).alias(ROW), column), column, rules)


def finds_by_window(stream: DataFrame, time: str, column: str, rules: Sequence[Rule], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Valid finds by type and time window; rows later than `late` behind the watermark don't count."""
    marked = stream.withWatermark(time, late)
    found = extract(marked.select(F.col(time).alias(ROW), column), column, rules).filter("valid")
    return found.groupBy(F.window("source_row", window).alias("window"), "type_label").agg(F.count(F.lit(1)).alias("finds")).select(F.col("window.start").alias("start"), "type_label", "finds")
