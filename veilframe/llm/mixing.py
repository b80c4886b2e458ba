"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate (its target share of the output over its own size). A
document's number of copies is that rate's Poisson distribution inverted at a number in [0, 1)
hashed from seed and document id; the copies are then dealt out by a hash, which shuffles them
globally. Everything runs on built-in functions; the text moves once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import unit_hash

#: The Poisson table of one draw covers rates up to this; a larger rate is the sum of several draws.
DRAW_RATE = 32.0
#: Tables of more sources than this are joined by a salted shuffle, not broadcast.
BROADCAST_SOURCES = 5000
SALTS = 16


def _draws(rate: Column) -> Column:
    return F.greatest(F.ceil(rate / DRAW_RATE), F.lit(1)).cast("int")


def _cumulative(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until the rest is below the steps of a double."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    first = F.exp(-rate)

    def step(acc: Column, k: Column) -> Column:
        term = acc["term"] * rate / k
        total = acc["total"] + term
        return F.struct(term.alias("term"), total.alias("total"), F.concat(acc["table"], F.array(total)).alias("table"))

    start = F.struct(first.alias("term"), first.alias("total"), F.array(first).alias("table"))
    return F.aggregate(F.sequence(F.lit(1), last), start, step)["table"]


def source_key(source: Column) -> Column:
    """Null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def repetition_rates(
    docs: DataFrame, weights: dict[str | None, float], default_weight: float = 1.0, target_rows: int | None = None, source_col: str = "source"
) -> tuple[DataFrame, int]:
    """One row per source: _key, rows, rate; and the number of sources. Weights count relative to each other over the sources present; a weight of 0 removes a source."""
    if default_weight < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    key = source_key(F.col(source_col))
    sizes = docs.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("rows"))
    named = {("null" if k is None else f"s:{k}"): float(w) for k, w in weights.items()}
    weight = F.lit(float(default_weight))
    if named:
        table = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
        weight = F.coalesce(table[F.col("_key")], weight)
    sizes = sizes.withColumn("_weight", weight)
    weights_sum, rows_sum, sources = sizes.agg(F.sum("_weight"), F.sum("rows"), F.count(F.lit(1))).first()
    wanted = float(rows_sum or 0) if target_rows is None else float(target_rows)
    share = F.col("_weight") / F.lit(weights_sum) if weights_sum else F.lit(0.0)
    return sizes.select("_key", "rows", (F.lit(wanted) * share / F.col("rows")).alias("rate")), sources


def mix_sources(
    docs: DataFrame, weights: dict[str | None, float], default_weight: float = 1.0, target_rows: int | None = None, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source"
) -> DataFrame:
    """docs with each row repeated by its Poisson count, in hash order, plus copy (1, 2, ...) and shuffle_key.

    Expected rows: target_rows (as many as docs has, by default), divided among the sources by weight.
    A source of weight 0 gives no rows. Null sources form one source; null texts are kept as rows.
    Rows with equal ids draw equal counts and keep their own columns. An empty table gives an empty
    result. Input columns named copy or shuffle_key are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    names = docs.columns
    rates, sources = repetition_rates(docs, weights, default_weight, target_rows, source_col)
    rates = rates.select(
        "_key", _draws(F.col("rate")).alias("_draws"), _cumulative(F.col("rate") / _draws(F.col("rate"))).alias("_table")
    )
    own, source = f"c{names.index(id_col)}", f"c{names.index(source_col)}"  # columns go by numbers here, so that no name clashes
    keyed = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("_key", source_key(F.col(source)))
    if sources <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(rates), "_key")
    else:  # many sources: each one's table goes to SALTS tasks, so that a large source is dealt over them
        salted = rates.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        joined = keyed.withColumn("_salt", F.pmod(F.xxhash64(own), F.lit(SALTS)).cast("int")).join(salted, ["_key", "_salt"]).drop("_salt")

    def draw(k: Column) -> Column:
        at = unit_hash(F.lit(seed), F.lit("count"), F.col(own), k)
        return F.size(F.filter("_table", lambda c: c <= at))

    first = draw(F.lit(1))
    count = F.when(F.col("_draws") == 1, first).otherwise(F.aggregate(F.sequence(F.lit(1), F.col("_draws")), F.lit(0), lambda a, k: a + draw(k)))
    copies = joined.withColumn("_count", count).filter("_count > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_count"))))
    copies = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.coalesce(F.col(own).cast("string"), F.lit("")), F.col("copy")).cast("binary")))
    shuffled = copies.drop("_key", "_draws", "_table", "_count").repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    return shuffled.select(*[f"c{i}" for i in range(len(names))], "copy", "shuffle_key").toDF(*names, "copy", "shuffle_key")
