"""A training corpus from documents: toxicity, near-duplicates, benchmark leaks, source mix, packed tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilframe.llm import decontaminate, jaccard, mixing, packing, toxicity
from veilframe.llm.common import table, written
from veilframe.llm.queries import MIX_WEIGHTS, vocabulary

#: Near copies have this share of word shingles of this width in common.
NEAR_WORDS, NEAR_PERCENT = 5, 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs.select(*COLUMNS), model)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs.select(*COLUMNS), width=NEAR_WORDS, numerator=NEAR_PERCENT, denominator=100)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs.select(*COLUMNS), MIX_WEIGHTS).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.tiktoken"))


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", remove_leaks),
    ("source mix", mix),
    ("packed token ids", pack),
]

#: No SQL: the classifier, edit distances and token ids are beyond it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; what each stage keeps is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
