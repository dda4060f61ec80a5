"""A corpus pipeline of five stages, each by one operator of ``bandscope.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last
return the columns of ``documents``; their decisions take effect: documents that
fail the quality rules go, one document of each near-duplicate group stays,
documents with benchmark passages go, secrets are masked in the text (``n_chars``
follows it). The last stage encodes what is left.

Defined edge cases are those of the operators: null and empty texts fail the
quality rules; an empty table gives an empty result; additional columns pass
through the filtering stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandscope.llm import bpe, decontaminate, neardup, quality, secrets
from bandscope.llm.common import read_table, stored
from bandscope.llm.registry import QUALITY_VOCABULARIES, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.assess(docs, [tokenizer_file(x) for x in QUALITY_VOCABULARIES[:1]], keep=docs.columns, only_kept=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(docs, read_table(spark, sf_dir, "benchmark"), keep=docs.columns, only_clean=True)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    masked = secrets.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(docs, tokenizer_file("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("encoding", encoding),
]

#: SQL can't express the tokenisers of the first and last stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; between them the rows are written to the shared folder and reread."""
    docs = before = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
