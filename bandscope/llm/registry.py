"""Queries of the training-data operators and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html_text, langid, neardup, packing, pii, quality, secrets, substrings, toxicity, whitening
from .common import crc_mod, read_table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict(docs, crc_mod("doc_id", 4) == 2).select("doc_id", "held_out", "lang_pred", "score")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.find_overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


#: The first vocabulary is judged, the others are measured beside it.
QUALITY_VOCABULARIES = ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(quality.assess(read_table(spark, sf_dir, "documents"), [tokenizer_file(x) for x in QUALITY_VOCABULARIES]))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract of this query takes four words, the operator's default is five."""
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), size=4)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    scored = toxicity.predict(docs, labels, lambda doc_id: crc_mod(doc_id, 3) == 1)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digests(whitening.whiten(read_table(spark, sf_dir, "embeddings")))


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op5_secrets``, which SQL can express."""
    return op5_secrets(spark, sf_dir).drop("spans")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op6_quality``, which SQL can express."""
    return op6_quality(spark, sf_dir).drop("kept")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of ``op9_pii``, which SQL can express."""
    return op9_pii(spark, sf_dir).drop("spans")


def whitening_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op12_whitening`` that SQL can express."""
    return op12_whitening(spark, sf_dir).where("component = 1").select("vec_id", "n", "deviation")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_langid": op2_langid,
    "op3_decontaminate": op3_decontaminate,
    "op4_substrings": op4_substrings,
    "op5_secrets": op5_secrets,
    "op6_quality": op6_quality,
    "op7_html": op7_html,
    "op8_neardup": op8_neardup,
    "op9_pii": op9_pii,
    "op10_toxicity": op10_toxicity,
    "op11_packing": op11_packing,
    "op12_whitening": op12_whitening,
    "secrets_base": secrets_base,
    "quality_base": quality_base,
    "pii_base": pii_base,
    "whitening_base": whitening_base,
}

ORACLE_SQL: dict[str, str] = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op4_substrings": substrings.ORACLE,
    "op8_neardup": neardup.ORACLE,
    "secrets_base": secrets.BASE_ORACLE,
    "quality_base": quality.BASE_ORACLE,
    "pii_base": pii.BASE_ORACLE,
    "whitening_base": whitening.BASE_ORACLE,
}
