"""Emission, truth and cell views over the general test tables, in Spark and in DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import channel_at


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One emission for each event. Queries that read it several times, or join it on inequalities, stage it first."""
    return as_emissions(table(spark, sf_dir, "events"))


def as_emissions(e: DataFrame) -> DataFrame:
    """The emission that each row of ``events`` stands for; rows alone decide, so a stream of them will do."""
    k = F.coalesce(F.regexp_extract("props", r"(\d+)", 1).cast("bigint"), F.lit(0))
    f = F.lit(446_006_250.0) + F.pmod(k, F.lit(20)) * 12_500.0 + (F.pmod(F.col("event_id"), F.lit(7)) - 3) * 900.0
    u = F.pmod(F.col("user_id"), F.lit(6))
    return e.select(
        F.col("event_id").alias("row_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("timestamp"),
        f.alias("frequency_hz"),
        channel_at(f).alias("pmr_channel"),
        (1 + 20 * F.col("value")).alias("duration_s"),
        (-F.col("value")).alias("peak_power_dbfs"),
        (F.pmod(F.col("event_id"), F.lit(50)) * 1.0).alias("snr_db"),
        F.when(u != 5, 67 + 3.5 * u).alias("ctcss_tone_hz"),
        F.col("user_id").alias("source_id"),
        F.col("event_type").alias("kind"),
    )


EM = """em AS MATERIALIZED (
  SELECT *, CASE WHEN abs(frequency_hz - (446006250e0 + 12500e0 * kk)) <= 2000e0 AND kk BETWEEN 0 AND 15 THEN CAST(kk AS INTEGER) + 1 END AS pmr_channel FROM (
    SELECT *, round_even((frequency_hz - 446006250e0) / 12500e0, 0) AS kk FROM (
      SELECT event_id AS row_id, epoch_us(ts) / 1e6 AS timestamp,
        446006250e0 + (coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 0) % 20) * 12500e0 + ((event_id % 7) - 3) * 900e0 AS frequency_hz,
        1e0 + 20e0 * value AS duration_s, -value AS peak_power_dbfs, (event_id % 50) * 1e0 AS snr_db,
        CASE WHEN user_id % 6 <> 5 THEN 67e0 + 3.5e0 * (user_id % 6) END AS ctcss_tone_hz, user_id AS source_id, event_type AS kind
      FROM events)))"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power cells from the embeddings: squares of the elements, 64 bins a frame."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("frame"), F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("power"))


CELLS = """cells AS MATERIALIZED (
  SELECT frame, i - 1 AS bin, CAST(e[i] AS DOUBLE) * CAST(e[i] AS DOUBLE) AS power FROM (SELECT vec_id AS frame, embedding AS e, unnest(range(1, 65)) AS i FROM embeddings))"""
