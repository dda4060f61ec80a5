"""Scoring of reports against known transmissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from . import bestmatch
from .joins import interval_join


def _sides(reports: DataFrame, truth: DataFrame, scene_start: float | None) -> tuple[DataFrame, DataFrame]:
    if scene_start is None:
        scene_start = reports.agg(F.coalesce(F.min("timestamp"), F.lit(0.0))).first()[0]
    r = reports.select(F.col("row_id").alias("report_id"), (F.col("timestamp") - scene_start).alias("r0"), (F.col("timestamp") - scene_start + F.col("duration_s")).alias("r1"), F.col("frequency_hz").alias("rf"))
    t = truth.select("truth_id", F.col("start_s").alias("s0"), F.col("stop_s").alias("s1"), F.col("frequency_hz").alias("tf"))
    return r, t


def hits(reports: DataFrame, truth: DataFrame, scene_start: float | None = None, tolerance_hz: float = S.SCORE_TOLERANCE_HZ) -> DataFrame:
    """(report_id, truth_id, overlap_s) for reports and transmissions that meet in time and frequency. They grow with the square of traffic; ``best_matches`` doesn't list them."""
    r, t = _sides(reports, truth, scene_start)
    met = interval_join(r, t, ("r0", "r1"), ("s0", "s1"), F.abs(F.col("rf") - F.col("tf")) <= tolerance_hz)
    return met.select("report_id", "truth_id", (F.least("r1", "s1") - F.greatest("r0", "s0")).alias("overlap_s"))


def best_matches(reports: DataFrame, truth: DataFrame, scene_start: float | None = None, tolerance_hz: float = S.SCORE_TOLERANCE_HZ) -> DataFrame:
    """The same rows as ``matches`` of ``hits``, without a row for each pair."""
    r, t = _sides(reports, truth, scene_start)
    return bestmatch.best_matches(r.toDF("id", "t0", "t1", "f"), t.toDF("id", "t0", "t1", "f"), tolerance_hz)


def matches(met: DataFrame) -> DataFrame:
    """Each report's transmission: the one of the greatest overlap, the first of equals; with the number of those it met."""
    best = F.max(F.struct("overlap_s", (-F.col("truth_id")).alias("o")))
    return met.groupBy("report_id").agg(best.alias("b"), F.count("*").alias("met")).select("report_id", (-F.col("b.o")).alias("truth_id"), F.col("b.overlap_s").alias("overlap_s"), "met")


def spurious(reports: DataFrame, met: DataFrame) -> DataFrame:
    """Reports that meet no transmission; ``met`` holds the hits or the matches."""
    return reports.join(met.select(F.col("report_id").alias("row_id")).distinct(), "row_id", "left_anti")


def by_truth(reports: DataFrame, truth: DataFrame, matched: DataFrame) -> DataFrame:
    """One row for each transmission: whether and how it was reported; its first report counts for channel and tone."""
    r = matched.join(reports.select(F.col("row_id").alias("report_id"), "duration_s", F.col("pmr_channel").alias("r_channel"), F.col("ctcss_tone_hz").alias("r_tone")), "report_id")
    first = F.min(F.struct("report_id", "r_channel", "r_tone"))
    told = r.groupBy("truth_id").agg(F.count("*").alias("reports"), F.sum("duration_s").alias("reported_s"), first.alias("f"))
    tone_ok = F.when(F.col("ctcss_hz").isNull(), F.col("f.r_tone").isNull()).otherwise(F.coalesce(F.abs(F.col("f.r_tone") - F.col("ctcss_hz")) < S.FRIEND_TOLERANCE_HZ, F.lit(False)))
    seen = F.col("reports").isNotNull()
    return truth.join(told, "truth_id", "left").select(
        *truth.columns,
        seen.alias("detected"),
        F.coalesce(F.col("reports") > 1, F.lit(False)).alias("fragmented"),
        F.when(seen, F.col("reported_s") - (F.col("stop_s") - F.col("start_s"))).otherwise(F.lit(0.0)).alias("duration_error_s"),
        (seen & F.col("f.r_channel").eqNullSafe(F.col("pmr_channel"))).alias("channel_correct"),
        (seen & tone_ok).alias("ctcss_correct"),
    )


def summary(told: DataFrame, matched: DataFrame, spurious_count: int, scene_s: float) -> DataFrame:
    """The headline figures, zero where nothing can be counted."""
    found = F.sum(F.col("detected").cast("int"))
    share = lambda c: F.coalesce(F.sum(F.col(c).cast("int")) / F.nullif(found, F.lit(0)), F.lit(0.0))
    merged = matched.agg(F.count_if(F.col("met") > 1)).first()[0]
    return told.agg(
        F.count("*").alias("transmissions"),
        F.coalesce(found, F.lit(0)).alias("detected"),
        F.coalesce(found / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("probability_of_detection"),
        F.lit(spurious_count).cast("bigint").alias("spurious"),
        F.lit(spurious_count / scene_s if scene_s else 0.0).alias("false_alarms_per_second"),
        F.coalesce(F.sum(F.col("fragmented").cast("int")), F.lit(0)).alias("fragmented"),
        F.lit(merged).cast("bigint").alias("merged"),
        share("channel_correct").alias("channel_accuracy"),
        share("ctcss_correct").alias("ctcss_accuracy"),
        F.coalesce(F.sqrt(F.avg(F.when(F.col("detected"), F.col("duration_error_s") * F.col("duration_error_s")))), F.lit(0.0)).alias("duration_rmse_s"),
    )


def detection_by_snr(told: DataFrame, low: float = 0.0, high: float = 40.0, step: float = 5.0) -> DataFrame:
    """Detection rate in bins of the transmissions' signal-to-noise ratio; empty bins and values outside are left out."""
    inside = told.where((F.col("snr_db") >= low) & (F.col("snr_db") < high))
    return inside.groupBy((F.floor((F.col("snr_db") - low) / step) * step + low).alias("low_db")).agg(F.avg(F.col("detected").cast("double")).alias("probability"), F.count("*").alias("n"))
