"""Statistical studies of the detector and of the range model; each trial is a row, so they spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import free_space_loss_db
from . import cells
from .calibration import estimate_range


def exponential_frames(spark: SparkSession, frames: int, bins: int, level: float, seed: int = 1) -> DataFrame:
    """Frames of exponential noise power, from a hash of frame, bin and seed."""
    u = lambda f, i: (F.pmod(F.xxhash64(f, i, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return spark.range(frames).select(F.col("id").alias("frame"), F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: -level * F.ln(u(F.col("id"), i))).alias("power"))


def false_alarm_rates(spark: SparkSession, pfa: float = 1e-3, levels: tuple[float, ...] = (1e-6, 1.0, 1e3), frames: int = 500, bins: int = 160) -> DataFrame:
    """Measured rate (method, level, rate) of noise cells over the threshold."""
    out = None
    for method in ("os", "ca"):
        factor = cells.os_factor(pfa) if method == "os" else cells.ca_factor(pfa)
        for level in levels:
            f = exponential_frames(spark, frames, bins, level).withColumn("noise", cells.noise_estimate(F.col("power"), bins, method))
            hit = F.aggregate(F.zip_with("power", "noise", lambda p, n: F.when(p > n * factor, 1).otherwise(0)), F.lit(0), lambda a, x: a + x)
            row = f.agg((F.sum(hit) / (F.count("*") * bins)).alias("rate")).select(F.lit(method).alias("method"), F.lit(level).alias("level"), "rate")
            out = row if out is None else out.unionByName(row)
    return out


def detection_sweep(spark: SparkSession, snrs_db: tuple[float, ...] = (0.0, 5.0, 10.0, 15.0, 20.0, 25.0), pfa: float = 1e-8, trials: int = 400, bins: int = 64, target: int = 20) -> DataFrame:
    """Detection rate of one cell that holds a signal and noise, by its signal-to-noise ratio."""
    factor = cells.os_factor(pfa)
    f = exponential_frames(spark, trials, bins, 1.0).withColumn("snr_db", F.explode(F.array(*map(F.lit, snrs_db))))
    with_signal = F.transform("power", lambda p, i: F.when(i == target, p + F.pow(F.lit(10.0), F.col("snr_db") / 10)).otherwise(p))
    f = f.withColumn("power", with_signal).withColumn("noise", cells.noise_estimate(F.col("power"), bins))
    return f.groupBy("snr_db").agg(F.avg((F.col("power")[target] > F.col("noise")[target] * factor).cast("double")).alias("pd"), F.count("*").alias("trials"))


def ring_coverage(spark: SparkSession, true_exponents: tuple[float, ...] = (3.5, 2.5), trials: int = 300, draws: int = 400, seed: int = 5) -> DataFrame:
    """How often the credible rings hold the true distance, by the path's true exponent (exponent, percentile, coverage)."""
    n = len(true_exponents)
    u = lambda k: (F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(k)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    normal = lambda k: F.sqrt(-2 * F.ln(u(k))) * F.cos(6.283185307179586 * u(k + 1))
    mean = F.element_at(F.array(*map(F.lit, true_exponents)), F.pmod(F.col("id"), F.lit(n)).cast("int") + 1)
    t = spark.range(trials * n).select("id", mean.alias("exponent"), (100 * F.pow(F.lit(30.0), u(0))).alias("distance_m"))
    drawn = F.greatest(F.col("exponent") + 0.5 * normal(2), F.lit(2.0))
    loss = free_space_loss_db(446e6, 1.0) + 10 * drawn * F.log10("distance_m") + 8 * normal(4)
    t = t.select(F.col("id").alias("row_id"), "exponent", "distance_m", F.lit(446e6).alias("frequency_hz"), (27 + 3 * normal(6) - loss + 2 * normal(8)).alias("estimated_dbm"))
    ringed = estimate_range(t, draws).select("exponent", "distance_m", F.explode("range_m").alias("percentile", "radius_m"))
    return ringed.groupBy("exponent", "percentile").agg(F.avg((F.col("distance_m") <= F.col("radius_m")).cast("double")).alias("coverage"))


def range_sensitivity(spark: SparkSession, received_dbm: float = -60.0, draws: int = 2_000) -> DataFrame:
    """Spread of the range (95th over 5th percentile) from each uncertainty alone, and from all."""
    sigmas = {"exponent": dict(exponent_sigma=0.5), "shadowing": dict(shadowing_sigma_db=8.0), "eirp": dict(eirp_sigma_db=3.0), "calibration": dict(calibration_sigma_db=2.0)}
    none = dict(exponent_sigma=0.0, shadowing_sigma_db=0.0, eirp_sigma_db=0.0, calibration_sigma_db=0.0)
    one = spark.range(1).select(F.lit(1).alias("row_id"), F.lit(446e6).alias("frequency_hz"), F.lit(received_dbm).alias("estimated_dbm"))
    out = None
    for name, own in [*sigmas.items(), ("all", {k: v for d in sigmas.values() for k, v in d.items()})]:
        r = estimate_range(one, draws, **(none | own)).select(F.lit(name).alias("source"), (F.col("range_m")[95] / F.col("range_m")[5]).alias("spread"))
        out = r if out is None else out.unionByName(r)
    return out


def sweep_levels(spark: SparkSession, low_dbm: float, high_dbm: float, step_db: float) -> DataFrame:
    """Source levels of a calibration sweep, both ends included."""
    n = int(round((high_dbm - low_dbm) / step_db))
    return spark.range(n + 1).select((low_dbm + F.col("id") * step_db).alias("source_dbm"))
