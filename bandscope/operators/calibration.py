"""Power calibration, receive chain, antennas and range estimates."""

from __future__ import annotations

from functools import cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.expr import free_space_loss_db, plausible_gain_dbi, required_dimension_m
from .staging import staged

CALIBRATION_DDL = "gain_key string, offset_db double, slope double, r_squared double, residual_rms_db double, valid_lo double, valid_hi double, num_points int"


def to_dbm(emissions: DataFrame, calibrations: DataFrame, key: str = "gain_key", level: str = "peak_power_dbfs") -> DataFrame:
    """Add ``estimated_dbm`` and ``calibrated``: null and false without a calibration for the gains or outside its range.

    The dimension has one row for each gain setting; Spark chooses how to join it by its size.
    """
    c = calibrations.select(F.col("gain_key").alias("c_key"), "offset_db", "slope", "valid_lo", "valid_hi")
    inside = F.col(level).between(F.col("valid_lo"), F.col("valid_hi"))
    out = emissions.drop("estimated_dbm", "calibrated").join(c, F.col(key) == F.col("c_key"), "left")
    out = out.withColumn("estimated_dbm", F.when(inside, F.col("slope") * F.col(level) + F.col("offset_db")))
    return out.withColumn("calibrated", F.col("estimated_dbm").isNotNull()).drop("c_key", "offset_db", "slope", "valid_lo", "valid_hi")


def fit_once(points: DataFrame, key: str = "gain_key", x: str = "measured_dbfs", y: str = "input_dbm") -> DataFrame:
    """Ordinary least squares by key, in one aggregation."""
    slope, offset = F.regr_slope(y, x), F.regr_intercept(y, x)
    return points.groupBy(key).agg(slope.alias("slope"), offset.alias("offset_db"), F.regr_r2(y, x).alias("r_squared"), F.min(x).alias("valid_lo"), F.max(x).alias("valid_hi"), F.count("*").alias("num_points"))


def fit_trimmed(points: DataFrame, key: str = "gain_key", x: str = "measured_dbfs", y: str = "input_dbm", limit_db: float = 1.0, least: int = 3) -> DataFrame:
    """Least squares by key that drops the worst point while it is over ``limit_db`` off and more than ``least`` remain; the first of equals goes.

    Each round is two aggregations over the stored points of all keys that aren't done: the fits, and the worst point of each. So no task holds a
    sweep, whatever its length, and nothing but whether a round was the last passes through the driver; rounds number as many as the most points
    dropped from one key. Keys with fewer than two different levels have no fit. Points without a level go first.
    """
    rows = points.select(F.col(key).alias("gain_key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    left = staged(rows.withColumn("place", F.monotonically_increasing_id()))
    names = ["slope", "offset_db", "valid_lo", "valid_hi", "num_points"]
    done: DataFrame | None = None
    while True:
        fits = left.groupBy(F.col("gain_key").alias("k")).agg(
            F.regr_slope("y", "x").alias("slope"),
            F.regr_intercept("y", "x").alias("offset_db"),
            F.min("x").alias("valid_lo"),
            F.max("x").alias("valid_hi"),
            F.count("*").alias("num_points"),
            F.avg("y").alias("mean"),
        )
        fits = fits.where("slope is not null and valid_lo < valid_hi")
        off = F.col("y") - (F.col("slope") * F.col("x") + F.col("offset_db"))
        told = left.join(fits, F.col("gain_key").eqNullSafe(F.col("k"))).withColumn("off", off).groupBy("gain_key").agg(
            *(F.first(c).alias(c) for c in names),
            F.max(F.struct(F.abs("off").alias("off"), (-F.col("place")).alias("place"))).alias("worst"),
            F.sum(F.col("off") * F.col("off")).alias("squares"),
            F.sum(F.pow(F.col("y") - F.col("mean"), F.lit(2.0))).alias("total"),
        )
        told = staged(told.withColumn("drops", (F.col("num_points") > least) & (F.col("worst.off") > limit_db)))
        ended = told.where(~F.col("drops"))
        done = ended if done is None else done.unionByName(ended)
        going = told.where("drops").select(F.col("gain_key").alias("k"), (-F.col("worst.place")).alias("dropped"))
        if going.isEmpty():
            break
        left = staged(left.join(going, F.col("gain_key").eqNullSafe(F.col("k"))).where("place <> dropped").drop("k", "dropped"))
    r2 = F.when(F.col("total") > 0, 1 - F.col("squares") / F.col("total")).otherwise(F.lit(1.0))
    return done.select("gain_key", "offset_db", "slope", r2.alias("r_squared"), F.sqrt(F.col("squares") / F.col("num_points")).alias("residual_rms_db"), "valid_lo", "valid_hi", F.col("num_points").cast("int").alias("num_points"))


def dynamic_range(points: DataFrame, key: str = "gain_key", x: str = "measured_dbfs", y: str = "input_dbm", linearity_db: float = 1.0) -> DataFrame:
    """The span of levels that stays linear, by key, after the points that are off have been dropped; zero for fewer than three points."""
    fitted = fit_trimmed(points, key, x, y, limit_db=linearity_db).select(F.col("gain_key").alias("f_key"), (F.col("valid_hi") - F.col("valid_lo")).alias("span"))
    counts = points.groupBy(F.col(key).alias("gain_key")).agg(F.count("*").alias("points"))
    joined = counts.join(fitted, F.col("gain_key").eqNullSafe(F.col("f_key")), "left")
    return joined.select("gain_key", F.when(F.col("points") >= 3, F.coalesce("span", F.lit(0.0))).otherwise(F.lit(0.0)).alias("dynamic_range_db"))


def chain_table(spark: SparkSession, stages=S.CHAIN) -> DataFrame:
    return spark.createDataFrame(list(stages), "stage_idx int, name string, gain_db double, noise_figure_db double, max_input_dbm double")


def _before(keys: tuple[str, ...]) -> Column:
    """Gain ahead of each stage of a device's chain, which is a handful of rows; ``keys`` name the device."""
    w = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("stage_idx").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("gain_db").over(w), F.lit(0.0))


def _level(source_dbm: float | str) -> Column:
    return F.col(source_dbm) if isinstance(source_dbm, str) else F.lit(float(source_dbm))


def cascade(stages: DataFrame, bandwidth_hz: float = S.CHANNEL_SPACING_HZ, required_snr_db: float = 13.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """Total gain, cascaded noise figure, noise floor and least detectable signal of each device."""
    ten = F.lit(10.0)
    part = (F.pow(ten, F.col("noise_figure_db") / 10) - 1) / F.pow(ten, F.col("before") / 10)
    out = stages.withColumn("before", _before(keys)).groupBy(*keys).agg(F.sum("gain_db").alias("total_gain_db"), (10 * F.log10(1 + F.sum(part))).alias("noise_figure_db"))
    out = out.withColumn("noise_floor_dbm", S.THERMAL_NOISE_DBM_PER_HZ + 10 * F.log10(F.lit(float(bandwidth_hz))) + F.col("noise_figure_db"))
    return out.withColumn("detectable_dbm", F.col("noise_floor_dbm") + required_snr_db)


def input_violations(stages: DataFrame, source_dbm: float | str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Stages that get more than they stand; the source's level is a number or a column."""
    level = _level(source_dbm) + F.col("before")
    return stages.withColumn("before", _before(keys)).where(level > F.col("max_input_dbm")).select(*keys, "stage_idx", "name", level.alias("input_dbm"), "max_input_dbm")


def required_attenuation(stages: DataFrame, source_dbm: float | str, margin_db: float = 10.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """What must be put before each chain, in steps of 10 dB, so that every stage keeps the margin."""
    excess = _level(source_dbm) + F.col("before") - (F.col("max_input_dbm") - margin_db)
    return stages.withColumn("before", _before(keys)).groupBy(*keys).agg(F.greatest(F.lit(0.0), F.ceil(F.greatest(F.max(excess), F.lit(0.0)) / 10) * 10.0).alias("attenuation_db"))


def antenna_table(spark: SparkSession, antennas=S.ANTENNAS) -> DataFrame:
    return spark.createDataFrame(list(antennas), "name string, min_frequency_hz double, max_frequency_hz double, claimed_gain_dbi double, largest_dimension_m double, measured_gain_dbi double")


def audit(antennas: DataFrame, frequency_hz: float | str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Antennas that don't cover the frequency (a number or a column), and claims of gain that their size can't give."""
    f = _level(frequency_hz)
    bound = plausible_gain_dbi(f, "largest_dimension_m")
    covers = f.between(F.col("min_frequency_hz"), F.col("max_frequency_hz"))
    finding = F.when(~covers, "out of band").when(F.col("claimed_gain_dbi") > bound + 1.0, "implausible gain")
    out = antennas.select(*keys, "name", finding.alias("finding"), bound.alias("bound_dbi"), required_dimension_m(f, "claimed_gain_dbi").alias("needed_m"), F.coalesce("measured_gain_dbi", F.lit(0.0)).alias("effective_gain_dbi"))
    return out.where(F.col("finding").isNotNull())


@cache
def _quantiles() -> np.ndarray:
    """A standard normal as 65,536 equally likely values: the medians of equal shares of its probability."""
    inverse, n = NormalDist().inv_cdf, 1 << 16
    return np.array([inverse((i + 0.5) / n) for i in range(n)])


def settling(ranks: list[int], n: int) -> list[tuple[int, int, int]]:
    """Partitions (start, stop, place) that put the values of ascending ``ranks`` (from 0) among ``n`` in their places.

    Each is for one place, which NumPy does many times faster than for several at once, and works on what the ones before left open.
    """
    plan, open_ = [], [(0, n, ranks)]
    while open_:
        start, stop, inside = open_.pop()
        if inside:
            k = min(inside, key=lambda r: abs(2 * r - start - stop))
            plan.append((start, stop, k))
            open_ += [(start, k, [r for r in inside if r < k]), (k + 1, stop, [r for r in inside if r > k])]
    return plan


def order_statistics(x: np.ndarray, ranks: list[int], plan: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The values of ``x`` at ``ranks`` and the next higher ones (the last place has itself); ``x`` is reordered by the ``plan``."""
    for start, stop, k in plan:
        x[start:stop].partition(k - start)
    after = [np.minimum.reduce(x[k + 1 : top + 1]) if k + 1 < len(x) else x[k] for k, top in zip(ranks, [*ranks[1:], len(x) - 1], strict=True)]
    return x[ranks], np.array(after, x.dtype)


def estimate_range(
    emissions: DataFrame,
    draws: int = 20_000,
    percentiles: tuple[int, ...] = (5, 50, 68, 90, 95),
    exponent: float = 3.5,
    exponent_sigma: float = 0.5,
    shadowing_sigma_db: float = 8.0,
    eirp_dbm: float = 27.0,
    eirp_sigma_db: float = 3.0,
    calibration_sigma_db: float = 2.0,
    receiver_gain_dbi: float = 0.0,
    seed: int = 1,
) -> DataFrame:
    """Add ``range_m``, a map from percentile to metres (null without a power in dBm), by Monte-Carlo draws.

    Each row has draws of its own, made where the row is, in one Arrow kernel seeded by a hash of the row, so nothing is joined
    or shuffled. Shadowing, radiated power and calibration are independent and only added up, so their sum is drawn as one.
    A draw is two numbers of 16 bits, looked up among the quantiles of a normal (``_quantiles``), in single precision.
    """
    if draws < 1 or any(not 0 < p < 100 for p in percentiles):
        raise ValueError("draws must be positive and percentiles inside 0 to 100")
    wanted = sorted({50, *percentiles})
    places = np.array(wanted) / 100 * (draws - 1)
    ranks, same = np.unique(places.astype(int), return_inverse=True)
    ranks, part = ranks.tolist(), places - places.astype(int)
    plan = settling(ranks, draws)
    sigma_db = float(np.sqrt(shadowing_sigma_db**2 + eirp_sigma_db**2 + calibration_sigma_db**2))

    def draw(keys: pa.Array, losses: pa.Array) -> pa.Array:
        """Percentiles by linear interpolation between order statistics."""
        z = _quantiles()
        added = (sigma_db * z).astype(np.float32)
        divided = (1 / (10 * np.maximum(exponent + exponent_sigma * z, 2.0))).astype(np.float32)
        bits = np.random.SFC64(0)
        state, decades, factors = bits.state, np.empty(draws, np.float32), np.empty(draws, np.float32)
        found = np.zeros((2, len(losses), len(ranks)), np.float32)
        for i, (key, loss) in enumerate(zip(keys.to_numpy(zero_copy_only=False).view(np.uint64), losses.to_pylist(), strict=True)):
            if loss is None:
                continue
            state["state"]["state"][:] = key, key, key, 1  # as its author seeds it, with twelve rounds
            bits.state = state
            at = bits.random_raw(12 + (draws + 1) // 2)[12:].view(np.uint16).astype(np.intp)
            added.take(at[:draws], out=decades, mode="wrap")
            divided.take(at[draws : 2 * draws], out=factors, mode="wrap")
            decades += np.float32(loss)
            decades *= factors
            # Of numbers that aren't negative the bits rise with the value, and integers are ranked faster, as none is NaN.
            ranked = decades.view(np.int32) if loss + added[0] >= 0 else decades
            found[0, i], found[1, i] = (x.view(np.float32) for x in order_statistics(ranked, ranks, plan))
        low, high = 10.0 ** found.astype(float)[:, :, same]
        metres = low + (high - low) * part
        return pa.array([None if gap else row for gap, row in zip(losses.is_null().to_pylist(), metres.tolist(), strict=True)], pa.list_(pa.float64()))

    loss = eirp_dbm + receiver_gain_dbi - F.col("estimated_dbm") - free_space_loss_db("frequency_hz", 1.0)
    found = F.arrow_udf(draw, "array<double>")(F.xxhash64("row_id", F.lit(seed)), loss.cast("double"))
    table = F.create_map(*(x for i, p in enumerate(wanted) for x in (F.lit(p), F.get("draws__", F.lit(i)))))
    return emissions.withColumn("draws__", found).withColumn("range_m", F.when(F.col("draws__").isNotNull(), table)).drop("draws__")


__all__ = ["antenna_table", "audit", "cascade", "chain_table", "estimate_range", "fit_once", "fit_trimmed", "free_space_loss_db", "input_violations", "required_attenuation", "to_dbm"]
