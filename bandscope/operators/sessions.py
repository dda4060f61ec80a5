"""Gap sessions: runs of events no further apart than a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_lag(df: DataFrame, keys: list[str], at: str, gap: float, longest: float | None = None) -> DataFrame:
    """Number each row's run within its key; a difference of exactly ``gap`` continues a run.

    With ``longest`` a run is cut into pieces of that extent, counted from its start.
    """
    w = Window.partitionBy(*keys).orderBy(at)
    fresh = F.when(F.coalesce(F.col(at) - F.lag(at).over(w) > gap, F.lit(True)), 1).otherwise(0)
    out = df.withColumn("fresh__", fresh).withColumn("run", F.sum("fresh__").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh__")
    if longest is None:
        return out
    start = F.min(at).over(Window.partitionBy(*keys, "run"))
    return out.withColumn("piece", F.floor((F.col(at) - start) / longest))


def cut_at_silence(df: DataFrame, keys: list[str], start: str, end: str, slice_size: int, name: str = "island") -> DataFrame:
    """Number the islands of intervals that silence divides: one begins where all earlier ones of its key have ended before.

    The running maximum has two levels. Intervals are put into slices by their start; each slice is told the latest end of the slices
    before it and how many islands began in them, from one row for each slice. So a long key is spread over its slices, and no window
    runs over its intervals.
    """
    e = df.withColumn("slice__", F.floor(F.col(start) / slice_size))
    along = Window.partitionBy(*keys).orderBy("slice__")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    of = [*keys, "slice__"]
    on = lambda right: [F.col(k).eqNullSafe(F.col(f"{k}__of")) for k in of] if right else None

    def told(of_slices: DataFrame, what, as_name: str) -> DataFrame:
        return of_slices.select(*(F.col(k).alias(f"{k}__of") for k in of), what.over(before).alias(as_name))

    tops = e.groupBy(*of).agg(F.max(end).alias("top__"))
    e = e.join(told(tops, F.max("top__"), "reach__"), on(True)).drop(*(f"{k}__of" for k in of))
    w = Window.partitionBy(*of).orderBy(start, end)
    latest = F.greatest(F.col("reach__"), F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.withColumn("fresh__", F.when(F.coalesce(F.col(start) > latest, F.lit(True)), 1).otherwise(0))
    begun = e.groupBy(*of).agg(F.sum("fresh__").alias("begun__"))
    e = e.join(told(begun, F.sum("begun__"), "earlier__"), on(True)).drop(*(f"{k}__of" for k in of))
    counted = Window.partitionBy(*of).orderBy(start, end, F.desc("fresh__")).rowsBetween(Window.unboundedPreceding, 0)  # of equals the fresh one first
    number = F.coalesce("earlier__", F.lit(0)) + F.sum("fresh__").over(counted)
    return e.withColumn(name, number).drop("slice__", "reach__", "fresh__", "earlier__")


def by_window(df: DataFrame, keys: list[str], ts: str, gap: str) -> DataFrame:
    """Sessions by the built-in session window: key, start, end of the last event, count."""
    grouped = df.groupBy(*keys, F.session_window(ts, gap).alias("w"))
    return grouped.agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def tracked(cells: DataFrame, hangover: int, min_frames: int, max_frames: int, min_occupancy: float, keys: list[str] | None = None) -> DataFrame:
    """Emissions from long-form detections (keys, bin, frame, power, noise, left_power, right_power).

    Islands end after more than ``hangover`` quiet frames, are cut at ``max_frames`` and must have ``min_frames`` frames and
    the share ``min_occupancy`` of detected ones. Independent of partitioning.
    """
    keys = keys or []
    runs = by_lag(cells, [*keys, "bin"], "frame", hangover, max_frames)
    return (
        runs.groupBy(*keys, "bin", "run", "piece")
        .agg(
            F.min("frame").alias("start_frame"),
            F.max("frame").alias("end_frame"),
            F.max("power").alias("peak_power"),
            F.avg("power").alias("mean_power"),
            F.avg("noise").alias("mean_noise"),
            F.avg("left_power").alias("left_power"),
            F.avg("right_power").alias("right_power"),
            F.count("*").alias("detected_frames"),
        )
        .withColumn("frame_count", F.col("end_frame") - F.col("start_frame") + 1)
        .withColumn("occupancy", F.col("detected_frames") / F.col("frame_count"))
        .where((F.col("frame_count") >= min_frames) & (F.col("occupancy") >= min_occupancy))
        .drop("run", "piece")
    )


def failure_streaks(steps: DataFrame, keys: list[str], at: str, ok: str, give_up: int = 20, longest_wait_s: float = 60.0) -> DataFrame:
    """Add ``failures`` (failed steps in a row up to this one, zero after a good one), ``wait_s`` (doubling, up to a limit) and
    ``given_up``. A null ``ok`` counts as failed."""
    good = F.coalesce(F.col(ok), F.lit(False))
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = steps.withColumn("since__", F.sum(good.cast("int")).over(w))
    since = Window.partitionBy(*keys, "since__").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum((~good).cast("int")).over(since)
    out = out.withColumn("failures", n).drop("since__")
    wait = F.least(F.pow(F.lit(2.0), F.least("failures", F.lit(6))), F.lit(longest_wait_s))
    return out.withColumns({"wait_s": F.when(F.col("failures") > 0, wait).otherwise(F.lit(0.0)), "given_up": F.col("failures") >= give_up})
