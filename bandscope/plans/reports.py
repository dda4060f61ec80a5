"""Whole analyses: the order of battle of a store, the score of a synthetic scene, the figures of a dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import dsp, publish
from ..functions.expr import emitter_label
from ..operators import attribution, calibration, clustering, occupancy, scoring, signal
from ..operators.staging import staged


def order_of_battle(reports: DataFrame, since: float | None = None, channel: int | None = None) -> dict[str, DataFrame]:
    """Emitters, their by-products, occupancy and load. Filters come before attribution, as they decide what can be a parent."""
    if since is not None:
        reports = reports.where(F.col("timestamp") >= since)
    if channel is not None:
        reports = reports.where(F.col("pmr_channel") == channel)
    told = staged(attribution.attribute(staged(reports)))
    members = staged(clustering.cluster(told))
    profiles = staged(occupancy.profile_stats(members, ["profile_id"]).join(told.select(F.col("row_id").alias("profile_id"), "pmr_channel", "ctcss_tone_hz", "frequency_hz"), "profile_id"))
    label = emitter_label("frequency_hz", "pmr_channel", "ctcss_tone_hz")
    products = clustering.attach_products(told.where(F.col("attribution").isNotNull()), profiles)
    return {
        "detections": told,
        "emitters": profiles.withColumn("label", label).drop("frequency_hz").orderBy(F.desc("airtime_s"), "first_seen", "profile_id"),
        "products": products.join(told.select("row_id", "frequency_hz", "peak_power_dbfs", "attribution"), "row_id"),
        "occupancy": occupancy.channel_hour(told),
        "load": occupancy.band_load(told),
    }


def emitter_rows(found: dict[str, DataFrame], places: dict[str, int] | None = None) -> DataFrame:
    """The emitters of an order of battle with the number of their by-products, by falling air time (of equals the older first).

    Figures are rounded for a report unless ``places`` says otherwise (an empty dictionary: not at all).
    """
    if places is None:
        places = {"median_frequency_hz": 1, "airtime_s": 2, "duty_cycle": 4, "median_duration_s": 2, "median_gap_s": 2, "median_power_dbfs": 1, "power_spread_db": 1, "frequency_spread_hz": 1}
    counts = found["products"].groupBy("profile_id").agg(F.count("*").alias("products"))
    out = found["emitters"].join(counts, "profile_id", "left").withColumn("products", F.coalesce("products", F.lit(0).cast("bigint")))
    return out.orderBy(F.desc("airtime_s"), "first_seen", "profile_id").withColumns({c: F.round(c, n) for c, n in places.items()})


def product_rows(found: dict[str, DataFrame]) -> DataFrame:
    """By-products with the emitter they belong to: distance from its median frequency and level below its median power."""
    p = found["emitters"].select("profile_id", "median_frequency_hz", "median_power_dbfs")
    out = found["products"].join(p, "profile_id")
    return out.select("profile_id", "row_id", "frequency_hz", (F.col("frequency_hz") - F.col("median_frequency_hz")).alias("offset_hz"), (F.col("peak_power_dbfs") - F.col("median_power_dbfs")).alias("dbc"), "attribution")


def summary(found: dict[str, DataFrame]) -> DataFrame:
    """One row for a whole store: what was detected, what of it emitters explain, and the band's load. Zeros for an empty one."""
    none = F.lit(None).cast("double")
    own = F.col("attribution").isNull()
    of = lambda kind, n, span=(none, none, none): [F.lit(kind).alias("kind"), n.cast("bigint").alias("n"), *(c.alias(name) for c, name in zip(span, ("t0", "t1", "on_air"), strict=True))]
    span = tuple(F.when(own, c) for c in (F.col("timestamp"), F.col("timestamp") + F.col("duration_s"), F.col("duration_s")))
    every = found["detections"].select(of("d", F.lit(1), span)).unionByName(found["emitters"].select(of("e", F.col("transmissions")))).unionByName(found["products"].select(of("p", F.lit(1))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = every.agg(
        F.count_if(F.col("kind") == "d").alias("detections"),
        F.count_if(F.col("kind") == "e").alias("emitters"),
        F.coalesce(F.sum(F.when(F.col("kind") == "e", F.col("n"))), F.lit(0)).cast("bigint").alias("emissions"),
        F.count_if(F.col("kind") == "p").alias("products"),
        zero(F.sum("on_air")).alias("airtime_s"),
        zero(F.max("t1") - F.min("t0")).alias("window_s"),
    )
    return out.withColumn("duty_cycle", F.when(F.col("window_s") > 0, F.col("airtime_s") / F.col("window_s")).otherwise(F.lit(0.0)))


def demo_rows(found: dict[str, DataFrame], scene: dsp.Scenario, limit: int = 12) -> tuple[DataFrame, DataFrame]:
    """For a demonstration's report: the truth with its emitter's settings, and the first detections in time."""
    emitters = [(e.name, float(e.distance_m), float(e.eirp_dbm), e.ctcss_hz) for e in scene.emitters]
    told = found["truth"].sparkSession.createDataFrame(emitters, "emitter string, distance_m double, eirp_dbm double, set_ctcss_hz double")
    return found["truth"].join(told, "emitter", "left"), found["reports"].orderBy("timestamp", "row_id").limit(limit)


def demo(spark: SparkSession, scene: dsp.Scenario, settings: S.Settings, friend_hz: float | None = None) -> dict[str, DataFrame]:
    """Synthesise a scene, run the chain over it and score the reports."""
    blocks, truth = signal.synthesise(spark, scene, settings)
    reports = staged(signal.run_capture(blocks, settings, friend_hz))
    truth = truth.withColumn("truth_id", F.monotonically_increasing_id())
    matched = staged(scoring.best_matches(reports, truth, 0.0))
    told = scoring.by_truth(reports, truth, matched)
    return {"reports": reports, "truth": told, "summary": scoring.summary(told, matched, scoring.spurious(reports, matched).count(), scene.duration_s), "by_snr": scoring.detection_by_snr(told)}


def published(reports: DataFrame, site: publish.Site | None = None, draws: int = 20_000) -> DataFrame:
    """(row_id, event) documents of reports: tracks, and rings where the power is in dBm."""
    ranged = calibration.estimate_range(reports, draws)
    return publish.events(ranged, site).select("row_id", F.explode("events").alias("event"))


def dashboard_page(reports: DataFrame, title: str = "Band occupancy", limit: int = 50) -> str:
    """A self-contained page of the grid and the busiest emitters."""
    found = order_of_battle(reports)
    columns = ["label", "transmissions", "airtime_s", "duty_cycle", "proven_multiple"]
    return publish.dashboard(occupancy.grid(found["detections"]).collect(), found["emitters"].select(*columns).limit(limit).collect(), title)
