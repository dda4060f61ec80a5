"""Queries over the test tables and their DuckDB equivalents.

Figures are rounded on both sides where the order of summation may differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import dsp
from ..functions import expr as X
from ..functions import publish as P
from ..operators import attribution as A
from ..operators import calibration as C
from ..operators import cells as D
from ..operators import clustering as G
from ..operators import occupancy as O
from ..operators import scoring as R
from ..operators import sessions as W
from ..operators import signal as D2
from ..operators.staging import new_path, staged
from ..operators.joins import overlapping_pairs
from ..sources import iq as I
from ..sources import store
from .views import CELLS, EM, emissions, frames, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# Occupancy


@query(f"WITH {EM} SELECT pmr_channel, CAST(floor((timestamp % 86400e0) / 3600e0) AS INTEGER) AS hour, round(sum(duration_s), 4) AS airtime_s, count(*) AS n FROM em GROUP BY 1, 2")
def occupancy_channel_hour(spark, sf):
    return rounded(O.channel_hour(emissions(spark, sf)), 4, "airtime_s")


@query(
    f"WITH {EM}, e AS (SELECT *, CAST(floor((timestamp % 86400e0) / 3600e0) AS INTEGER) AS hour FROM em) SELECT pmr_channel, hour, round(sum(duration_s), 4) AS airtime_s, count(*) AS n, CAST(grouping_id(pmr_channel, hour) AS BIGINT) AS level FROM e GROUP BY GROUPING SETS ((pmr_channel), (hour), ())"
)
def occupancy_marginals(spark, sf):
    return rounded(O.marginals(emissions(spark, sf)), 4, "airtime_s")


@query(f"WITH {EM} SELECT pmr_channel, round(sum(duration_s), 4) AS airtime_s FROM em GROUP BY 1 ORDER BY sum(duration_s) DESC, pmr_channel LIMIT 5")
def busiest_channels(spark, sf):
    return rounded(O.busiest(emissions(spark, sf), "pmr_channel"), 4, "airtime_s")


@query(f"WITH {EM} SELECT CAST(floor((timestamp % 86400e0) / 3600e0) AS INTEGER) AS hour, round(sum(duration_s), 4) AS airtime_s FROM em GROUP BY 1 ORDER BY sum(duration_s) DESC, 1 LIMIT 5")
def busiest_hours(spark, sf):
    return rounded(O.busiest(emissions(spark, sf), "hour"), 4, "airtime_s")


@query(f"WITH {EM} SELECT round(sum(duration_s), 3) AS airtime_s, round(max(timestamp + duration_s) - min(timestamp), 3) AS window_s, round(sum(duration_s) / (max(timestamp + duration_s) - min(timestamp)), 6) AS duty_cycle FROM em")
def band_load(spark, sf):
    return rounded(rounded(O.band_load(emissions(spark, sf)), 3, "airtime_s", "window_s"), 6, "duty_cycle")


_GRID = ", ".join(f"round(coalesce(sum(CASE WHEN hour = {h} THEN duration_s END), 0), 4) AS h{h:02d}" for h in range(24))


@query(f"WITH {EM}, e AS (SELECT *, floor((timestamp % 86400e0) / 3600e0) AS hour FROM em) SELECT pmr_channel, {_GRID} FROM e GROUP BY 1")
def grid_pivot(spark, sf):
    return rounded(O.grid(emissions(spark, sf)), 4, *(f"h{h:02d}" for h in range(24)))


@query(f"WITH {EM} SELECT row_id, frequency_hz, pmr_channel, 446006250e0 + (pmr_channel - 1) * 12500e0 AS channel_hz, 2 * 446593750e0 - frequency_hz AS image_hz FROM em")
def channel_assignment(spark, sf):
    e = emissions(spark, sf)
    return e.select("row_id", "frequency_hz", "pmr_channel", X.channel_frequency("pmr_channel").alias("channel_hz"), X.image_frequency("frequency_hz").alias("image_hz"))


@query(
    f"WITH {EM} SELECT row_id, CASE WHEN pmr_channel IS NOT NULL THEN 'PMR' || pmr_channel ELSE CAST(CAST(round(frequency_hz) AS BIGINT) AS VARCHAR) END AS place, CASE WHEN abs(ctcss_tone_hz - 70.5e0) < 0.5e0 THEN 'FRIEND' ELSE 'UNKNOWN' END AS classification, strftime(make_timestamp(CAST(floor(timestamp * 100) AS BIGINT) * 10000), '%Y-%m-%dT%H:%M:%S.%g') AS at FROM em"
)
def identification(spark, sf):
    e = emissions(spark, sf)
    place = F.when(F.col("pmr_channel").isNotNull(), F.concat(F.lit("PMR"), F.col("pmr_channel").cast("string"))).otherwise(F.round("frequency_hz").cast("bigint").cast("string"))
    at = F.date_format(F.timestamp_micros((F.floor(F.col("timestamp") * 100) * 10_000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return e.select("row_id", place.alias("place"), X.classify("ctcss_tone_hz", 70.5).alias("classification"), at.alias("at"))


# Sessions

_RUNS = f"""WITH {EM}, r AS (SELECT source_id, timestamp, sum(fresh) OVER (PARTITION BY source_id ORDER BY timestamp ROWS UNBOUNDED PRECEDING) AS run FROM (
  SELECT source_id, timestamp, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY source_id ORDER BY timestamp) <= 7200e0 THEN 0 ELSE 1 END AS fresh FROM em))
SELECT source_id, round(min(timestamp), 3) AS first_s, round(max(timestamp), 3) AS last_s, count(*) AS n FROM r GROUP BY source_id, run"""


@query(_RUNS)
def sessionize_lag(spark, sf):
    runs = W.by_lag(emissions(spark, sf).select("source_id", "timestamp"), ["source_id"], "timestamp", 7200.0)
    out = runs.groupBy("source_id", "run").agg(F.round(F.min("timestamp"), 3).alias("first_s"), F.round(F.max("timestamp"), 3).alias("last_s"), F.count("*").alias("n"))
    return out.drop("run")


@query(_RUNS)
def sessionize_window(spark, sf):
    e = emissions(spark, sf).select("source_id", F.timestamp_micros((F.col("timestamp") * 1e6).cast("bigint")).alias("ts"))
    out = W.by_window(e, ["source_id"], "ts", "7200 seconds")
    second = lambda c: F.round(F.unix_micros(c) / 1e6, 3)
    return out.select("source_id", second("first_ts").alias("first_s"), second("last_ts").alias("last_s"), "n")


_ISLANDS = f"""WITH {CELLS}, hit AS (SELECT * FROM cells WHERE power > 2e-2), r AS (
  SELECT bin, frame, power, sum(fresh) OVER (PARTITION BY bin ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY bin ORDER BY frame) <= 2 THEN 0 ELSE 1 END AS fresh FROM hit)),
p AS (SELECT *, floor((frame - min(frame) OVER (PARTITION BY bin, run)) / 20e0) AS piece FROM r)
SELECT bin, min(frame) AS start_frame, max(frame) AS end_frame, round(max(power), 6) AS peak_power, round(avg(power), 6) AS mean_power, count(*) AS detected_frames, max(frame) - min(frame) + 1 AS frame_count
FROM p GROUP BY bin, run, piece HAVING max(frame) - min(frame) + 1 >= 3 AND count(*) / (max(frame) - min(frame) + 1) >= 0.35e0"""


@query(_ISLANDS)
def tracked_emissions(spark, sf):
    cells = frames(spark, sf).select("frame", F.posexplode("power").alias("bin", "power")).where("power > 2e-2")
    cells = cells.withColumns({"bin": F.col("bin").cast("bigint"), "noise": F.lit(1e-2), "left_power": F.lit(0.0), "right_power": F.lit(0.0)})
    out = W.tracked(cells, 2, 3, 20, 0.35)
    return rounded(out.select("bin", "start_frame", "end_frame", "peak_power", "mean_power", "detected_frames", "frame_count"), 6, "peak_power", "mean_power")


# Attribution

_PAIRS = "pairs AS MATERIALIZED (SELECT w.row_id AS w_id, w.frequency_hz AS w_f, s.row_id AS s_id, s.frequency_hz AS s_f, s.peak_power_dbfs AS s_p FROM em w JOIN em s ON w.timestamp < s.timestamp + s.duration_s AND s.timestamp < w.timestamp + w.duration_s AND s.peak_power_dbfs - w.peak_power_dbfs >= 10e0)"
_SPLATTER = "spl AS (SELECT a.w_id AS row_id, a.s_id AS parent_id, a.s_f AS parent_hz FROM pairs a WHERE EXISTS (SELECT 1 FROM pairs o WHERE o.s_id = a.s_id AND o.w_id <> a.w_id AND abs(o.w_f - (2 * a.s_f - a.w_f)) <= 2000e0) QUALIFY row_number() OVER (PARTITION BY a.w_id ORDER BY a.s_p DESC, a.s_id) = 1)"
_INTERMOD = "imd AS (SELECT a.w_id AS row_id, a.s_id AS parent_id, a.s_f AS parent_hz FROM pairs a WHERE EXISTS (SELECT 1 FROM pairs o WHERE o.w_id = a.w_id AND o.s_id <> a.s_id AND abs(2 * a.s_f - a.w_f - o.s_f) <= 2000e0) QUALIFY row_number() OVER (PARTITION BY a.w_id ORDER BY a.s_p DESC, a.s_id) = 1)"


@query(f"WITH {EM} SELECT a.row_id AS a_id, b.row_id AS b_id, round(least(a.timestamp + a.duration_s, b.timestamp + b.duration_s) - greatest(a.timestamp, b.timestamp), 3) AS shared_s FROM em a JOIN em b ON a.row_id < b.row_id AND a.timestamp < b.timestamp + b.duration_s AND b.timestamp < a.timestamp + a.duration_s")
def overlap_pairs(spark, sf):
    e = emissions(spark, sf).select(F.col("row_id").alias("id"), F.col("timestamp").alias("t0"), (F.col("timestamp") + F.col("duration_s")).alias("t1"))
    shared = F.least("a_t1", "b_t1") - F.greatest("a_t0", "b_t0")
    return overlapping_pairs(e, "id", "t0", "t1").select("a_id", "b_id", X.rounded_product(shared, 3).alias("shared_s"))


@query(f"WITH {EM}, {_PAIRS}, {_SPLATTER} SELECT row_id, parent_id, parent_hz FROM spl")
def attribution_splatter(spark, sf):
    return A.splatter(staged(emissions(spark, sf)))


@query(f"WITH {EM}, {_PAIRS}, {_INTERMOD} SELECT row_id, parent_id, parent_hz FROM imd")
def attribution_intermod(spark, sf):
    return A.intermodulation(staged(emissions(spark, sf)))


@query(
    f"WITH {EM}, {_PAIRS}, {_SPLATTER}, {_INTERMOD} SELECT em.row_id, coalesce(spl.parent_hz, imd.parent_hz) AS attributed_to_hz, CASE WHEN spl.row_id IS NOT NULL THEN 'SPLATTER' WHEN imd.row_id IS NOT NULL THEN 'INTERMOD3' END AS attribution FROM em LEFT JOIN spl USING (row_id) LEFT JOIN imd USING (row_id)"
)
def attribution(spark, sf):
    return A.attribute(staged(emissions(spark, sf))).select("row_id", "attributed_to_hz", "attribution")


@query(
    f"WITH {EM}, {_PAIRS}, {_SPLATTER}, {_INTERMOD}, o AS (SELECT em.*, coalesce(spl.row_id, imd.row_id) AS product FROM em LEFT JOIN spl USING (row_id) LEFT JOIN imd USING (row_id)) SELECT pmr_channel, CAST(floor((timestamp % 86400e0) / 3600e0) AS INTEGER) AS hour, round(sum(duration_s), 4) AS airtime_s, count(*) AS n FROM o WHERE product IS NULL GROUP BY 1, 2"
)
def occupancy_attributed(spark, sf):
    return rounded(O.channel_hour(A.attribute(staged(emissions(spark, sf)))), 4, "airtime_s")


@query(
    f"WITH {EM}, {_PAIRS}, {_SPLATTER}, {_INTERMOD} SELECT count(*) AS emissions, count(spl.row_id) AS splatter, count(CASE WHEN spl.row_id IS NULL THEN imd.row_id END) AS intermod, count(*) - count(coalesce(spl.row_id, imd.row_id)) AS own FROM em LEFT JOIN spl USING (row_id) LEFT JOIN imd USING (row_id)"
)
def attribution_totals(spark, sf):
    return A.totals(A.attribute(staged(emissions(spark, sf))))


# Profiles

_PROFILE = f"""WITH {EM}, g AS (SELECT *, timestamp - lag(timestamp + duration_s) OVER w AS gap, max(timestamp + duration_s) OVER (PARTITION BY pmr_channel, ctcss_tone_hz ORDER BY timestamp, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM em WINDOW w AS (PARTITION BY pmr_channel, ctcss_tone_hz ORDER BY timestamp, row_id)),
a AS (SELECT pmr_channel, ctcss_tone_hz, count(*) AS transmissions, sum(duration_s) AS airtime_s, min(timestamp) AS first_seen, max(timestamp + duration_s) AS last_seen, median(duration_s) AS md, coalesce(median(CASE WHEN gap >= 0 THEN gap END), 0) AS mg, median(peak_power_dbfs) AS mp, median(frequency_hz) AS mf, max(coalesce(timestamp < latest, false)) AS proven_multiple, list_sort(list(peak_power_dbfs)) AS ps, list_sort(list(frequency_hz)) AS fs FROM g GROUP BY 1, 2)
SELECT pmr_channel, ctcss_tone_hz, transmissions, round(airtime_s, 3) AS airtime_s, round(first_seen, 3) AS first_seen, round(last_seen, 3) AS last_seen, round(md, 4) AS median_duration_s, round(mg, 3) AS median_gap_s, round(mp, 4) AS median_power_dbfs, round(mf, 3) AS median_frequency_hz, proven_multiple, NOT proven_multiple AS count_is_lower_bound,
round(CASE WHEN last_seen > first_seen THEN airtime_s / (last_seen - first_seen) ELSE 0 END, 6) AS duty_cycle,
round(CASE WHEN len(ps) >= 2 THEN ps[(3 * len(ps)) // 4 - (CASE WHEN len(ps) % 4 = 0 THEN 0 ELSE -1 END)] - ps[len(ps) // 4 + 1] ELSE 0 END, 4) AS power_spread_db,
round(CASE WHEN len(fs) >= 2 THEN fs[(3 * len(fs)) // 4 - (CASE WHEN len(fs) % 4 = 0 THEN 0 ELSE -1 END)] - fs[len(fs) // 4 + 1] ELSE 0 END, 3) AS frequency_spread_hz FROM a"""


@query(_PROFILE)
def profile_stats(spark, sf):
    out = O.profile_stats(emissions(spark, sf), ["pmr_channel", "ctcss_tone_hz"])
    out = rounded(out, 3, "airtime_s", "first_seen", "last_seen", "median_gap_s", "median_frequency_hz", "frequency_spread_hz")
    return rounded(rounded(out, 4, "median_duration_s", "median_power_dbfs", "power_spread_db"), 6, "duty_cycle")


def _fold(source: str) -> str:
    """Tables ``s`` (emissions of ``source`` by island and place) and ``r``: one step of the recursion takes the next emission of every island; a group is its founder, its tone and its frequencies."""
    return f"""t AS (SELECT DISTINCT ctcss_tone_hz IS NULL AS silent, coalesce(ctcss_tone_hz, -1) AS tone FROM {source}),
ti AS (SELECT silent, tone, sum(jump) OVER (PARTITION BY silent ORDER BY tone) AS tone_island FROM (SELECT *, CASE WHEN tone - lag(tone) OVER (PARTITION BY silent ORDER BY tone) <= 1 THEN 0 ELSE 1 END AS jump FROM t)),
e AS (SELECT {source}.*, silent, tone_island FROM {source} JOIN ti ON (ctcss_tone_hz IS NULL) = silent AND coalesce(ctcss_tone_hz, -1) = tone),
fi AS (SELECT silent, tone_island, f, sum(jump) OVER (PARTITION BY silent, tone_island ORDER BY f) AS island FROM (SELECT *, CASE WHEN f - lag(f) OVER (PARTITION BY silent, tone_island ORDER BY f) <= 3000 THEN 0 ELSE 1 END AS jump FROM (SELECT DISTINCT silent, tone_island, frequency_hz AS f FROM e))),
s AS MATERIALIZED (SELECT silent::VARCHAR || '/' || tone_island || '/' || island AS isle, row_id, frequency_hz AS f, ctcss_tone_hz AS tone, row_number() OVER (PARTITION BY silent, tone_island, island ORDER BY timestamp, row_id) AS k FROM e JOIN fi USING (silent, tone_island) WHERE f = frequency_hz),
r AS (SELECT isle, 0::BIGINT AS k, []::STRUCT(id BIGINT, tone DOUBLE, fs DOUBLE[])[] AS gs, NULL::BIGINT AS row_id, NULL::BIGINT AS profile_id FROM (SELECT DISTINCT isle FROM s)
  UNION ALL SELECT isle, k, CASE WHEN pos > 0 THEN list_transform(gs, lambda g, i: CASE WHEN i = pos THEN {{'id': g.id, 'tone': g.tone, 'fs': list_append(g.fs, f)}} ELSE g END) ELSE list_append(gs, {{'id': row_id, 'tone': tone, 'fs': [f]}}) END, row_id, CASE WHEN pos > 0 THEN gs[pos].id ELSE row_id END
  FROM (SELECT s.isle, s.k, r.gs, s.row_id, s.f, s.tone, coalesce(list_position(list_transform(r.gs, lambda g: coalesce(abs(g.tone - s.tone) <= 1, g.tone IS NULL AND s.tone IS NULL) AND abs(s.f - list_median(g.fs)) <= 3000), true), 0) AS pos FROM r JOIN s ON s.isle = r.isle AND s.k = r.k + 1))"""


_CLUSTERS = f"""WITH RECURSIVE {EM}, {_fold("em")},
m AS (SELECT em.*, profile_id, timestamp < max(timestamp + duration_s) OVER (PARTITION BY profile_id ORDER BY timestamp, em.row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS together FROM em JOIN r ON r.row_id = em.row_id)
SELECT profile_id, count(*) AS transmissions, round(sum(duration_s), 3) AS airtime_s, round(median(frequency_hz), 3) AS median_frequency_hz, max(coalesce(together, false)) AS proven_multiple FROM m GROUP BY 1"""


@query(_CLUSTERS)
def emitter_clusters(spark, sf):
    members = staged(G.cluster(staged(emissions(spark, sf))))
    out = O.profile_stats(members, ["profile_id"])
    return rounded(out.select("profile_id", "transmissions", "airtime_s", "median_frequency_hz", "proven_multiple"), 3, "airtime_s", "median_frequency_hz")


_NEAREST = f"""WITH {EM}, prof AS (SELECT pmr_channel, median(frequency_hz) AS hz, min(timestamp) AS founded, min(row_id) AS profile_id FROM em WHERE pmr_channel IS NOT NULL GROUP BY 1),
prod AS (SELECT row_id, frequency_hz + 700e0 AS hz FROM em)
SELECT d.row_id, p.profile_id, round(abs(p.hz - d.hz), 3) AS distance_hz FROM prod d JOIN prof p ON abs(p.hz - d.hz) <= 3000e0 QUALIFY row_number() OVER (PARTITION BY d.row_id ORDER BY abs(p.hz - d.hz), p.founded, p.profile_id) = 1"""


@query(_NEAREST)
def nearest_profile(spark, sf):
    e = staged(emissions(spark, sf))
    profiles = e.where("pmr_channel is not null").groupBy("pmr_channel").agg(F.median("frequency_hz").alias("median_frequency_hz"), F.min("timestamp").alias("first_seen"), F.min("row_id").alias("profile_id"))
    return rounded(G.attach_products(e.select("row_id", (F.col("frequency_hz") + 700.0).alias("attributed_to_hz")), profiles), 3, "distance_hz")


# Scoring: odd events are the truth, even ones the reports.

_SCORE = EM + """, t0 AS (SELECT min(timestamp) AS s FROM em WHERE row_id % 2 = 0), rep AS (SELECT em.*, timestamp - s AS r0, timestamp - s + duration_s AS r1 FROM em, t0 WHERE row_id % 2 = 0),
tru AS (SELECT row_id AS truth_id, timestamp - s AS s0, timestamp - s + duration_s AS s1, frequency_hz, pmr_channel, ctcss_tone_hz AS ctcss_hz, snr_db FROM em, t0 WHERE row_id % 2 = 1),
met AS MATERIALIZED (SELECT r.row_id AS report_id, t.truth_id, least(r.r1, t.s1) - greatest(r.r0, t.s0) AS overlap_s FROM rep r JOIN tru t ON abs(r.frequency_hz - t.frequency_hz) <= 6250e0 AND r.r0 < t.s1 AND r.r1 > t.s0),
mat AS MATERIALIZED (SELECT report_id, truth_id, overlap_s, count(*) OVER (PARTITION BY report_id) AS met FROM met QUALIFY row_number() OVER (PARTITION BY report_id ORDER BY overlap_s DESC, truth_id) = 1),
told AS (SELECT t.*, m.n IS NOT NULL AS detected, coalesce(m.n > 1, false) AS fragmented, CASE WHEN m.n IS NOT NULL THEN m.d - (t.s1 - t.s0) ELSE 0 END AS duration_error_s, m.n IS NOT NULL AND m.ch IS NOT DISTINCT FROM t.pmr_channel AS channel_correct,
  m.n IS NOT NULL AND CASE WHEN t.ctcss_hz IS NULL THEN m.tone IS NULL ELSE coalesce(abs(m.tone - t.ctcss_hz) < 0.5e0, false) END AS ctcss_correct
  FROM tru t LEFT JOIN (SELECT truth_id, count(*) AS n, sum(duration_s) AS d, arg_min(struct_pack(c := pmr_channel), report_id).c AS ch, arg_min(struct_pack(c := ctcss_tone_hz), report_id).c AS tone FROM mat JOIN rep ON rep.row_id = mat.report_id GROUP BY 1) m USING (truth_id))"""


def _scored(spark, sf):
    e = staged(emissions(spark, sf))
    start = e.where("row_id % 2 = 0").agg(F.coalesce(F.min("timestamp"), F.lit(0.0))).first()[0]
    reports = e.where("row_id % 2 = 0")
    truth = e.where("row_id % 2 = 1").select(
        F.col("row_id").alias("truth_id"), (F.col("timestamp") - start).alias("start_s"), (F.col("timestamp") - start + F.col("duration_s")).alias("stop_s"), "frequency_hz", "pmr_channel", F.col("ctcss_tone_hz").alias("ctcss_hz"), "snr_db"
    )
    return reports, truth, R.best_matches(reports, truth, start)


@query(f"WITH {_SCORE} SELECT report_id, truth_id, round(overlap_s, 3) AS overlap_s, met FROM mat")
def score_matches(spark, sf):
    return rounded(_scored(spark, sf)[2], 3, "overlap_s")


@query(f"WITH {_SCORE} SELECT row_id FROM rep WHERE row_id NOT IN (SELECT report_id FROM met)")
def spurious(spark, sf):
    reports, _, matched = _scored(spark, sf)
    return R.spurious(reports, matched).select("row_id")


@query(
    f"WITH {_SCORE}, sp AS (SELECT count(*) AS k FROM rep WHERE row_id NOT IN (SELECT report_id FROM met)) SELECT count(*) AS transmissions, CAST(sum(CAST(detected AS INT)) AS BIGINT) AS detected, round(sum(CAST(detected AS INT)) / count(*), 6) AS probability_of_detection, (SELECT k FROM sp) AS spurious, round((SELECT k FROM sp) / 1000e0, 6) AS false_alarms_per_second, CAST(sum(CAST(fragmented AS INT)) AS BIGINT) AS fragmented, (SELECT count(*) FROM mat WHERE met > 1) AS merged, round(sum(CAST(channel_correct AS INT)) / sum(CAST(detected AS INT)), 6) AS channel_accuracy, round(sum(CAST(ctcss_correct AS INT)) / sum(CAST(detected AS INT)), 6) AS ctcss_accuracy, round(sqrt(avg(CASE WHEN detected THEN duration_error_s * duration_error_s END)), 4) AS duration_rmse_s FROM told"
)
def score_summary(spark, sf):
    reports, truth, matched = _scored(spark, sf)
    matched = staged(matched)
    out = R.summary(R.by_truth(reports, truth, matched), matched, R.spurious(reports, matched).count(), 1000.0)
    return rounded(rounded(out, 6, "probability_of_detection", "false_alarms_per_second", "channel_accuracy", "ctcss_accuracy"), 4, "duration_rmse_s")


@query(f"WITH {_SCORE} SELECT floor(snr_db / 5e0) * 5e0 AS low_db, round(avg(CAST(detected AS INT)), 6) AS probability, count(*) AS n FROM told WHERE snr_db >= 0 AND snr_db < 40 GROUP BY 1")
def detection_by_snr(spark, sf):
    reports, truth, matched = _scored(spark, sf)
    return rounded(R.detection_by_snr(R.by_truth(reports, truth, matched)), 6, "probability")


# Calibration, chain, antennas, range

_GAIN = "'lna' || (8 * (source_id % 3)) || '_vga' || (2 * (source_id % 4)) || '_amp' || (source_id % 2)"


def _with_gains(spark, sf) -> DataFrame:
    s = F.col("source_id")
    return emissions(spark, sf).withColumn("gain_key", X.gain_key(8.0 * (s % 3), 2.0 * (s % 4), (s % 2).cast("boolean")))


@query(
    f"WITH {EM}, g AS (SELECT *, {_GAIN} AS gain_key FROM em), c AS (SELECT gain_key, count(*) * 1e0 AS n, avg(peak_power_dbfs) AS m FROM g WHERE source_id % 4 <> 1 GROUP BY 1) SELECT row_id, gain_key, CASE WHEN peak_power_dbfs BETWEEN -60e0 AND -1e0 AND c.n IS NOT NULL THEN round(0.98e0 * peak_power_dbfs - 40e0, 6) END AS estimated_dbm, coalesce(peak_power_dbfs BETWEEN -60e0 AND -1e0 AND c.n IS NOT NULL, false) AS calibrated FROM g LEFT JOIN c USING (gain_key)"
)
def calibration_lookup(spark, sf):
    g = _with_gains(spark, sf)
    c = g.where("source_id % 4 <> 1").groupBy("gain_key").agg(F.lit(-40.0).alias("offset_db"), F.lit(0.98).alias("slope"), F.lit(-60.0).alias("valid_lo"), F.lit(-1.0).alias("valid_hi"))
    return rounded(C.to_dbm(g, c).select("row_id", "gain_key", "estimated_dbm", "calibrated"), 6, "estimated_dbm")


@query(
    f"WITH {EM}, g AS (SELECT {_GAIN} AS gain_key, peak_power_dbfs AS x, 0.9e0 * peak_power_dbfs - 50e0 + (row_id % 11) / 10e0 AS y FROM em) SELECT gain_key, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS offset_db, round(regr_r2(y, x), 6) AS r_squared, min(x) AS valid_lo, max(x) AS valid_hi, count(*) AS num_points FROM g GROUP BY 1"
)
def calibration_fit(spark, sf):
    g = _with_gains(spark, sf).select("gain_key", F.col("peak_power_dbfs").alias("measured_dbfs"), (0.9 * F.col("peak_power_dbfs") - 50 + (F.col("row_id") % 11) / 10).alias("input_dbm"))
    return rounded(C.fit_once(g), 6, "slope", "offset_db", "r_squared")


@query(
    f"WITH {EM}, g AS (SELECT {_GAIN} AS gain_key, peak_power_dbfs AS x FROM em) SELECT gain_key, round(CASE WHEN count(*) >= 3 THEN max(x) - min(x) ELSE 0 END, 6) AS dynamic_range_db FROM g GROUP BY 1"
)
def dynamic_range(spark, sf):
    """No point of this sweep is off the line by the limit, so SQL needs no trimming; a test has points that are."""
    g = _with_gains(spark, sf).select("gain_key", F.col("peak_power_dbfs").alias("measured_dbfs"), (0.9 * F.col("peak_power_dbfs") - 50 + (F.col("row_id") % 11) / 10).alias("input_dbm"))
    return rounded(C.dynamic_range(g), 6, "dynamic_range_db")


# Sites: each supplier as a receiver with the deployed chain, its own gains and noise, and its own strongest source.

_CHAIN_ROWS = ", ".join(f"({i}, '{n}', {g}::DOUBLE, {f}::DOUBLE, {m}::DOUBLE)" for i, n, g, f, m in S.CHAIN)
_STAGES = f"""st(stage_idx, name, gain, noise, lim) AS (VALUES {_CHAIN_ROWS}), site AS (SELECT s_suppkey AS site, s_acctbal / 250e0 - 40e0 AS source_dbm FROM supplier),
ch AS (SELECT *, coalesce(sum(gain_db) OVER (PARTITION BY site ORDER BY stage_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT site, source_dbm, stage_idx, name, gain + CASE WHEN stage_idx = 2 THEN site % 5 - 2 WHEN stage_idx = 3 THEN (site % 4) * -0.3e0 ELSE 0 END AS gain_db, noise + CASE WHEN stage_idx = 2 THEN (site % 3) * 0.2e0 ELSE 0 END AS nf, lim FROM site, st))"""


def _sites(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), (F.col("s_acctbal").cast("double") / 250 - 40).alias("source_dbm"))


def _per_site(sites: DataFrame, rows, names: str) -> DataFrame:
    """Every site with a few fixed rows."""
    columns = names.split()
    each = F.array(*(F.struct(*(F.lit(v).alias(c) if v is not None else F.lit(None).cast("double").alias(c) for v, c in zip(r, columns, strict=True))) for r in rows))
    return sites.select("*", F.explode(each).alias("r")).select(*sites.columns, "r.*")


def _chains(spark, sf) -> DataFrame:
    k, stage = F.col("site"), F.col("stage_idx")
    c = _per_site(_sites(spark, sf), S.CHAIN, "stage_idx name gain_db noise_figure_db max_input_dbm")
    gain = F.when(stage == 2, (k % 5 - 2).cast("double")).when(stage == 3, -0.3 * (k % 4)).otherwise(0.0)
    return c.withColumns({"gain_db": F.col("gain_db") + gain, "noise_figure_db": F.col("noise_figure_db") + F.when(stage == 2, 0.2 * (k % 3)).otherwise(0.0)})


@query(
    f"WITH {_STAGES}, f AS (SELECT site, sum(gain_db) AS g, 10 * log10(1 + sum((pow(10e0, nf / 10) - 1) / pow(10e0, before / 10))) AS nf FROM ch GROUP BY 1) SELECT site, round(g, 6) AS total_gain_db, round(nf, 6) AS noise_figure_db, round(-174e0 + 10 * log10(12500e0) + nf, 6) AS noise_floor_dbm, round(-174e0 + 10 * log10(12500e0) + nf + 13, 6) AS detectable_dbm FROM f"
)
def friis_chain(spark, sf):
    return rounded(C.cascade(_chains(spark, sf), keys=("site",)), 6, "total_gain_db", "noise_figure_db", "noise_floor_dbm", "detectable_dbm")


@query(f"WITH {_STAGES} SELECT site, stage_idx, name, round(source_dbm + before, 6) AS input_dbm, lim AS max_input_dbm FROM ch WHERE source_dbm + before > lim")
def input_safety(spark, sf):
    return rounded(C.input_violations(_chains(spark, sf), "source_dbm", ("site",)), 6, "input_dbm")


@query(f"WITH {_STAGES} SELECT site, greatest(0e0, ceil(greatest(max(source_dbm + before - (lim - 10e0)), 0) / 10) * 10) AS attenuation_db FROM ch GROUP BY 1")
def required_attenuation(spark, sf):
    return C.required_attenuation(_chains(spark, sf), "source_dbm", keys=("site",))


_ANTENNAS = "an(name, lo, hi, claimed, dim) AS (VALUES " + ", ".join(f"('{n}', {a!r}::DOUBLE, {b!r}::DOUBLE, {'NULL' if c is None else c}::DOUBLE, {d!r}::DOUBLE)" for n, a, b, c, d, _ in S.ANTENNAS) + ")"


@query(
    f"WITH {_ANTENNAS}, q AS (SELECT s_suppkey AS site, name, lo, hi, claimed, dim * (1 + (s_suppkey % 4) / 10e0) AS dim, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 7 * 1e0 END AS measured, 300e6 + 50e6 * (s_suppkey % 100) AS f FROM supplier, an), b AS (SELECT *, 299792458e0 / f AS wl FROM q), r AS (SELECT site, name, CASE WHEN NOT (f BETWEEN lo AND hi) THEN 'out of band' WHEN claimed > 10 * log10(greatest(4 * pi() * 0.6e0 * dim * dim / (wl * wl), 1e-6)) + 1 THEN 'implausible gain' END AS finding, round(10 * log10(greatest(4 * pi() * 0.6e0 * dim * dim / (wl * wl), 1e-6)), 6) AS bound_dbi, round(sqrt(pow(10e0, claimed / 10) * wl * wl / (4 * pi()) / 0.6e0), 6) AS needed_m, coalesce(measured, 0e0) AS effective_gain_dbi FROM b) SELECT * FROM r WHERE finding IS NOT NULL"
)
def antenna_audit(spark, sf):
    """Every site's set of antennas, of its own sizes, at its own frequency."""
    k = F.col("site")
    a = _per_site(_sites(spark, sf), S.ANTENNAS, "name min_frequency_hz max_frequency_hz claimed_gain_dbi largest_dimension_m measured_gain_dbi")
    a = a.withColumns({"largest_dimension_m": F.col("largest_dimension_m") * (1 + (k % 4) / 10), "measured_gain_dbi": F.when(k % 3 == 0, (k % 7).cast("double")), "frequency_hz": 300e6 + 50e6 * (k % 100)})
    return rounded(C.audit(a, "frequency_hz", ("site",)), 6, "bound_dbi", "needed_m")


@query(f"WITH {EM} SELECT row_id, round(pow(10e0, (27e0 - (peak_power_dbfs / 4 - 60e0) - 20 * log10(4 * pi() * frequency_hz / 299792458e0)) / 35e0), 4) AS range_m FROM em")
def range_closed_form(spark, sf):
    e = emissions(spark, sf)
    return e.select("row_id", F.round(X.range_m(F.col("peak_power_dbfs") / 4 - 60, "frequency_hz", 3.5, 27.0), 4).alias("range_m"))


@query()
def range_monte_carlo(spark, sf):
    """Random draws differ between engines; tests hold the percentiles against the closed form and NumPy."""
    e = emissions(spark, sf).select("row_id", "frequency_hz", (F.col("peak_power_dbfs") / 4 - 60).alias("estimated_dbm"))
    dealt = e.repartition(4 * spark.sparkContext.defaultParallelism, "row_id")  # narrow rows with long draws: a small file would be one task
    return C.estimate_range(dealt).select("row_id", *(F.round(F.col("range_m")[p], 3).alias(f"p{p}") for p in (5, 50, 68, 90, 95)))


# Cells

_REFS = ", ".join(f"({o})" for o in D.reference_offsets(24, 2))
_NOISE = f"""WITH {CELLS}, o(d) AS (VALUES {_REFS}), g AS (SELECT c.frame, c.bin, any_value(c.power) AS power, list_sort(list(r.power)) AS refs FROM cells c CROSS JOIN o JOIN cells r ON r.frame = c.frame AND r.bin = ((c.bin + o.d) % 64 + 64) % 64 GROUP BY 1, 2)"""


def _cfar(spark, sf, method):
    f = D.os_factor(1e-2) if method == "os" else D.ca_factor(1e-2)
    out = D.detections(frames(spark, sf), 64, 1e-2, method)
    assert f > 1
    return rounded(out.withColumn("bin", F.col("bin").cast("bigint")), 6, "power", "noise", "snr_db")


@query(f"{_NOISE} SELECT frame, bin, round(power, 6) AS power, round(refs[18], 6) AS noise, round(10 * log10(power / refs[18]), 6) AS snr_db FROM g WHERE power > refs[18] * {D.os_factor(1e-2)!r}::DOUBLE")
def cfar_os(spark, sf):
    return _cfar(spark, sf, "os")


@query(f"{_NOISE} SELECT frame, bin, round(power, 6) AS power, round(list_sum(refs) / 24, 6) AS noise, round(10 * log10(power / (list_sum(refs) / 24)), 6) AS snr_db FROM g WHERE power > list_sum(refs) / 24 * {D.ca_factor(1e-2)!r}::DOUBLE")
def cfar_ca(spark, sf):
    return _cfar(spark, sf, "ca")


@query(f"{_NOISE} SELECT frame, bin, round(power, 6) AS power, round(refs[18], 6) AS noise, round(10 * log10(power / refs[18]), 6) AS snr_db FROM g WHERE power > refs[18] * {D.os_factor(1e-2)!r}::DOUBLE AND bin NOT IN (0, 29, 30, 31, 32, 33, 34)")
def cfar_excluded(spark, sf):
    """Without the bins beside the receiver's own offset and the band's edges."""
    excluded = S.Settings(num_channels=64, decimation=32).excluded_bins()
    out = D.detections(frames(spark, sf), 64, 1e-2, "os", excluded=excluded)
    return rounded(out.withColumn("bin", F.col("bin").cast("bigint")), 6, "power", "noise", "snr_db")


@query(
    f"{_NOISE}, n AS (SELECT frame, bin, power, refs[18] AS noise FROM g), fire AS (SELECT a.frame, a.bin FROM n a JOIN n b ON a.frame = b.frame AND b.bin = (a.bin + 1) % 64 WHERE a.power + b.power > greatest(a.noise, b.noise) * 6e0 AND a.bin NOT IN (0, 31, 32) AND b.bin NOT IN (0, 31, 32)) SELECT DISTINCT frame, bin FROM (SELECT frame, bin FROM fire UNION ALL SELECT frame, (bin + 1) % 64 FROM fire)"
)
def cfar_pair(spark, sf):
    f = frames(spark, sf).withColumn("noise", D.noise_estimate(F.col("power"), 64))
    hit = D.pair_mask(F.col("power"), F.col("noise"), 64, 6.0, [0, 31, 32])
    return f.select("frame", F.posexplode(hit).alias("bin", "hit")).where("hit").select("frame", F.col("bin").cast("bigint").alias("bin"))


@query(
    f"WITH {CELLS}, h AS (SELECT c.*, c.frame // 64 AS hold, first_value(c.power) OVER (PARTITION BY c.frame // 64, bin ORDER BY frame) AS anchor FROM cells c), l AS (SELECT frame, any_value(hold) AS hold, coalesce(avg(CASE WHEN power < 8 * anchor THEN power END), avg(power)) AS level FROM h GROUP BY 1) SELECT frame, round(level, 8) AS level, round(level / greatest(first_value(level) OVER (PARTITION BY hold ORDER BY frame), 1e-300), 6) AS ratio FROM l"
)
def noise_hold_level(spark, sf):
    return rounded(rounded(D.held_levels(frames(spark, sf)).select("frame", "level", "ratio"), 8, "level"), 6, "ratio")


_TONE = f"SELECT vec_id AS frame, round(2 * sqrt(pow(sum(x * cos((i - 1) * {2 * 3.141592653589793 * 100.0 / 1000.0!r}::DOUBLE)), 2) + pow(sum(x * sin((i - 1) * {2 * 3.141592653589793 * 100.0 / 1000.0!r}::DOUBLE)), 2)) / 64, 6) AS magnitude FROM (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1"


@query(_TONE)
def tone_magnitude(spark, sf):
    v = table(spark, sf, "embeddings")
    return v.select(F.col("vec_id").alias("frame"), F.round(D.tone_magnitude(F.transform("embedding", lambda x: x.cast("double")), 100.0, 1000.0), 6).alias("magnitude"))


@query(
    "WITH w AS (SELECT user_id, event_id, CAST(event_id % 3 AS INTEGER) AS tone_hz, value AS contrast FROM events), v AS (SELECT user_id, tone_hz, count(*) AS votes, min(event_id) AS f FROM w WHERE contrast >= 8 GROUP BY 1, 2), b AS (SELECT user_id, votes, tone_hz FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, f) = 1), a AS (SELECT user_id, count(*) AS windows, round(median(contrast), 6) AS median_contrast FROM w GROUP BY 1) SELECT a.user_id, CASE WHEN windows >= 2 AND votes >= 0.3e0 * windows THEN tone_hz END AS tone_hz, coalesce(votes, 0) AS votes, windows, median_contrast FROM a LEFT JOIN b USING (user_id)"
)
def tone_vote(spark, sf):
    w = table(spark, sf, "events").select("user_id", "event_id", (F.col("event_id") % 3).cast("int").alias("tone_hz"), F.col("value").alias("contrast"))
    return rounded(D.tone_vote(w, "user_id", "event_id", share=0.3), 6, "median_contrast")


@query(
    "WITH c AS (SELECT vec_id AS frame, CAST(round_even(127 * unnest(embedding)::DOUBLE, 0) AS INTEGER) AS code FROM embeddings) SELECT frame, count(DISTINCT code) AS occupied_codes, round(log2(count(DISTINCT code)), 6) AS approx_bits, round(20 * log10(greatest(max(abs(code)), 1e-12) / 128), 6) AS peak_dbfs, round(avg(code), 6) AS mean_code, round(stddev_pop(code), 6) AS std_code, max(code) - min(code) + 1 AS code_range, count(*) AS n_samples FROM c GROUP BY 1"
)
def code_histogram(spark, sf):
    c = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame"), F.explode("embedding").alias("x")).select("frame", F.rint(127 * F.col("x").cast("double")).cast("int").alias("code"))
    return rounded(D.code_histogram(c, ["frame"]), 6, "approx_bits", "peak_dbfs", "mean_code", "std_code")


@query(
    f"WITH {CELLS}, r AS (SELECT frame, bin, power < 1e-2 AS ok, row_number() OVER (PARTITION BY frame ORDER BY bin) - row_number() OVER (PARTITION BY frame, power < 1e-2 ORDER BY bin) AS island FROM cells) SELECT frame, max(n) AS longest FROM (SELECT frame, island, count(*) AS n FROM r WHERE ok GROUP BY 1, 2) GROUP BY 1"
)
def longest_run(spark, sf):
    return D.longest_run(frames(spark, sf).select("frame", F.posexplode("power").alias("bin", "power")), ["frame"], "bin", F.col("power") < 1e-2)


@query(f"WITH {CELLS} SELECT frame, bin, round(sum(power) OVER (PARTITION BY frame ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9, 8) AS smooth FROM cells")
def smooth9(spark, sf):
    c = frames(spark, sf).select("frame", F.posexplode("power").alias("bin", "power"))
    return c.select("frame", F.col("bin").cast("bigint").alias("bin"), F.round(D.smoothed(c, ["frame"], "bin", "power"), 8).alias("smooth"))


@query(f"WITH {CELLS}, s AS (SELECT bin, 10 * log10(greatest(avg(power), 1e-20)) AS power_db FROM cells GROUP BY 1), f AS (SELECT median(power_db) AS floor_db FROM s) SELECT bin, round(power_db, 6) AS power_db, round(floor_db, 6) AS floor_db, power_db > floor_db + 1 AS occupied FROM s, f")
def survey_floor(spark, sf):
    s = frames(spark, sf).select(F.posexplode("power").alias("bin", "p")).groupBy(F.lit("c").alias("capture_id"), "bin").agg(F.avg("p").alias("p"))
    return rounded(D2.over_floor(s).select(F.col("bin").cast("bigint").alias("bin"), "power_db", "floor_db", "occupied"), 6, "power_db", "floor_db")


@query(f"WITH {CELLS}, k AS (SELECT frame, max(CASE WHEN bin = 9 THEN power END) AS a, max(CASE WHEN bin = 10 THEN power END) AS b, max(CASE WHEN bin = 11 THEN power END) AS c FROM cells GROUP BY 1), l AS (SELECT *, 10 * log10(greatest(a, 1e-30)) AS x, 10 * log10(greatest(b, 1e-30)) AS y, 10 * log10(greatest(c, 1e-30)) AS z FROM k) SELECT frame, round(CASE WHEN b >= a AND b >= c AND a > 0 AND c > 0 AND x - 2 * y + z <> 0 THEN greatest(-0.5e0, least(0.5e0, 0.5e0 * (x - z) / (x - 2 * y + z))) ELSE 0 END, 6) AS offset_bins FROM l")
def peak_offset(spark, sf):
    p = F.col("power")
    return frames(spark, sf).select("frame", F.round(X.peak_offset_bins(p[9], p[10], p[11]), 6).alias("offset_bins"))


@query(
    f"WITH {EM} SELECT row_id, '<event version=\"2.0\" uid=\"BS.' || CASE WHEN pmr_channel IS NOT NULL THEN 'PMR' || pmr_channel ELSE CAST(CAST(round(frequency_hz) AS BIGINT) AS VARCHAR) END || '\" start=\"' || strftime(make_timestamp(CAST(floor(timestamp * 100) AS BIGINT) * 10000), '%Y-%m-%dT%H:%M:%S.%g') || '\"><remarks>' || replace(replace(kind || ' & <' || source_id || '>', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') || '</remarks></event>' AS xml FROM em"
)
def event_xml(spark, sf):
    e = emissions(spark, sf)
    place = F.when(F.col("pmr_channel").isNotNull(), F.concat(F.lit("PMR"), F.col("pmr_channel").cast("string"))).otherwise(F.round("frequency_hz").cast("bigint").cast("string"))
    at = F.date_format(F.timestamp_micros((F.floor(F.col("timestamp") * 100) * 10_000).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    remark = F.concat(F.col("kind"), F.lit(" & <"), F.col("source_id").cast("string"), F.lit(">"))
    return e.select("row_id", X.tag("event", {"version": F.lit("2.0"), "uid": F.concat(F.lit("BS."), place), "start": at}, children=[X.tag("remarks", text=remark)]).alias("xml"))


# Sources: each event as one read of a receiver.

_READS = "r AS (SELECT event_id, user_id, CAST(event_id % 17 AS BIGINT) - 2 AS delivered, event_id % 5 = 0 AS overflowed FROM events)"


def _reads(spark, sf) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf, "events").select("event_id", "user_id", (k % 17 - 2).alias("delivered"), (k % 5 == 0).alias("overflowed"))


@query(f"WITH {_READS} SELECT event_id, user_id, CAST(greatest(delivered, 0) AS DOUBLE) AS samples_delivered, delivered > 0 OR delivered <> 0 AS overflow FROM r WHERE (delivered > 0 AND overflowed) OR delivered <= 0")
def read_gaps(spark, sf):
    return I.read_gaps(_reads(spark, sf))


@query(f"WITH {_READS} SELECT user_id, count(*) AS gaps, count(CASE WHEN delivered <> 0 THEN 1 END) AS samples_lost_estimate FROM r WHERE (delivered > 0 AND overflowed) OR delivered <= 0 GROUP BY 1")
def samples_lost(spark, sf):
    return I.samples_lost_estimate(I.read_gaps(_reads(spark, sf)), "user_id")


@query(
    "WITH s AS (SELECT user_id, event_id, value > 40 AS ok, sum(CASE WHEN value > 40 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS since FROM events), n AS (SELECT *, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, since ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM s) SELECT event_id, failures, CASE WHEN failures > 0 THEN least(pow(2e0, least(failures, 6)), 60e0) ELSE 0e0 END AS wait_s, failures >= 20 AS given_up FROM n"
)
def failure_streaks(spark, sf):
    steps = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") > 40).alias("ok"))
    return W.failure_streaks(steps, ["user_id"], "event_id", "ok").select("event_id", "failures", "wait_s", "given_up")


# Scalar functions and predicates


@query(
    "WITH f AS (SELECT event_id, 450e6 + 3e6 * value AS hz FROM events) SELECT event_id, CAST(greatest(21, least(48, round_even((hz - 306e6) / 8e6, 0))) AS INTEGER) AS channel, 306e6 + greatest(21, least(48, round_even((hz - 306e6) / 8e6, 0))) * 8e6 AS centre_hz, round_even(hz / 100e3, 0) * 100e3 AS carrier_hz FROM f"
)
def rasters(spark, sf):
    f = table(spark, sf, "events").select("event_id", (450e6 + 3e6 * F.col("value")).alias("hz")).withColumn("channel", X.raster_channel("hz"))
    return f.select("event_id", "channel", X.raster_centre("channel").alias("centre_hz"), X.nearest_carrier("hz").alias("carrier_hz"))


@query(
    f"WITH {EM} SELECT row_id, greatest(0e0, least(40e0, round_even(snr_db / 8, 0) * 8)) AS first_gain, greatest(0e0, least(62e0, round_even(snr_db / 2, 0) * 2)) AS second_gain, greatest(0e0, least(40e0, floor(greatest(0e0, 52e0 - snr_db) / 8) * 8)) AS planned_first FROM em"
)
def gain_steps(spark, sf):
    e = emissions(spark, sf)
    return e.select("row_id", X.quantise_gain("snr_db", 8.0, 40.0).alias("first_gain"), X.quantise_gain("snr_db", 2.0, 62.0).alias("second_gain"), X.plan_gains(F.col("snr_db"))[0].alias("planned_first"))


@query(f"WITH {EM} SELECT row_id, round(20 * log10(4 * pi() * frequency_hz / 299792458e0), 6) AS reference_loss_db, round(20 * log10(4 * pi() * frequency_hz / 299792458e0) + 35 * log10(duration_s), 6) AS path_loss_db, round(299792458e0 / frequency_hz, 9) AS wavelength_m FROM em")
def path_loss(spark, sf):
    e = emissions(spark, sf)
    out = e.select("row_id", X.free_space_loss_db("frequency_hz").alias("reference_loss_db"), X.path_loss_db("duration_s", "frequency_hz", 3.5).alias("path_loss_db"), X.wavelength_m("frequency_hz").alias("wavelength_m"))
    return rounded(rounded(out, 6, "reference_loss_db", "path_loss_db"), 9, "wavelength_m")


@query(
    f"WITH {CELLS} SELECT frame, bin, round(446593750e0 + (CASE WHEN bin < 32 THEN bin ELSE bin - 64 END) * (2e6 / 64), 3) AS frequency_hz, bin IN (0, 29, 30, 31, 32, 33, 34) AS excluded FROM cells"
)
def bin_frequencies(spark, sf):
    settings = S.Settings(num_channels=64, decimation=32)
    c = frames(spark, sf).select("frame", F.posexplode("power").alias("bin", "power"))
    return c.select("frame", F.col("bin").cast("bigint").alias("bin"), F.round(X.bin_frequency("bin", 64, 2e6, settings.centre_hz), 3).alias("frequency_hz"), F.col("bin").isin(settings.excluded_bins()).alias("excluded"))


@query(
    f"WITH {EM}, t AS (SELECT DISTINCT ctcss_tone_hz AS tone FROM em) SELECT a.tone AS tone_a, b.tone AS tone_b FROM t a JOIN t b ON a.tone IS NOT DISTINCT FROM b.tone OR abs(a.tone - b.tone) <= 3.5e0"
)
def tone_pairs(spark, sf):
    """Tones that count as one: a handful of distinct values, matched by cell where present and as a class where absent."""
    from ..operators.joins import band_join

    t = emissions(spark, sf).select("ctcss_tone_hz").distinct()
    a, b = (t.where("ctcss_tone_hz is not null").select(F.col("ctcss_tone_hz").alias(n)) for n in ("tone_a", "tone_b"))
    silent = t.where("ctcss_tone_hz is null").select(F.col("ctcss_tone_hz").alias("tone_a"), F.col("ctcss_tone_hz").alias("tone_b"))
    return band_join(a, b, "tone_a", "tone_b", 3.5).unionByName(silent)


@query(f"WITH {EM} SELECT row_id, timestamp FROM em WHERE timestamp >= (SELECT avg(timestamp) FROM em) AND pmr_channel = 3")
def since_and_channel(spark, sf):
    e = emissions(spark, sf)
    start = e.agg(F.avg("timestamp")).first()[0]
    return e.where((F.col("timestamp") >= start) & (F.col("pmr_channel") == 3)).select("row_id", "timestamp")


@query(f"WITH {CELLS}, h AS (SELECT DISTINCT frame, bin FROM cells WHERE power > 4e-2) SELECT a.frame, a.bin AS bin_a, b.bin AS bin_b FROM h a JOIN h b ON a.frame = b.frame AND (a.bin + 1) % 64 = b.bin")
def adjacent_hits(spark, sf):
    h = frames(spark, sf).select("frame", F.posexplode("power").alias("bin", "power")).where("power > 4e-2").select("frame", F.col("bin").cast("bigint").alias("bin"))
    b = h.select(F.col("frame").alias("frame_b"), F.col("bin").alias("bin_b"))
    return h.join(b, (F.col("frame") == F.col("frame_b")) & (F.pmod(F.col("bin") + 1, F.lit(64)) == F.col("bin_b"))).select("frame", F.col("bin").alias("bin_a"), "bin_b")


@query(
    f"WITH {EM}, d AS (SELECT source_id, count(*) AS n, sum(duration_s) AS s, min(kind) AS k FROM em GROUP BY 1) SELECT em.row_id, em.kind, d.n, round(em.duration_s / d.s, 8) AS share FROM em JOIN d USING (source_id)"
)
def emitter_share(spark, sf):
    return O.shares(emissions(spark, sf), "source_id").select("row_id", "kind", "n", F.round("share", 8).alias("share"))


@query(
    f"WITH {EM}, s AS (SELECT 446006250e0 + 12500e0 * (row_id % 40) AS f, peak_power_dbfs AS p FROM em), m AS (SELECT f, max(p) AS p FROM s GROUP BY 1), fl AS (SELECT median(p) AS fl FROM m) SELECT CAST(round_even((f - 446006250e0) / 12500e0, 0) AS INTEGER) + 1 AS channel, round(max(p - fl), 6) AS peak_over_floor_db FROM m, fl WHERE round_even((f - 446006250e0) / 12500e0, 0) BETWEEN 0 AND 15 GROUP BY 1"
)
def channel_peaks(spark, sf):
    s = emissions(spark, sf).groupBy((446_006_250.0 + 12_500.0 * (F.col("row_id") % 40)).alias("frequency_hz")).agg(F.max("peak_power_dbfs").alias("power_db"))
    floor = s.agg(F.median("power_db")).first()[0]  # one row a bin
    out = D2.channel_peaks(s.withColumns({"capture_id": F.lit("c"), "floor_db": F.lit(floor)}))
    return rounded(out.select("channel", "peak_over_floor_db"), 6, "peak_over_floor_db")


@query(
    "WITH e AS (SELECT user_id, event_id, value AS w, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT user_id, count(*) AS n, round(avg(w), 6) AS mean_hz, round(coalesce(stddev_samp(w) / sqrt(count(*)), 0), 6) AS error_hz, max_by(event_id, w) AS peak_id FROM (SELECT user_id, event_id, value AS w FROM events) GROUP BY 1"
)
def mean_errors(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", F.col("value").alias("error_hz"), F.lit("ok").alias("status"))
    found = D2.mean_error(e, "user_id").select("user_id", F.col("captures").alias("n"), F.col("error_hz").alias("mean_hz"), F.col("standard_error_hz").alias("error_hz"))
    first = F.when(F.col("error_hz").isNotNull() & F.col("event_id").isNotNull(), F.struct("error_hz", (-F.col("event_id")).alias("o")))  # of equals, as the SQL meets them in the table
    peaks = e.groupBy("user_id").agg(F.max_by("event_id", first).alias("peak_id"))
    # A mean of 64 values of two decimals ends in a half at the seventh place: summed as the rows come and rounded by a product, as in the SQL.
    return found.join(peaks, "user_id").withColumns({c: X.rounded_product(c, 6) for c in ("mean_hz", "error_hz")})


# Sweeps of which some points are compressed: each user's events, every ninth one far off the line.

_POINTS = "SELECT user_id, event_id, CAST(event_id % 37 AS DOUBLE) * 2 - 80 + value / 100 AS x, value FROM events"


@query(
    f"""WITH RECURSIVE p AS (SELECT user_id, event_id, x, 0.9e0 * x - 50e0 + (event_id % 11) / 20e0 + CASE WHEN event_id % 9 = 0 THEN -4e0 - value / 50e0 ELSE 0e0 END AS y FROM ({_POINTS})),
g AS (SELECT user_id, list({{'x': x, 'y': y}} ORDER BY event_id) AS ps FROM p GROUP BY 1),
r AS (SELECT user_id, 0 AS round, ps, false AS done FROM g
  UNION ALL SELECT user_id, round + 1, CASE WHEN drops THEN list_filter(ps, lambda q, i: i <> worst) ELSE ps END, NOT drops FROM (
    SELECT *, list_position(off, list_max(off)) AS worst, len(ps) > 3 AND list_max(off) > 1 AS drops FROM (
      SELECT *, list_transform(ps, lambda q: abs(q.y - my - b * (q.x - mx))) AS off FROM (
        SELECT *, list_sum(list_transform(ps, lambda q: (q.x - mx) * (q.y - my))) / list_sum(list_transform(ps, lambda q: (q.x - mx) * (q.x - mx))) AS b FROM (
          SELECT *, list_avg(list_transform(ps, lambda q: q.x)) AS mx, list_avg(list_transform(ps, lambda q: q.y)) AS my FROM r
          WHERE NOT done AND len(list_distinct(list_transform(ps, lambda q: q.x))) > 1))))),
q AS (SELECT user_id, unnest(ps) AS o FROM r WHERE done)
SELECT user_id AS gain_key, round(regr_slope(o.y, o.x), 6) AS slope, round(regr_intercept(o.y, o.x), 5) AS offset_db, round(min(o.x), 6) AS valid_lo, round(max(o.x), 6) AS valid_hi, CAST(count(*) AS INTEGER) AS num_points FROM q GROUP BY 1"""
)
def calibration_trimmed(spark, sf):
    k = F.col("event_id")
    p = table(spark, sf, "events").withColumn("x", (k % 37).cast("double") * 2 - 80 + F.col("value") / 100)
    p = p.withColumn("y", 0.9 * F.col("x") - 50 + (k % 11) / 20 + F.when(k % 9 == 0, -4 - F.col("value") / 50).otherwise(0.0))
    return rounded(rounded(C.fit_trimmed(p, "user_id", "x", "y").select("gain_key", "slope", "offset_db", "valid_lo", "valid_hi", "num_points"), 6, "slope", "valid_lo", "valid_hi"), 5, "offset_db")


# Ranks


@query(f"WITH {CELLS} SELECT bin, round(quantile_cont(10 * log10(greatest(power, 1e-30)), 0.05) - 3, 6) AS low_db, round(quantile_cont(10 * log10(greatest(power, 1e-30)), 0.9999) + 3, 6) AS high_db FROM cells GROUP BY 1")
def bin_limits(spark, sf):
    """Display limits of each bin, by exact ranks."""
    c = frames(spark, sf).select(F.posexplode("power").alias("bin", "p")).select(F.col("bin").cast("bigint").alias("bin"), X.decibels("p").alias("power_db"))
    found = O.percentiles(c, ["bin"], "power_db", {"low": 0.05, "high": 0.9999}, 0.25)
    return found.select("bin", F.round(F.col("low") - 3, 6).alias("low_db"), F.round(F.col("high") + 3, 6).alias("high_db"))


@query(f"WITH {CELLS} SELECT round(quantile_cont(10 * log10(greatest(power, 1e-30)), 0.05) - 3, 6) AS low_db, round(quantile_cont(10 * log10(greatest(power, 1e-30)), 0.9999) + 3, 6) AS high_db FROM cells")
def picture_limits(spark, sf):
    c = frames(spark, sf).select(F.explode("power").alias("p")).select(X.decibels("p").alias("power_db"))
    return rounded(D2.picture_limits(c), 6, "low_db", "high_db")


@query(
    f"WITH {EM} SELECT source_id, row_id, CAST(floor((timestamp - 1704067200e0) * 2e6 / 512) AS BIGINT) AS first_frame, CAST(floor((timestamp - 1704067200e0 + duration_s) * 2e6 / 512) AS BIGINT) AS last_frame, frequency_hz - 6250e0 AS low_hz, frequency_hz + 6250e0 AS high_hz, CASE WHEN pmr_channel IS NOT NULL THEN 'PMR' || pmr_channel ELSE format('{{:.5f}}', frequency_hz / 1e6) END AS label FROM em"
)
def detection_overlay(spark, sf):
    e = emissions(spark, sf).withColumns({"offset_s": F.col("timestamp") - 1_704_067_200.0, "capture_id": F.struct("source_id", "row_id")})
    return D2.overlay(e, 2e6).select("capture_id.*", "first_frame", "last_frame", "low_hz", "high_hz", "label")


# Whole event documents: the track of each emission and a ring for each of its percentiles.

_TIME = lambda x: f"strftime(make_timestamp(CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.') || left(strftime(make_timestamp(CAST(floor(({x}) * 1e6 + 0.5) AS BIGINT)), '%f'), 2) || 'Z'"
_ENDS = f"""' time="' || {_TIME("timestamp + duration_s")} || '" start="' || {_TIME("timestamp")} || '" stale="' || {_TIME("timestamp + duration_s + 300")} || '">'"""
_HEADER = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><event version="2.0" uid="'
_POINT = "'<point lat=\"48.1000000\" lon=\"11.5000000\" hae=\"520.0\" ce=\"' || {} || '\" le=\"9999999.0\"/>'"


@query(
    f"""WITH {EM}, m AS (SELECT *, (row_id % 40) * 50e0 AS dev, row_id % 3 = 0 AS calibrated, CASE WHEN row_id % 7 = 0 THEN 'SPLATTER' END AS attribution, frequency_hz + 12500e0 AS attributed_to_hz, -floor(-peak_power_dbfs) AS power,
  CASE WHEN row_id % 5 > 0 THEN 100e0 + row_id % 900 END AS r50, CASE WHEN row_id % 5 > 0 THEN 3000e0 + row_id % 700 END AS r95 FROM em),
n AS (SELECT *, CASE WHEN pmr_channel IS NOT NULL THEN 'PMR' || pmr_channel ELSE format('{{:.5f}}', frequency_hz / 1e6) END || '/' || CASE WHEN ctcss_tone_hz IS NOT NULL THEN format('{{:.1f}}Hz', ctcss_tone_hz) ELSE 'no-tone' END AS label,
  'BAND.' || CASE WHEN pmr_channel IS NOT NULL THEN 'PMR' || pmr_channel ELSE format('{{:.0f}}', frequency_hz) END || '.' || CASE WHEN ctcss_tone_hz IS NOT NULL THEN format('{{:.1f}}', ctcss_tone_hz) ELSE 'notone' END AS uid FROM m),
t AS (SELECT row_id, 0 AS place, '{_HEADER}' || uid || '" type="' || CASE WHEN abs(ctcss_tone_hz - 70.5e0) < 0.5e0 THEN 'a-f-G' ELSE 'a-u-G' END || '" how="m-c"' || {_ENDS} || {_POINT.format("format('{:.1f}', coalesce(r95, 9999999e0))")} || '<detail><contact callsign="' || label || '"/><remarks>'
  || concat_ws(' | ', format('{{:.5f}} MHz', frequency_hz / 1e6), CASE WHEN pmr_channel IS NOT NULL THEN 'PMR' || pmr_channel ELSE 'off-grid' END, format('{{:.1f}} s', duration_s), format('SNR {{:.1f}} dB', snr_db), format('peak {{:.1f}} dBFS', power), format('dev {{:.0f}} Hz', dev),
     CASE WHEN ctcss_tone_hz IS NOT NULL THEN format('CTCSS {{:.1f}} Hz', ctcss_tone_hz) ELSE 'no CTCSS' END, CASE WHEN attribution IS NOT NULL THEN format('SPLATTER of an emission at {{:.5f}} MHz', attributed_to_hz / 1e6) END,
     CASE WHEN r50 IS NULL THEN 'RANGE UNKNOWN: power is uncalibrated' WHEN NOT calibrated THEN format('RANGE UNCALIBRATED: {{:.0f}} m from an assumed model, not a measurement', r50) ELSE format('range {{:.0f}} m (median)', r50) END, 'bearing not measured: single omnidirectional sensor')
  || '</remarks><measurement frequency_hz="' || format('{{:.1f}}', frequency_hz) || '" pmr_channel="' || coalesce(CAST(pmr_channel AS VARCHAR), '') || '" snr_db="' || format('{{:.2f}}', snr_db) || '" peak_power_dbfs="' || format('{{:.2f}}', power) || '" peak_deviation_hz="' || format('{{:.1f}}', dev)
  || '" ctcss_tone_hz="' || coalesce(format('{{:.1f}}', ctcss_tone_hz), '') || '" duration_s="' || format('{{:.3f}}', duration_s) || '" calibrated="' || calibrated || '" attribution="' || coalesce(attribution, '') || '"/></detail></event>' AS event FROM n),
g AS (SELECT *, unnest([50, 95]) AS pct, unnest([r50, r95]) AS r FROM n WHERE r50 IS NOT NULL)
SELECT * FROM t UNION ALL
SELECT row_id, CASE WHEN pct = 50 THEN 1 ELSE 2 END, '{_HEADER}' || uid || '.p' || pct || '" type="u-d-r" how="m-g"' || {_ENDS} || {_POINT.format("format('{:.1f}', r)")} || '<detail><remarks>' || label || ' is within ' || format('{{:.0f}}', r) || ' m with ' || pct || ' % credibility, '
  || CASE WHEN calibrated THEN 'from a calibrated level' ELSE 'from the model&apos;s assumed level, which nobody has calibrated' END || '; its direction is unknown</remarks><link uid="' || uid || '" type="a-f-G" relation="p-p" production_time="' || {_TIME("timestamp + duration_s")}
  || '"/><shape><ellipse major="' || format('{{:.1f}}', r) || '" minor="' || format('{{:.1f}}', r) || '" angle="0"/></shape><color argb="' || CASE WHEN pct = 50 THEN '-2130706688' ELSE '-2130771968' END || '"/></detail></event>' FROM g"""
)
def event_documents(spark, sf):
    """The published format as a whole: tracks with and without a range, calibrated or not, and their rings."""
    k = F.col("row_id")
    ranges = F.when(k % 5 > 0, F.create_map(F.lit(50), 100.0 + k % 900, F.lit(95), 3_000.0 + k % 700))
    e = emissions(spark, sf).withColumns(
        {
            "peak_deviation_hz": (k % 40) * 50.0,
            "calibrated": k % 3 == 0,
            "attribution": F.when(k % 7 == 0, "SPLATTER"),
            "attributed_to_hz": F.col("frequency_hz") + 12_500.0,
            "peak_power_dbfs": -F.floor(-F.col("peak_power_dbfs")).cast("double"),
            "classification": X.classify("ctcss_tone_hz", 70.5),
            "range_m": ranges,
        }
    )
    told = P.events(e, P.Site(48.1, 11.5, 520.0))
    return told.select("row_id", F.posexplode("events").alias("place", "event"))


# Stores: every event as a report, written to a new store in the shared folder and read back.

_REPORTS = f"""{EM}, rep AS (SELECT row_id, timestamp, frequency_hz, pmr_channel, CAST(row_id % 160 AS INTEGER) AS bin_index, duration_s, peak_power_dbfs, snr_db, CASE WHEN row_id % 3 > 0 THEN peak_power_dbfs - 40e0 END AS estimated_dbm, row_id % 3 > 0 AS calibrated, ctcss_tone_hz,
  CASE WHEN abs(ctcss_tone_hz - 70.5e0) < 0.5e0 THEN 'FRIEND' ELSE 'UNKNOWN' END AS classification, timestamp - 1704067200e0 AS offset_s, (row_id % 40) * 50e0 AS peak_deviation_hz, CASE WHEN row_id % 4 > 0 THEN 8e0 * (row_id % 5) END AS lna_db, CASE WHEN row_id % 4 > 0 THEN 2e0 * (row_id % 7) END AS vga_db,
  CASE WHEN row_id % 4 > 0 THEN row_id % 2 = 1 END AS amp_enabled, CASE WHEN row_id % 7 = 0 THEN frequency_hz + 12500e0 END AS attributed_to_hz, CASE WHEN row_id % 7 = 0 THEN 'SPLATTER' END AS attribution FROM em)"""


def _reports(spark, sf) -> DataFrame:
    k = F.col("row_id")
    some = k % 4 > 0
    gains = F.when(some, F.struct((8.0 * (k % 5)).alias("lna_db"), (2.0 * (k % 7)).alias("vga_db"), (k % 2 == 1).alias("amp_enabled")))
    return emissions(spark, sf).select(
        "timestamp", "frequency_hz", "pmr_channel", (k % 160).cast("int").alias("bin_index"), "duration_s", "peak_power_dbfs", "snr_db",
        F.when(k % 3 > 0, F.col("peak_power_dbfs") - 40.0).alias("estimated_dbm"), (k % 3 > 0).alias("calibrated"), "ctcss_tone_hz", X.classify("ctcss_tone_hz", 70.5).alias("classification"),
        (F.col("timestamp") - 1_704_067_200.0).alias("offset_s"), ((k % 40) * 50.0).alias("peak_deviation_hz"), gains.alias("gains"),
        F.when(k % 7 == 0, F.col("frequency_hz") + 12_500.0).alias("attributed_to_hz"), F.when(k % 7 == 0, "SPLATTER").alias("attribution"),
    )


def _plain(path: str) -> str:
    """A path of the local file system without its scheme, which SQLite and Arrow want."""
    return path.removeprefix("file://").removeprefix("file:")


def _stored(spark, sf, extension: str) -> DataFrame:
    path = f"{new_path(spark)}/store.{extension}"
    if extension == "db":
        path = _plain(path)
        if "://" in path:
            raise ValueError("a SQLite store needs a file system")
    reports = _reports(spark, sf)
    if extension == "db":
        reports = reports.repartition(4 * spark.sparkContext.defaultParallelism, "timestamp")  # parts are written row by row: a small file would be one task
    store.write_reports(reports, path)
    back = store.read_reports(spark, path)
    return back.select("*", "gains.*").drop("row_id", "gains")


@query(f"WITH {_REPORTS} SELECT * EXCLUDE (row_id) FROM rep")
def store_single_file(spark, sf):
    return _stored(spark, sf, "db")


@query(f"WITH {_REPORTS} SELECT * EXCLUDE (row_id) FROM rep")
def store_lines(spark, sf):
    return _stored(spark, sf, "jsonl")


@query(f"WITH {_REPORTS} SELECT * EXCLUDE (row_id) FROM rep")
def store_columns(spark, sf):
    return _stored(spark, sf, "parquet")


@query(f"WITH {_REPORTS} SELECT pmr_channel, count(*) AS n, round(sum(duration_s), 4) AS airtime_s FROM rep WHERE snr_db >= 20e0 AND classification = 'UNKNOWN' GROUP BY 1")
def store_query(spark, sf):
    """Parameters bound to SQL over a store."""
    path = f"{new_path(spark)}/store.parquet"
    store.write_reports(_reports(spark, sf), path)
    found = store.store_sql(spark, path, "SELECT pmr_channel, count(*) AS n, sum(duration_s) AS airtime_s FROM emissions WHERE snr_db >= :least AND classification = :kind GROUP BY 1", least=20.0, kind="UNKNOWN")
    return rounded(found, 4, "airtime_s")


@query(f"WITH {_REPORTS} SELECT row_id % 10 <> 3 AS good, count(*) AS n, round(sum(CASE WHEN row_id % 10 <> 3 THEN duration_s END), 4) AS airtime_s FROM rep GROUP BY 1")
def archive_recovery(spark, sf):
    """An archive of lines of which every tenth was cut while it was written."""
    path = new_path(spark)
    lines = _reports(spark, sf).select("offset_s", F.to_json(F.struct("*")).alias("line"), F.round(F.col("bin_index") % 10).alias("k"))
    lines.select(F.when(F.col("k") == 3, F.expr("left(line, length(line) - 7)")).otherwise(F.col("line")).alias("value")).write.mode("append").text(path)
    good, bad = store.read_jsonl(spark, path)
    told = good.agg(F.lit(True).alias("good"), F.count("*").alias("n"), F.round(F.sum("duration_s"), 4).alias("airtime_s"))
    return told.unionByName(bad.agg(F.lit(False).alias("good"), F.count("*").alias("n"), F.lit(None).cast("double").alias("airtime_s")))


# The order of battle as a whole: by-products first, then emitters of what is left, then by-products with their emitter.

_BATTLE = f"""WITH RECURSIVE {EM}, {_PAIRS}, {_SPLATTER}, {_INTERMOD},
told AS MATERIALIZED (SELECT em.*, coalesce(spl.parent_hz, imd.parent_hz) AS attributed_to_hz, CASE WHEN spl.row_id IS NOT NULL THEN 'SPLATTER' WHEN imd.row_id IS NOT NULL THEN 'INTERMOD3' END AS attribution FROM em LEFT JOIN spl USING (row_id) LEFT JOIN imd USING (row_id)),
own AS MATERIALIZED (SELECT * FROM told WHERE attribution IS NULL), {_fold("own")},
m AS MATERIALIZED (SELECT own.*, profile_id, timestamp - lag(timestamp + duration_s) OVER (PARTITION BY profile_id ORDER BY timestamp, own.row_id) AS gap,
  timestamp < max(timestamp + duration_s) OVER (PARTITION BY profile_id ORDER BY timestamp, own.row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS together FROM own JOIN r ON r.row_id = own.row_id),
prof AS MATERIALIZED (SELECT profile_id, count(*) AS transmissions, sum(duration_s) AS airtime_s, min(timestamp) AS first_seen, max(timestamp + duration_s) AS last_seen, median(frequency_hz) AS mf, median(peak_power_dbfs) AS mp, coalesce(median(CASE WHEN gap >= 0 THEN gap END), 0) AS mg, max(coalesce(together, false)) AS proven_multiple FROM m GROUP BY 1),
prod AS MATERIALIZED (SELECT d.row_id, d.frequency_hz, d.peak_power_dbfs, d.attribution, p.profile_id, p.mf, p.mp FROM told d JOIN prof p ON abs(p.mf - d.attributed_to_hz) <= 3000e0 WHERE d.attribution IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d.row_id ORDER BY abs(p.mf - d.attributed_to_hz), p.first_seen, p.profile_id) = 1)"""


def _battle(spark, sf) -> dict[str, DataFrame]:
    from .reports import order_of_battle

    return order_of_battle(emissions(spark, sf))


@query(
    f"{_BATTLE}, c AS (SELECT profile_id, count(*) AS products FROM prod GROUP BY 1) SELECT profile_id, CASE WHEN f.pmr_channel IS NOT NULL THEN 'PMR' || f.pmr_channel ELSE format('{{:.5f}}', f.frequency_hz / 1e6) END || '/' || CASE WHEN f.ctcss_tone_hz IS NOT NULL THEN format('{{:.1f}}Hz', f.ctcss_tone_hz) ELSE 'no-tone' END AS label, f.pmr_channel, f.ctcss_tone_hz, transmissions, round(airtime_s, 3) AS airtime_s, round(mf, 3) AS median_frequency_hz, round(mp, 4) AS median_power_dbfs, round(mg, 3) AS median_gap_s, round(CASE WHEN last_seen > first_seen THEN airtime_s / (last_seen - first_seen) ELSE 0 END, 6) AS duty_cycle, proven_multiple, NOT proven_multiple AS count_is_lower_bound, coalesce(products, 0) AS products FROM prof JOIN own f ON f.row_id = profile_id LEFT JOIN c USING (profile_id)"
)
def battle_emitters(spark, sf):
    from .reports import emitter_rows

    places = {"airtime_s": 3, "median_frequency_hz": 3, "median_power_dbfs": 4, "median_gap_s": 3, "duty_cycle": 6}
    out = emitter_rows(_battle(spark, sf), places)
    return out.select("profile_id", "label", "pmr_channel", "ctcss_tone_hz", "transmissions", *places, "proven_multiple", "count_is_lower_bound", "products")


@query(f"{_BATTLE} SELECT profile_id, row_id, frequency_hz, round(frequency_hz - mf, 3) AS offset_hz, round(peak_power_dbfs - mp, 4) AS dbc, attribution FROM prod")
def battle_products(spark, sf):
    from .reports import product_rows

    return rounded(rounded(product_rows(_battle(spark, sf)), 3, "offset_hz"), 4, "dbc")


@query(
    f"{_BATTLE} SELECT (SELECT count(*) FROM told) AS detections, (SELECT count(*) FROM prof) AS emitters, (SELECT CAST(sum(transmissions) AS BIGINT) FROM prof) AS emissions, (SELECT count(*) FROM prod) AS products, round(sum(duration_s), 3) AS airtime_s, round(max(timestamp + duration_s) - min(timestamp), 3) AS window_s, round(sum(duration_s) / (max(timestamp + duration_s) - min(timestamp)), 6) AS duty_cycle FROM own"
)
def battle_summary(spark, sf):
    from .reports import summary

    return rounded(rounded(summary(_battle(spark, sf)), 3, "airtime_s", "window_s"), 6, "duty_cycle")


# Captures: the embeddings as samples, 32 of each vector, written as raw files by blocks and read back.


def _capture_sql(form: str, scale: float) -> str:
    if form == "cf32":
        return f"SELECT '{form}' AS form, vec_id * 32 + i AS sample, CAST(embedding[2 * i + 1] AS DOUBLE) AS re, CAST(embedding[2 * i + 2] AS DOUBLE) AS im FROM embeddings, range(0, 32) AS r(i)"
    code = f"round_even(CAST(embedding[2 * i + {{}}] AS FLOAT) / p * CAST({scale - 1} AS FLOAT), 0) / {scale}e0 + 0e0"
    return f"SELECT '{form}' AS form, vec_id * 32 + i AS sample, CAST({code.format(1)} AS DOUBLE) AS re, CAST({code.format(2)} AS DOUBLE) AS im FROM embeddings, range(0, 32) AS r(i), (SELECT CAST(max(greatest(list_max(embedding), -list_min(embedding))) AS FLOAT) AS p FROM embeddings)"


@query(f"SELECT form, sample, re, im FROM ({' UNION ALL '.join(_capture_sql(f, s) for f, (_, s) in I.FORMATS.items())})")
def capture_files(spark, sf):
    """Every on-disk format: encoding and its peak, segments, reading by byte range, decoding."""
    settings = S.Settings(num_channels=64, decimation=32)
    v = table(spark, sf, "embeddings")
    blocks = v.select(F.lit("c").alias("capture_id"), (F.col("vec_id") * 32).alias("start_sample"), F.lit(0.0).alias("start_time"), F.col("embedding").alias("iq"))
    every = None
    for form in I.FORMATS:
        folder = _plain(f"{new_path(spark)}/{form}")
        I.write_blocks(blocks, folder, form, segment_samples=8_192)
        x = I.read_iq(spark, folder, settings).select(F.lit(form).alias("form"), "start_sample", F.posexplode("iq").alias("i", "x"))
        x = x.groupBy("form", (F.col("start_sample") + F.floor(F.col("i") / 2)).alias("sample")).agg(*(F.max(F.when(F.col("i") % 2 == k, F.col("x").cast("double"))).alias(c) for k, c in enumerate(("re", "im"))))
        every = x if every is None else every.unionByName(x)
    return every


@query("SELECT vec_id // 256 AS block_idx, vec_id * 32 + i AS sample, CAST(embedding[2 * i + 1] AS DOUBLE) AS re FROM embeddings, range(0, 32) AS r(i) WHERE vec_id * 32 + i < 5000")
def capture_leading(spark, sf):
    """The first samples of a capture, over the ends of segments and of blocks."""
    settings = S.Settings(num_channels=64, decimation=32, hold_frames=256)
    v = table(spark, sf, "embeddings")
    folder = _plain(f"{new_path(spark)}/lead")
    I.write_blocks(v.select(F.lit("c").alias("capture_id"), (F.col("vec_id") * 32).alias("start_sample"), F.lit(0.0).alias("start_time"), F.col("embedding").alias("iq")), folder, "cf32", segment_samples=2_048)
    x = I.leading(I.read_iq(spark, folder, settings), 5_000).select("start_sample", F.posexplode("iq").alias("i", "x")).where("i % 2 = 0")
    sample = F.col("start_sample") + F.floor(F.col("i") / 2)
    return x.select(F.floor(sample / 8_192).alias("block_idx"), sample.alias("sample"), F.col("x").cast("double").alias("re"))


# Spectra of that capture: windowed transforms of 64 samples, 32 apart.

_SPECTRA = f"""x AS MATERIALIZED (SELECT vec_id * 32 + i AS n, CAST(embedding[2 * i + 1] AS DOUBLE) AS re, CAST(embedding[2 * i + 2] AS DOUBLE) AS im FROM embeddings, range(0, 32) AS r(i)),
w AS MATERIALIZED (SELECT i, v / sum(v) OVER () AS v FROM (SELECT i, 0.35875e0 - 0.48829e0 * cos(2 * pi() * i / 64) + 0.14128e0 * cos(4 * pi() * i / 64) - 0.01168e0 * cos(6 * pi() * i / 64) AS v FROM range(0, 64) AS r(i))),
fr AS (SELECT f FROM range(0, (SELECT CAST((max(n) + 1 - 64) // 32 + 1 AS BIGINT) FROM x)) AS r(f)),
sp AS MATERIALIZED (SELECT f, k AS bin, pow(sum(v * (re * cos(2 * pi() * (k * i % 64) / 64) + im * sin(2 * pi() * (k * i % 64) / 64))), 2) + pow(sum(v * (im * cos(2 * pi() * (k * i % 64) / 64) - re * sin(2 * pi() * (k * i % 64) / 64))), 2) AS p
  FROM fr, w, range(0, 64) AS b(k) JOIN x ON x.n = f * 32 + i GROUP BY 1, 2)"""
_PLACE = "446593750e0 + (CASE WHEN bin < 32 THEN bin ELSE bin - 64 END) * (2e6 / 64)"


def _capture(spark, sf) -> DataFrame:
    """The embeddings as one capture on disk, read back in blocks."""
    settings = S.Settings(num_channels=64, decimation=32, hold_frames=256)
    v = table(spark, sf, "embeddings")
    folder = _plain(f"{new_path(spark)}/cap")
    I.write_blocks(v.select(F.lit("c").alias("capture_id"), (F.col("vec_id") * 32).alias("start_sample"), F.lit(0.0).alias("start_time"), F.col("embedding").alias("iq")), folder, "cf32", segment_samples=4_096)
    return I.read_iq(spark, folder, settings)


@query(f"WITH {_SPECTRA}, m AS (SELECT bin, 10 * log10(greatest(avg(p), 1e-300)) AS power_db FROM sp GROUP BY 1), fl AS (SELECT median(power_db) AS floor_db FROM m) SELECT {_PLACE} AS frequency_hz, round(power_db, 5) AS power_db, round(floor_db, 5) AS floor_db, power_db > floor_db + 1 AS occupied FROM m, fl")
def capture_survey(spark, sf):
    return rounded(D2.survey(_capture(spark, sf), 2e6, 446_593_750.0, 64, 32).drop("capture_id"), 5, "power_db", "floor_db")


@query(f"WITH {_SPECTRA} SELECT f AS frame, CAST(bin AS INTEGER) AS bin, {_PLACE} AS frequency_hz, round(10 * log10(greatest(p, 1e-30)), 4) AS power_db FROM sp")
def capture_spectrogram(spark, sf):
    """All frames of a capture's picture; a screen would thin them evenly."""
    blocks = _capture(spark, sf)
    total = blocks.agg(F.sum("n")).first()[0]
    return rounded(D2.spectrogram(blocks, 2e6, 446_593_750.0, total, 64, 32, max_frames=total).drop("capture_id"), 4, "power_db")


# Detection in that capture: the filter bank and the threshold over held noise, as in the chain from samples to emissions.

_BANK = S.Settings(num_channels=64, decimation=32, pfa=1e-2)
_TAPS = ", ".join(repr(float(x)) for x in dsp.prototype(_BANK))
_FACTOR = repr(D.os_factor(1e-2))
_OUT = ", ".join(map(str, _BANK.excluded_bins()))


@query(
    f"""WITH {_SPECTRA.partition("w AS")[0]}
h AS MATERIALIZED (SELECT i - 1 AS i, [{_TAPS}][i] AS v FROM range(1, 769) AS r(i)),
fr AS (SELECT f FROM range(0, (SELECT CAST((max(n) + 1 - 768) // 32 + 1 AS BIGINT) FROM x)) AS r(f)),
fold AS MATERIALIZED (SELECT f, i % 64 AS j, sum(v * re) AS re, sum(v * im) AS im FROM fr, h JOIN x ON x.n = f * 32 + i GROUP BY 1, 2),
c AS MATERIALIZED (SELECT f, k AS bin, pow(sum(re * cos(2 * pi() * (k * j % 64) / 64) + im * sin(2 * pi() * (k * j % 64) / 64)), 2) + pow(sum(im * cos(2 * pi() * (k * j % 64) / 64) - re * sin(2 * pi() * (k * j % 64) / 64)), 2) AS p FROM fold, range(0, 64) AS b(k) GROUP BY 1, 2),
o(d) AS (VALUES {_REFS}),
a AS MATERIALIZED (SELECT q.f // 64 AS hold, q.bin, list_sort(list(r.p))[18] AS held FROM c q CROSS JOIN o JOIN c r ON r.f = q.f AND r.bin = ((q.bin + o.d) % 64 + 64) % 64 WHERE q.f % 64 = 0 GROUP BY 1, 2),
l AS MATERIALIZED (SELECT c.f, coalesce(avg(CASE WHEN p < 8 * held THEN p END), avg(p)) AS level FROM c JOIN a ON a.hold = c.f // 64 AND a.bin = c.bin GROUP BY 1),
n AS (SELECT c.f, c.bin, p, held * l.level / m.level AS noise FROM c JOIN a ON a.hold = c.f // 64 AND a.bin = c.bin JOIN l ON l.f = c.f JOIN l m ON m.f = c.f // 64 * 64)
SELECT f AS frame, CAST(bin AS INTEGER) AS bin, round(10 * log10(p), 1) AS power_db, round(10 * log10(p / noise), 1) AS snr_db FROM n WHERE p > noise * {_FACTOR}::DOUBLE AND bin NOT IN ({_OUT})"""
)
def capture_detections(spark, sf):
    v = table(spark, sf, "embeddings")
    folder = _plain(f"{new_path(spark)}/det")
    I.write_blocks(v.select(F.lit("c").alias("capture_id"), (F.col("vec_id") * 32).alias("start_sample"), F.lit(0.0).alias("start_time"), F.col("embedding").alias("iq")), folder, "cf32")
    hits = D2.detect(I.read_iq(spark, folder, _BANK), _BANK)
    level = lambda x: F.round(10 * F.log10(x), 1)  # noqa: E731; the kernel works in single precision
    return hits.select("frame", "bin", level(F.col("power")).alias("power_db"), level(F.col("power") / F.col("noise")).alias("snr_db"))


# The tracker as a stream: hits arrive in four steps, and a mark after the last closes what is open.


@query(
    f"""WITH {CELLS}, hit AS (SELECT * FROM cells WHERE power > 2e-2), r AS (SELECT bin, frame, power, sum(fresh) OVER (PARTITION BY bin ORDER BY frame ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY bin ORDER BY frame) <= 2 THEN 0 ELSE 1 END AS fresh FROM hit))
SELECT CAST(bin AS INTEGER) AS bin, min(frame) AS start_frame, max(frame) AS end_frame, round(max(power), 6) AS peak_power, round(avg(power), 6) AS mean_power, count(*) AS detected_frames
FROM r GROUP BY bin, run HAVING max(frame) - min(frame) + 1 >= 3 AND count(*) / (max(frame) - min(frame) + 1) >= 0.35e0"""
)
def tracked_stream(spark, sf):
    from ..streaming.tracker import OUT, track_stream

    settings = S.Settings(sample_rate=32_000.0, num_channels=64, decimation=32, hangover_frames=2, min_frames=3, max_frames=1 << 40)  # a frame is a millisecond
    place = new_path(spark)
    kept = "capture_id string, bin int, frame long, power double, noise double, left_power double, right_power double, frame_ts timestamp"
    hits = frames(spark, sf).select("frame", F.posexplode("power").alias("bin", "power")).where("power > 2e-2")
    hits = hits.select(F.lit("c").alias("capture_id"), "bin", "frame", "power", F.lit(1e-2).alias("noise"), *(F.lit(0.0).alias(c) for c in ("left_power", "right_power")), F.timestamp_millis(F.col("frame") + 1_700_000_000_000).alias("frame_ts"))
    top = frames(spark, sf).agg(F.coalesce(F.max("frame"), F.lit(0))).first()[0] + 1
    for step in range(4):  # files in the order of time, as a receiver writes them
        hits.where((F.col("frame") >= top * step // 4) & (F.col("frame") < top * (step + 1) // 4)).coalesce(1).write.mode("append").parquet(f"{place}/in")
    mark = spark.range(1).select(F.lit("c").alias("capture_id"), F.lit(D2.NO_BIN).alias("bin"), F.lit(top + 100).cast("long").alias("frame"), *(F.lit(0.0).alias(c) for c in ("power", "noise", "left_power", "right_power")), F.timestamp_millis(F.lit(top + 100 + 1_700_000_000_000)).alias("frame_ts"))
    mark.write.mode("append").parquet(f"{place}/in")
    stream = spark.readStream.schema(kept).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    q = track_stream(stream, settings).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/mark").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema(OUT).parquet(f"{place}/out")
    return rounded(out.select("bin", "start_frame", "end_frame", "peak_power", "mean_power", "detected_frames"), 6, "peak_power", "mean_power")
