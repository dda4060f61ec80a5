"""From samples to emissions: Arrow kernels between declarative steps. No sample leaves identification."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import dsp
from ..functions.expr import bin_frequency, channel_at, classify, decibels, place_name
from .cells import ca_factor, os_factor
from .clustering import bin_groups
from .occupancy import percentiles
from .sessions import cut_at_silence, tracked
from .staging import staged

#: Frames in a slice of a capture, about 42 s at the default rate, over which its emissions are spread to find islands.
SLICE_FRAMES = 1 << 20


def synthesise(spark: SparkSession, scene: dsp.Scenario, settings: S.Settings, start_time: float = 0.0, capture_id: str = "scene") -> tuple[DataFrame, DataFrame]:
    """Blocks of a synthetic scene, made where they are used, and its truth."""
    from ..sources.iq import block_samples

    size, total = block_samples(settings), int(scene.duration_s * scene.sample_rate)

    def run(batches):
        for batch in batches:
            for b in batch.column(0).to_pylist():
                n = min(size, total - b * size)
                x = np.ascontiguousarray(scene.block(b * size, n)).view(np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([capture_id]), pa.array([b], pa.int64()), pa.array([b * size], pa.int64()), pa.array([n], pa.int32()), pa.array([start_time]), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))],
                    names=["capture_id", "block_idx", "start_sample", "n", "start_time", "iq"],
                )

    blocks = spark.range(-(-total // size)).mapInArrow(run, S.IQ_DDL)
    return blocks, spark.createDataFrame(scene.truth(), S.TRUTH_DDL)


def with_halo(blocks: DataFrame, samples: int) -> DataFrame:
    """Add the first samples of the following block, by an equi-join on block numbers that spreads a capture over all tasks.

    Blocks that were read with their halo stay as they are.
    """
    if "halo" in blocks.columns:
        return blocks
    head = blocks.select("capture_id", (F.col("block_idx") - 1).alias("block_idx"), F.slice("iq", 1, 2 * samples).alias("halo"))
    return blocks.join(head, ["capture_id", "block_idx"], "left")


def _complex(column, i: int) -> np.ndarray:
    value = column[i]
    return np.asarray(value.values, dtype=np.float32).view(np.complex64) if value.is_valid else np.zeros(0, np.complex64)


#: The bin of a mark that isn't a hit.
NO_BIN = -1


def detect(blocks: DataFrame, settings: S.Settings, ends: bool = False) -> DataFrame:
    """Hit cells (capture_id, start_time, frame, bin, power, noise, left_power, right_power); the spectra stay in the kernel.

    With ``ends`` each block that is the ``last`` of its capture adds a mark: a row of ``NO_BIN`` two hangovers after the capture's end.
    """
    bank = dsp.Channelizer(settings)
    factor = os_factor(settings.pfa, settings.reference_cells, settings.order_statistic) if settings.method == "os" else ca_factor(settings.pfa, settings.reference_cells)
    names = ["capture_id", "start_time", "frame", "bin", "power", "noise", "left_power", "right_power"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.concatenate((_complex(batch.column(4), i), _complex(batch.column(5), i)))
                start, n = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                first, spectra = bank.frames(x, start, start + n)
                if ends and batch.column(6)[i].as_py():
                    after = (start + n) // settings.decimation + 2 * settings.hangover_frames + int(settings.frame_rate / 100) + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()], pa.string()), pa.array([batch.column(1)[i].as_py()], pa.float64()), pa.array([after], pa.int64()), pa.array([NO_BIN], pa.int32()), *(pa.array([0.0]) for _ in range(4))], names=names
                    )
                if not len(spectra):
                    continue
                power = (spectra.real**2 + spectra.imag**2).astype(np.float64)
                hit, noise = dsp.cfar(power, first, settings, factor)
                f, b = np.nonzero(hit)
                m = settings.num_channels
                k = len(f)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[i].as_py()] * k, pa.string()), pa.array([batch.column(1)[i].as_py()] * k, pa.float64()), pa.array(f + first, pa.int64()), pa.array(b, pa.int32()), *(pa.array(v) for v in (power[f, b], noise[f, b], power[f, (b - 1) % m], power[f, (b + 1) % m]))],
                    names=names,
                )

    ready = with_halo(blocks, bank.halo).select("capture_id", "start_time", "start_sample", "n", "iq", "halo", *(["last"] if ends else []))
    return ready.mapInArrow(run, "capture_id string, start_time double, frame long, bin int, power double, noise double, left_power double, right_power double")


def emissions_of(hits: DataFrame, settings: S.Settings) -> DataFrame:
    """Tracked emissions with their groups of adjacent bins: one row for each group. The tracked ones are written to the shared folder first."""
    t = staged(tracked(hits, settings.hangover_frames, settings.min_frames, settings.max_frames, settings.min_occupancy, ["capture_id", "start_time"]))
    # Groups can't span a time in which nothing is on air, so such islands are merged apart.
    t = cut_at_silence(t, ["capture_id"], "start_frame", "end_frame", SLICE_FRAMES)
    keys = ["capture_id", "start_time", "island"]
    grouped = bin_groups(t, settings.num_channels, keys)
    m = settings.num_channels
    lead = F.max_by("bin", F.struct("mean_power", -F.col("bin"))).over(Window.partitionBy(*keys, "group_id"))
    g = grouped.withColumn("lead", lead)
    offset = F.pmod(F.col("bin") - F.col("lead") + m // 2, F.lit(m)) - m // 2
    own = F.max_by(F.struct("left_power", "mean_power", "right_power", "mean_noise", "peak_power"), F.struct("mean_power", -F.col("bin")))
    g = g.groupBy(*keys, "group_id", "lead").agg(
        F.min("start_frame").alias("start_frame"), F.max("end_frame").alias("end_frame"), F.count("*").alias("bins"), own.alias("o"), (F.sum(F.col("mean_power") * offset) / F.sum("mean_power")).alias("centroid")
    )
    from ..functions.expr import peak_offset_bins

    spacing = settings.sample_rate / m
    single = peak_offset_bins(F.col("o.left_power"), F.col("o.mean_power"), F.col("o.right_power"))
    f = bin_frequency("lead", m, settings.sample_rate, settings.centre_hz) + F.when(F.col("bins") == 1, single).otherwise(F.col("centroid")) * spacing
    return g.select(
        F.xxhash64("capture_id", "lead", "start_frame").alias("row_id"),
        "capture_id",
        (F.col("start_time") + F.col("start_frame") / settings.frame_rate).alias("timestamp"),
        f.alias("frequency_hz"),
        channel_at(f).alias("pmr_channel"),
        F.col("lead").alias("bin_index"),
        ((F.col("end_frame") - F.col("start_frame") + 1) / settings.frame_rate).alias("duration_s"),
        decibels(F.col("o.peak_power")).alias("peak_power_dbfs"),
        (10 * F.log10(F.col("o.mean_power") / F.greatest(F.col("o.mean_noise"), F.lit(1e-300)))).alias("snr_db"),
        (F.col("start_frame") / settings.frame_rate).alias("offset_s"),
        "start_frame",
        "end_frame",
    )


def identify(emissions: DataFrame, blocks: DataFrame, settings: S.Settings, friend_hz: float | None = None) -> DataFrame:
    """Add tone, classification and peak deviation. The channel's samples exist only between the two kernels; they aren't columns of the result.

    Emissions meet the blocks they touch by block number; the filter bank runs over their frames alone, once for the bins wanted there.
    What an emission gathers is named by capture, bin and first frame; ``max_frames`` bounds it.
    """
    from ..sources.iq import block_samples

    bank, size, d = dsp.Channelizer(settings), block_samples(settings), settings.decimation
    touched = F.sequence(F.floor(F.col("start_frame") * d / size), F.floor(F.col("end_frame") * d / size))
    wanted = emissions.select("capture_id", "bin_index", "start_frame", "end_frame", F.explode(touched).alias("block_idx"))
    per_block = wanted.groupBy("capture_id", "block_idx").agg(F.collect_list(F.struct("start_frame", "end_frame", "bin_index")).alias("wanted"))
    names = ["capture_id", "bin_index", "start_frame", "frame", "part"]
    types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def cut(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.concatenate((_complex(batch.column(2), i), _complex(batch.column(3), i)))
                start = batch.column(0)[i].as_py()
                own = [(w["start_frame"], w["end_frame"], w["bin_index"]) for w in batch.column(4)[i].as_py()]
                capture = batch.column(5)[i].as_py()
                found = bank.bins(x, start, start + batch.column(1)[i].as_py(), own)
                rows = [(capture, k, lo, first, part.tobytes()) for (lo, _, k), (first, part) in zip(own, found, strict=True) if len(part)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def tell(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        iq = np.frombuffer(b"".join(pdf.sort_values("frame")["part"]), dtype=np.complex64)
        peak, _ = dsp.deviation(iq, settings.frame_rate)
        tone, *_ = dsp.find_tone(dsp.discriminate(iq, settings.frame_rate) / dsp.MAX_DEVIATION_HZ, settings.frame_rate)
        return pd.DataFrame({"capture_id": [key[0]], "bin_index": [key[1]], "start_frame": [key[2]], "ctcss_tone_hz": [tone], "peak_deviation_hz": [peak]})

    ready = with_halo(blocks, bank.halo).join(per_block, ["capture_id", "block_idx"]).select("start_sample", "n", "iq", "halo", "wanted", "capture_id")
    of = ["capture_id", "bin_index", "start_frame"]
    parts = ready.mapInArrow(cut, "capture_id string, bin_index int, start_frame long, frame long, part binary")
    told = parts.groupBy(*of).applyInPandas(tell, "capture_id string, bin_index int, start_frame long, ctcss_tone_hz double, peak_deviation_hz double")
    return emissions.join(told, of, "left").withColumn("classification", classify("ctcss_tone_hz", friend_hz))


def run_capture(blocks: DataFrame, settings: S.Settings, friend_hz: float | None = None, calibrations: DataFrame | None = None, gain_key: str | None = None) -> DataFrame:
    """The whole chain for captures: emission rows with the columns of the store."""
    from .calibration import to_dbm

    found = staged(emissions_of(detect(blocks, settings), settings))
    e = identify(found, blocks, settings, friend_hz).withColumn("gain_key", F.lit(gain_key).cast("string"))
    e = to_dbm(e, calibrations) if calibrations is not None else e.withColumns({"estimated_dbm": F.lit(None).cast("double"), "calibrated": F.lit(False)})
    gains = F.lit(None).cast("struct<lna_db: double, vga_db: double, amp_enabled: boolean>")
    return e.withColumns({"gains": gains, "attributed_to_hz": F.lit(None).cast("double"), "attribution": F.lit(None).cast("string")}).drop("start_frame", "end_frame", "gain_key")


def survey(blocks: DataFrame, rate: float, centre_hz: float, size: int = 1_024, hop: int = 512) -> DataFrame:
    """Mean power spectrum (frequency_hz, power_db, floor_db) of each capture: sums of each block, then one small aggregation."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.concatenate((_complex(batch.column(2), i), _complex(batch.column(3), i)[: size - hop]))
                total, n = dsp.survey_sum(x, size, hop)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * size), pa.array(np.arange(size), pa.int32()), pa.array(total), pa.array([n] * size, pa.int64())], names=["capture_id", "bin", "power", "frames"])

    ready = with_halo(blocks, size - hop).select("capture_id", "n", "iq", "halo")
    sums = ready.mapInArrow(run, "capture_id string, bin int, power double, frames long").groupBy("capture_id", "bin").agg((F.sum("power") / F.sum("frames")).alias("p"))
    return over_floor(sums.select("capture_id", bin_frequency("bin", size, rate, centre_hz).alias("frequency_hz"), "p"), 1e-300)


def over_floor(spectrum: DataFrame, least: float = 1e-20, margin_db: float = 1.0) -> DataFrame:
    """Mean powers ``p`` by ``capture_id`` in dB, with the capture's median as its floor and whether they stand out. A spectrum has a fixed number of bins."""
    power = spectrum.withColumn("power_db", decibels("p", least)).drop("p")
    floors = power.groupBy(F.col("capture_id").alias("c__")).agg(F.median("power_db").alias("floor_db"))
    out = power.join(floors, F.col("capture_id").eqNullSafe(F.col("c__"))).drop("c__")
    return out.withColumn("occupied", F.col("power_db") > F.col("floor_db") + margin_db)


def reference_errors(spectra: DataFrame, nominal_hz: float, tuned_hz: float, kind: str = "notch", expected_hz: float = 7_610_000.0) -> DataFrame:
    """Frequency error of each capture's averaged spectrum (capture_id, frequency_hz, power): Hz and ppm, or why it was refused.

    A spectrum has a fixed number of bins, so a group fits a task whatever the capture's length.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frequency_hz")
        f, p = pdf["frequency_hz"].to_numpy(), pdf["power"].to_numpy()
        try:
            error = dsp.notch_offset(f, p, nominal_hz, tuned_hz) if kind == "notch" else dsp.flat_top_centre(f, p, expected_hz)[0] - nominal_hz
            return pd.DataFrame([(key[0], error, error / nominal_hz * 1e6, "ok")], columns=["capture_id", "error_hz", "error_ppm", "status"])
        except ValueError as e:
            return pd.DataFrame([(key[0], None, None, str(e))], columns=["capture_id", "error_hz", "error_ppm", "status"])

    return spectra.groupBy("capture_id").applyInPandas(run, "capture_id string, error_hz double, error_ppm double, status string")


def mean_error(errors: DataFrame, *keys: str) -> DataFrame:
    """Mean error over the captures that measured (by ``keys``), with its standard error (zero for one)."""
    good = errors.where("status = 'ok'")
    return good.groupBy(*keys).agg(F.avg("error_hz").alias("error_hz"), F.coalesce(F.stddev_samp("error_hz") / F.sqrt(F.count("*")), F.lit(0.0)).alias("standard_error_hz"), F.count("*").alias("captures"))


def spectrogram(blocks: DataFrame, rate: float, centre_hz: float, total_samples: int, size: int = 1_024, hop: int = 512, max_frames: int = 8_192) -> DataFrame:
    """Power by frame and frequency (capture_id, frame, bin, frequency_hz, power_db) for a picture of the whole capture.

    Frames are thinned evenly to at most ``max_frames``; none is cut off at the end.
    """
    frames = max(0, (total_samples - size) // hop + 1)
    stride = max(1, -(-frames // max_frames))
    window = dsp.blackman_harris(size)
    window = window / window.sum()

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.concatenate((_complex(batch.column(3), i), _complex(batch.column(4), i)))
                start, n = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                first = -(-start // (hop * stride))
                for f in range(first, -(-(start + n) // (hop * stride))):
                    at = f * hop * stride - start
                    if at + size > len(x):
                        break
                    p = np.abs(np.fft.fft(x[at : at + size] * window)) ** 2
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()] * size), pa.array([f * stride] * size, pa.int64()), pa.array(np.arange(size), pa.int32()), pa.array(p)], names=["capture_id", "frame", "bin", "power"])

    ready = with_halo(blocks, size).select("capture_id", "start_sample", "n", "iq", "halo")
    out = ready.mapInArrow(run, "capture_id string, frame long, bin int, power double")
    return out.select("capture_id", "frame", "bin", bin_frequency("bin", size, rate, centre_hz).alias("frequency_hz"), decibels("power", 1e-30).alias("power_db"))


def picture_limits(table: DataFrame) -> DataFrame:
    """Display range of a spectrogram: the 5th and 99.99th percentile, 3 dB wider; no task holds the cells."""
    found = percentiles(table, [], "power_db", {"low": 0.05, "high": 0.9999}, 0.25)
    return found.select((F.col("low") - 3).alias("low_db"), (F.col("high") + 3).alias("high_db"))


def overlay(emissions: DataFrame, rate: float, hop: int = 512, width_hz: float = S.CHANNEL_SPACING_HZ) -> DataFrame:
    """Rectangles of emissions over a spectrogram: first and last frame, the band about the measured frequency, and a label."""
    f = F.col("frequency_hz")
    return emissions.select(
        "capture_id",
        F.floor(F.col("offset_s") * rate / hop).alias("first_frame"),
        F.floor((F.col("offset_s") + F.col("duration_s")) * rate / hop).alias("last_frame"),
        (f - width_hz / 2).alias("low_hz"),
        (f + width_hz / 2).alias("high_hz"),
        place_name("frequency_hz", "pmr_channel").alias("label"),
        "snr_db",
    )


def by_snr(hits: DataFrame) -> DataFrame:
    """Hits by their signal-to-noise ratio, the highest first; of equals the lowest bin, then the earliest frame."""
    told = hits if "snr_db" in hits.columns else hits.withColumn("snr_db", 10 * F.log10(F.col("power") / F.greatest(F.col("noise"), F.lit(1e-300))))
    return told.orderBy(F.desc("snr_db"), "bin", "frame")


def channel_peaks(spectrum: DataFrame) -> DataFrame:
    """The highest power over the floor within half a channel of each channel's centre (channel, peak_over_floor_db)."""
    k = F.rint((F.col("frequency_hz") - S.CHANNEL_1_HZ) / S.CHANNEL_SPACING_HZ)
    inside = spectrum.where(k.between(0, S.CHANNEL_COUNT - 1))
    return inside.groupBy("capture_id", (k + 1).cast("int").alias("channel")).agg(F.max(F.col("power_db") - F.col("floor_db")).alias("peak_over_floor_db"))
