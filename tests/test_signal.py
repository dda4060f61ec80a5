"""Kernels against closed forms, and the chain against its own truth and against other cuts of the stream."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bandscope import schema as S
from bandscope.functions import dsp
from bandscope.operators import cells, signal
from bandscope.operators.clustering import bin_groups
from bandscope.operators.sessions import cut_at_silence
from bandscope.sources import iq

SMALL = S.Settings(sample_rate=500_000.0, centre_hz=446_206_250.0, num_channels=40, decimation=20)
SCENE = dsp.Scenario(
    duration_s=2.4,
    sample_rate=500_000.0,
    centre_frequency=SMALL.centre_hz,
    noise_floor_dbm=-95,
    emitters=[dsp.Emitter("a", channel=8, distance_m=300, ctcss_hz=114.8, transmissions=[(0.3, 2.1)]), dsp.Emitter("b", frequency_hz=446_150_000.0, distance_m=200, transmissions=[(0.9, 1.5)])],
)


def test_threshold_factors():
    assert cells.os_factor(1e-8) == pytest.approx(25.339186, abs=1e-5)
    assert cells.os_factor(1e-4) == pytest.approx(9.340805, abs=1e-5)
    assert cells.ca_factor(1e-8) == pytest.approx(27.706433, abs=1e-5)
    assert cells.ca_factor(1e-3) == pytest.approx(8.004514, abs=1e-5)
    a = cells.pair_factor(cells.ca_pair_rate(), 1e-3)
    rng = np.random.default_rng(0)
    x = rng.exponential(size=(400_000, 26))
    assert (x[:, 0] + x[:, 1] > a * x[:, 2:].mean(axis=1)).mean() == pytest.approx(1e-3, rel=0.15)


@pytest.mark.parametrize("method", ["os", "ca"])
def test_pair_thresholds_keep_the_false_alarm_rate(method):
    rng = np.random.default_rng(7)
    n, alarms = 2_000_000, {1e-2: 0, 1e-3: 0}
    for _ in range(10):
        x = rng.exponential(size=(n // 10, 26))
        noise = np.partition(x[:, 2:], 17, axis=1)[:, 17] if method == "os" else x[:, 2:].mean(axis=1)
        for pfa in alarms:
            alarms[pfa] += int((x[:, 0] + x[:, 1] > cells.pair_threshold(pfa, method) * noise).sum())
    for pfa, found in alarms.items():
        assert found / n == pytest.approx(pfa, rel=0.08)
    # The tail by numeric integration over the noise estimate's distribution.
    t = np.linspace(0, 60, 600_001)
    if method == "os":
        from math import comb

        density = 18 * comb(24, 18) * (1 - np.exp(-t)) ** 17 * np.exp(-7 * t)
    else:
        density = 24 * (24 * t) ** 23 / float(np.prod(np.arange(1.0, 24.0))) * np.exp(-24 * t)
    a = cells.pair_threshold(1e-6, method)
    tail = np.trapezoid(density * np.exp(-a * t) * (1 + a * t), t)
    assert tail == pytest.approx(1e-6, rel=1e-4)
    with pytest.raises(ValueError):
        cells.pair_threshold(1e-3, "no")


def test_false_alarm_rate_follows_the_design():
    rng = np.random.default_rng(1)
    s = S.Settings(hold_frames=1)
    for level in (1e-6, 1.0, 1e3):
        p = rng.exponential(level, size=(1_500, 160))
        hit, _ = dsp.cfar(p, 0, s, cells.os_factor(1e-3))
        live = 160 - len(s.excluded_bins())
        assert hit.sum() / (len(p) * live) == pytest.approx(1e-3, rel=0.35)


def test_settings_are_checked():
    assert S.Settings().excluded_bins() == [0, *range(72, 88)]
    for bad in ({"pfa": 0.0}, {"order_statistic": 30}, {"num_channels": 20}, {"centre_hz": S.CHANNEL_1_HZ}, {"min_frames": 0}, {"method": "x"}):
        with pytest.raises(ValueError):
            S.Settings(**bad)


def test_prototype_and_rejection():
    taps = dsp.prototype(S.Settings())
    f, db = dsp.response_db(taps, 2e6)
    assert taps.sum() == pytest.approx(1.0, abs=1e-5)
    assert db[np.abs(f - 6_250).argmin()] == pytest.approx(-6, abs=0.3)
    assert db[np.abs(f - 12_500).argmin() :].max() < -60


def test_channelizer_places_a_tone_and_ignores_cuts():
    s = S.Settings()
    bank = dsp.Channelizer(s)
    n = np.arange(20_000)
    x = np.exp(2j * np.pi * (7 * 12_500 + 300) / 2e6 * n).astype(np.complex64)
    first, whole = bank.frames(x, 0, len(x))
    assert first == 0 and (np.abs(whole).mean(axis=0).argmax()) == 7
    turned = np.angle(whole[1:, 7] * np.conj(whole[:-1, 7])) * s.frame_rate / (2 * np.pi)
    assert np.allclose(turned, 300, atol=1)
    parts = [bank.frames(x[a : min(len(x), b + bank.halo)], a, b)[1] for a, b in ((0, 5_000), (5_000, 5_333), (5_333, 20_000))]
    assert np.allclose(np.concatenate(parts), whole, atol=1e-5)


def test_wanted_bins_equal_the_whole_bank():
    s = S.Settings()
    bank, rng = dsp.Channelizer(s), np.random.default_rng(12)
    x = (rng.normal(size=130_000) + 1j * rng.normal(size=130_000)).astype(np.complex64)
    for start in (0, 80_000, 80_037):
        first, whole = bank.frames(x, start, start + 120_000)
        last = first + len(whole) - 1
        wanted = [(first - 50, first + 3, 7), (first + 2, first + 900, 7), (first + 700, last + 99, 0), (last, last, 159), (last + 1, last + 9, 3), (first + 10, first + 12, 80)]
        for (lo, hi, k), (f, y) in zip(wanted, bank.bins(x, start, start + 120_000, wanted), strict=True):
            want = whole[max(0, lo - first) : max(0, hi + 1 - first), k]
            assert len(y) == len(want) and (not len(y) or f == max(lo, first))
            assert np.allclose(y, want, atol=1e-4)
    assert [len(y) for _, y in bank.bins(x[:100], 0, 100, [(0, 5, 1)])] == [0]


def test_tone_and_deviation():
    rate = 25_000.0
    t = np.arange(int(rate * 2)) / rate
    audio = 0.2 * np.sin(2 * np.pi * 114.8 * t) + 0.5 * np.sin(2 * np.pi * 900 * t)
    assert dsp.find_tone(audio, rate)[0] == 114.8
    assert dsp.find_tone(0.5 * np.sin(2 * np.pi * 900 * t) + 0.05 * np.random.default_rng(0).normal(size=len(t)), rate)[0] is None
    assert dsp.find_tone(audio[:1_000], rate) == (None, 0.0, 0, 0)
    iq_ = np.exp(1j * 1_500 / 400 * np.sin(2 * np.pi * 400 * t))
    peak, rms = dsp.deviation(iq_, rate)
    assert peak == pytest.approx(1_500, rel=0.02) and rms == pytest.approx(1_500 / np.sqrt(2), rel=0.02)
    assert dsp.goertzel(np.sin(2 * np.pi * 100 * np.arange(500) / 1_000), [100.0], 1_000.0)[0] == pytest.approx(1, abs=0.01)
    assert dsp.deviation(np.ones(1), rate) == (0.0, 0.0)


def test_frequency_references():
    f = np.linspace(-1e6, 1e6, 8_192) + 800e6
    wide = 1 / (1 + np.exp((np.abs(f - 800e6 - 700) - 400e3) / 2_000)) + 1e-4
    centre, half = dsp.flat_top_centre(f, wide, 800e3)
    assert centre == pytest.approx(800e6 + 700, abs=60) and half == pytest.approx(400e3, rel=0.03)
    with pytest.raises(ValueError):
        dsp.flat_top_centre(f, np.ones_like(f), 800e3)
    g = np.arange(-40_000.0, 40_000.0, 8.0) + 800e6
    notch = 1 - 0.9 * np.exp(-(((g - 800e6 + 230) / 5_000) ** 2))
    assert dsp.notch_offset(g, notch, 800e6, 800.5e6) == pytest.approx(-230, abs=10)
    for bad in ((notch, 800e6, 800.1e6), (np.ones_like(g), 800e6, 801e6), (notch, 900e6, 801e6)):
        with pytest.raises(ValueError):
            dsp.notch_offset(g, *bad)


def test_scene_blocks_join(spark):
    whole = dsp.Scenario(duration_s=0.2, sample_rate=500_000.0, centre_frequency=SMALL.centre_hz, noise_floor_dbm=-200, emitters=SCENE.emitters[:1])
    whole.emitters[0].transmissions = [(0.01, 0.19)]
    x = whole.block(0, 100_000)
    y = np.concatenate([whole.block(0, 33_333), whole.block(33_333, 66_667)])
    whole.emitters[0].transmissions = [(0.3, 2.1)]
    assert np.allclose(x, y, atol=1e-7)


def test_chain_finds_the_scene_whatever_the_partitions(spark):
    blocks, truth = signal.synthesise(spark, SCENE, SMALL)
    found = signal.run_capture(blocks, SMALL, 114.8)
    rows = sorted(found.collect(), key=lambda r: r.timestamp)
    assert [(r.pmr_channel, r.ctcss_tone_hz, r.classification) for r in rows] == [(8, 114.8, "FRIEND"), (None, None, "UNKNOWN")]
    assert rows[0].timestamp == pytest.approx(0.3, abs=0.01) and rows[0].duration_s == pytest.approx(1.8, abs=0.02)
    assert rows[1].frequency_hz == pytest.approx(446_150_000, abs=800)
    assert rows[0].estimated_dbm is None and rows[0].calibrated is False
    other = signal.run_capture(blocks.repartition(7), SMALL, 114.8).collect()
    assert sorted((r.row_id, r.timestamp, r.frequency_hz) for r in other) == sorted((r.row_id, r.timestamp, r.frequency_hz) for r in rows)
    # Metadata only: no column holds samples or sound.
    assert not [f for f in found.schema.fields if f.dataType.typeName() in ("array", "binary")]


def test_expression_and_kernel_detectors_agree(spark):
    rng = np.random.default_rng(5)
    power = rng.exponential(size=(40, 64))
    power[10, 20] = 90.0
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(power)], "frame long, power array<double>")
    got = sorted((r.frame, r.bin) for r in cells.detections(df, 64, 1e-2).collect())
    half = np.r_[-14:-2, 3:15]
    noise = np.sort(power[:, (np.arange(64)[:, None] + half) % 64], axis=2)[:, :, 17]
    assert got == sorted(zip(*(x.tolist() for x in np.nonzero(power > noise * cells.os_factor(1e-2))), strict=True))


def test_adjacent_bins_merge_greedily(spark):
    rows = [("c", 3, 0, 10), ("c", 4, 5, 12), ("c", 6, 5, 12), ("c", 5, 20, 30), ("c", 39, 0, 9), ("c", 0, 1, 2)]
    e = spark.createDataFrame(rows, "capture_id string, bin int, start_frame long, end_frame long")
    got = {(r.bin, r.start_frame): r.group_id for r in bin_groups(e, 40, ["capture_id"]).collect()}
    assert got[3, 0] == got[4, 5] and got[39, 0] == got[0, 1] and len(set(got.values())) == 4


def groups_by_hand(rows, bins):
    """(capture, bin, start, end) in islands of silence, each merged greedily over all its members."""
    out = {}
    for capture in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == capture), key=lambda r: (r[2], r[3], r[1]))
        island, reach, of = 0, None, {}
        for r in own:
            island += reach is None or r[2] > reach
            reach = r[3] if reach is None else max(reach, r[3])
            of[r] = island
        for i in set(of.values()):
            groups = []
            for r in sorted((r for r in own if of[r] == i), key=lambda r: (r[2], r[1])):
                near = (n for n, g in enumerate(groups) if any(min((r[1] - x[1]) % bins, (x[1] - r[1]) % bins) == 1 and r[2] <= x[3] and x[2] <= r[3] for x in g))
                n = next(near, len(groups))
                if n == len(groups):
                    groups.append([])
                groups[n].append(r)
                out[r] = (i, n)
    return out


@pytest.mark.parametrize("size", [1, 7, 64, 100_000])
def test_islands_and_groups_equal_one_walk(spark, size):
    """Whatever the slices: islands over many of them, ties, and bins that touch around the band's ends."""
    rng = np.random.default_rng(size)
    bins, rows = 12, set()
    for capture in ("a", "b", None):
        for b in range(bins):
            at = 0
            for _ in range(25):
                at += int(rng.integers(1, 60))
                stop = at + int(rng.choice([0, 3, 20, 90]))
                rows.add((capture, b, at, stop))
                at = stop
        rows |= {(capture, 3, 5_000, 9_000), (capture, 4, 5_001, 5_002), (capture, 4, 8_999, 9_005), (capture, 5, 9_006, 9_007)}
    e = spark.createDataFrame(sorted(rows, key=str), "capture_id string, bin int, start_frame long, end_frame long")
    cut = cut_at_silence(e, ["capture_id"], "start_frame", "end_frame", size)
    got = {(r.capture_id, r.bin, r.start_frame, r.end_frame): (r.island, r.group_id) for r in bin_groups(cut, bins, ["capture_id", "island"]).collect()}
    assert got == groups_by_hand(rows, bins)
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in bin_groups(cut, bins, ["capture_id", "island"])._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in plan


def test_survey_and_references(spark):
    blocks, _ = signal.synthesise(spark, SCENE, SMALL)
    top = signal.survey(blocks, 500_000.0, SMALL.centre_hz).orderBy(F.desc("power_db")).first()
    assert min(abs(top.frequency_hz - f) for f in (446_093_750, 446_150_000)) < 3_000 and top.power_db - top.floor_db > 20
    g = np.arange(-40_000.0, 40_000.0, 8.0) + 800e6
    rows = [(c, float(f), float(1 - 0.9 * np.exp(-(((f - 800e6 + 230) / 5_000) ** 2)) if c != "empty" else 1.0)) for c in ("x", "y", "empty") for f in g]
    errors = signal.reference_errors(spark.createDataFrame(rows, "capture_id string, frequency_hz double, power double"), 800e6, 801e6)
    assert {r.capture_id: r.status == "ok" for r in errors.collect()} == {"x": True, "y": True, "empty": False}
    m = signal.mean_error(errors).first()
    assert m.captures == 2 and m.error_hz == pytest.approx(-230, abs=10)


@pytest.mark.parametrize("form", ["cf32", "cs16", "cs8"])
def test_captures_on_disk(spark, tmp_path, form):
    x = SCENE.block(0, 300_001)
    told = iq.write_capture(x, str(tmp_path / "cap"), form, start_time=1_000.0)
    with open(tmp_path / f"cap.{form}", "ab") as f:
        f.write(b"\0")  # an odd component at the end
    got = iq.read_iq(spark, str(tmp_path), SMALL).orderBy("block_idx").collect()
    y = np.concatenate([np.array(r.iq, np.float32).view(np.complex64) for r in got])
    assert len(y) == len(x) and {r.start_time for r in got} == {1_000.0} and got[1].start_sample == iq.block_samples(SMALL)
    scale = {"cf32": 1.0, "cs16": 32_767 / 32_768, "cs8": 127 / 128}[form] / told["scale_peak"]
    assert np.abs(y - x * scale).max() < {"cf32": 1e-6, "cs16": 1e-4, "cs8": 1.2e-2}[form]
    assert json.loads((tmp_path / "cap.json").read_text())["format"] == form
    assert iq.extract(iq.read_iq(spark, str(tmp_path), SMALL), 0.01, 0.01, 500_000.0).count() == 1
    with pytest.raises(FileNotFoundError):
        iq.read_iq(spark, str(tmp_path / "none.cs8"), SMALL)


def test_extract_equals_one_filter_over_the_span(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=9_000) + 1j * rng.normal(size=9_000) + 0.7).astype(np.complex64)
    rows = [("c", i, i * 1_000, 1_000, 0.0, np.ascontiguousarray(x[i * 1_000 : (i + 1) * 1_000]).view(np.float32).tolist()) for i in range(9)]
    blocks = spark.createDataFrame(rows, "capture_id string, block_idx bigint, start_sample bigint, n int, start_time double, iq array<float>")
    got = iq.extract_span(blocks, 1.5, 6.3, 1_000.0, 250.0, 120.0, chunk=400).orderBy("start_sample").collect()
    span = x[1_500:7_800].astype(np.complex128)
    span = (span - span.mean()) * np.exp(-2j * np.pi * 0.12 * np.arange(len(span)))
    want = np.convolve(span, iq.decimation_filter(4))[40 : 40 + len(span) : 4]
    y = np.concatenate([np.array(r.iq, np.float32).view(np.complex64) for r in got])
    assert [r.start_sample for r in got] == [0, 400, 800, 1_200] and len(y) == len(want) == 1_575
    assert np.abs(y - want).max() < 1e-4
    with pytest.raises(ValueError, match="whole factor"):
        iq.extract_span(blocks, 0.0, 1.0, 1_000.0, 300.0)
    with pytest.raises(ValueError, match="one capture"):
        iq.extract_span(blocks, 5.0, 6.0, 1_000.0, 250.0)
    with pytest.raises(ValueError, match="one capture"):
        iq.extract_span(blocks.union(blocks), 0.0, 1.0, 1_000.0, 250.0)


def test_stream_of_blocks_equals_batch(spark, tmp_path):
    from bandscope.operators.sessions import tracked
    from bandscope.streaming import tracker

    blocks = signal.with_halo(signal.synthesise(spark, SCENE, SMALL, start_time=1_000.0)[0], SMALL.num_taps)
    blocks.repartition(1).write.parquet(str(tmp_path / "in"))
    stored = spark.read.parquet(str(tmp_path / "in"))
    hits = signal.detect(stored, SMALL)
    want = sorted((r.bin, r.start_frame, r.end_frame) for r in tracked(hits, SMALL.hangover_frames, SMALL.min_frames, SMALL.max_frames, SMALL.min_occupancy, ["capture_id"]).collect())
    late = spark.createDataFrame([("end", 9, 9 * iq.block_samples(SMALL), 1, 5_000.0, [0.0, 0.0], [])], f"{S.IQ_DDL}, halo array<float>")
    assert late.columns == stored.columns or set(late.columns) == set(stored.columns)
    stream = spark.readStream.schema(stored.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracker.capture_stream(stream, SMALL).writeStream.format("memory").queryName("blocks_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.bin, r.start_frame, r.end_frame) for r in spark.table("blocks_out").collect())
    # The stream ends before the last emissions' hangover; what has closed is the same.
    assert set(got) <= set(want) and len(want) >= 2
    with pytest.raises(ValueError):
        tracker.capture_stream(stream.drop("halo"), SMALL)


def on_disk(folder, x, name="cap", form="cf32"):
    """The raw samples of a capture without its sidecar."""
    folder.mkdir(exist_ok=True)
    with open(folder / f"{name}.{form}", "ab") as f:
        f.write(iq.encode(x, form)[0])


def options(path, **more):
    return {"path": str(path), "samplerate": "500000", "blocksamples": str(iq.block_samples(SMALL)), "halosamples": str(SMALL.num_taps), "blockspertask": "1", **more}


def test_reads_are_pruned_to_the_wanted_blocks(tmp_path):
    """One second out of an hour: a few blocks are planned, of one file, whatever the filters' form."""
    size, hour = iq.block_samples(SMALL), 3_600 * 500_000
    for name in ("a", "b"):
        with open(tmp_path / f"{name}.cs8", "wb") as f:
            f.truncate(2 * hour)  # a file with holes
    planned = lambda *filters: (r := iq.IqSource(options(tmp_path, pushdown="true")).reader(None), list(r.pushFilters(list(filters))), r.partitions())[2]
    whole = sum(p.size for p in planned())
    assert whole == 2 * hour
    span = [iq.GreaterThan(("start_sample",), 1_000 * 500_000 - size), iq.LessThan(("start_sample",), 1_001 * 500_000), iq.EqualTo(("capture_id",), "b")]
    some = planned(*span)
    assert {p.piece.path.rsplit("/", 1)[-1] for p in some} == {"b.cs8"} and sum(p.size for p in some) <= 500_000 + 3 * size
    covered = {s for p in some for s in range(p.offset, p.offset + p.size, size)}
    assert covered >= {s for s in range(0, hour, size) if s < 1_001 * 500_000 and s + size > 1_000 * 500_000}
    assert [p.offset for p in planned(iq.EqualTo(("block_idx",), 7), iq.In(("capture_id",), ("a", "x")))] == [7 * size]
    assert sum(p.size for p in planned(iq.LessThanOrEqual(("start_sample",), 0))) == 2 * size
    assert sum(p.size for p in planned(iq.GreaterThanOrEqual(("start_sample",), hour))) == 0
    filters = [*span, iq.EqualTo(("n",), 3)]
    assert list(iq.IqSource(options(tmp_path, pushdown="true")).reader(None).pushFilters(filters)) == filters  # Spark applies them all


def test_pruned_reads_give_the_same_blocks(spark, tmp_path):
    x = SCENE.block(0, 1_000_000)
    on_disk(tmp_path / "in", x)
    plain = iq.extract(iq.read_iq(spark, str(tmp_path / "in"), SMALL), 1.0, 0.3, 500_000.0).orderBy("block_idx").collect()
    before = spark.conf.get(iq.PUSHDOWN)
    spark.conf.set(iq.PUSHDOWN, "true")
    try:
        part = iq.extract(iq.read_iq(spark, str(tmp_path / "in"), SMALL), 1.0, 0.3, 500_000.0)
        assert part.orderBy("block_idx").collect() == plain and len(plain) == 2
    finally:
        spark.conf.set(iq.PUSHDOWN, before)


@pytest.mark.parametrize("form", ["cf32", "cs16", "cs8"])
def test_blocks_are_written_as_segments_and_read_as_captures(spark, tmp_path, form):
    blocks, _ = signal.synthesise(spark, SCENE, SMALL, start_time=1_000.0)
    other = blocks.where("block_idx < 2").withColumn("capture_id", F.lit("other"))
    peak = iq.write_blocks(blocks.unionByName(other).repartition(5), str(tmp_path / "out"), form, segment_samples=2 * iq.block_samples(SMALL), note="x")
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith("."))
    assert len([n for n in names if n.endswith(form)]) >= 4 and [n for n in names if n.endswith("json")] == ["other.json", "scene.json"] and len(names) == len(set(names))
    assert not [n for n in names if not n.endswith((form, "json"))]
    told = json.loads((tmp_path / "out" / "scene.json").read_text())
    assert (told["scale_peak"], told["start_time"], told["note"]) == (peak, 1_000.0, "x")
    back = iq.read_iq(spark, str(tmp_path / "out"), SMALL)
    want = {(r.capture_id, r.block_idx): (r, np.array(r.iq, np.float32)) for r in blocks.unionByName(other).collect()}
    got = {(r.capture_id, r.block_idx): r for r in back.collect()}
    assert got.keys() == want.keys()
    step = {"cf32": 1e-7, "cs16": 1.01 / 32_767, "cs8": 1.01 / 127}[form]
    scale = {"cf32": 1.0, "cs16": 32_767 / 32_768 / peak, "cs8": 127 / 128 / peak}[form]
    for key, r in got.items():
        source, x = want[key]
        assert (r.start_sample, r.n, r.start_time) == (source.start_sample, source.n, 1_000.0) and np.abs(np.array(r.iq) - x * scale).max() <= step
        # The samples that follow come from the next segment where the block is a segment's last.
        after = want.get((key[0], key[1] + 1))
        assert r.last == (after is None) and len(r.halo) == (0 if after is None else 2 * SMALL.num_taps)
        assert after is None or np.abs(np.array(r.halo) - after[1][: len(r.halo)] * scale).max() <= step


def test_leading_samples(spark, tmp_path):
    on_disk(tmp_path / "in", SCENE.block(0, 600_000))
    got = iq.leading(iq.read_iq(spark, str(tmp_path / "in"), SMALL), 300_000).orderBy("start_sample").collect()
    assert [(r.start_sample, r.n, len(r.iq)) for r in got] == [(0, 261_120, 522_240), (261_120, 38_880, 77_760)]


def test_hits_by_their_ratio_and_overlay(spark):
    hits = spark.createDataFrame([("c", 1, 5, 10.0, 1.0), ("c", 2, 3, 100.0, 1.0), ("c", 3, 3, 100.0, 1.0), ("c", 9, 2, 100.0, 1.0)], "capture_id string, frame long, bin int, power double, noise double")
    assert [(r.bin, r.frame) for r in signal.by_snr(hits).collect()] == [(2, 9), (3, 2), (3, 3), (5, 1)]
    e = spark.createDataFrame([("c", 446_006_250.0, 1, 0.5, 0.25, 12.0)], "capture_id string, frequency_hz double, pmr_channel int, offset_s double, duration_s double, snr_db double")
    assert tuple(signal.overlay(e, 512_000.0).first()) == ("c", 500, 750, 446_000_000.0, 446_012_500.0, "PMR1", 12.0)


def test_a_failed_write_leaves_no_segments(spark, tmp_path):
    blocks, _ = signal.synthesise(spark, SCENE, SMALL)
    bad = blocks.withColumn("iq", F.when(F.col("block_idx") == 3, F.raise_error(F.lit("stop")).cast("array<float>")).otherwise(F.col("iq")))
    with pytest.raises(Exception, match="stop"):
        iq.write_blocks(bad, str(tmp_path / "out"), "cf32")
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())


def test_a_growing_capture_as_a_stream_equals_the_batch(spark, tmp_path):
    """Samples arrive in three steps; the last emission is on air at the end and comes out once the capture is complete."""
    from bandscope.operators.sessions import tracked
    from bandscope.streaming import tracker

    long = dsp.Scenario(**{**SCENE.__dict__, "emitters": [*SCENE.emitters, dsp.Emitter("c", channel=3, distance_m=200, transmissions=[(1.7, 9.0)])]})
    x, folder = long.block(0, 1_200_000), tmp_path / "in"
    folder.mkdir()

    def step(y, complete):
        on_disk(folder, y)
        (folder / "cap.json").write_text(json.dumps({"start_time": 1_000.0, "complete": complete}))
        blocks = iq.stream_iq(spark, str(folder), SMALL)
        for name, df in (("blocks", blocks.select("block_idx", "n", "last")), ("emissions", tracker.capture_stream(blocks, SMALL))):
            q = df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}_mark")).trigger(availableNow=True).start()
            q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "blocks")).count()

    size = iq.block_samples(SMALL)
    assert step(x[: size + 100], False) == 0  # the samples after the block aren't all there
    assert step(x[size + 100 : 800_000], False) == 3
    assert step(x[800_000:], True) == 5
    assert step(x[:0], True) == 5
    batch = iq.read_iq(spark, str(folder), SMALL)
    key = lambda r: (r.block_idx, r.n, r.last)
    assert sorted(map(key, spark.read.parquet(str(tmp_path / "blocks")).collect())) == sorted(map(key, batch.collect()))
    want = tracked(signal.detect(batch, SMALL), SMALL.hangover_frames, SMALL.min_frames, SMALL.max_frames, SMALL.min_occupancy, ["capture_id"]).collect()
    got = spark.read.parquet(str(tmp_path / "emissions")).collect()
    place = lambda r: (r.capture_id, r.bin, r.start_frame, r.end_frame, r.detected_frames)
    assert sorted(map(place, got)) == sorted(map(place, want))
    assert max(r.end_frame for r in got) > 0.98 * 1_200_000 / SMALL.decimation


def test_the_streamed_tracker_cuts_as_the_batch_does(spark, tmp_path):
    """Long runs with gaps at their cuts, in several batches: the same pieces."""
    from bandscope.operators.sessions import tracked
    from bandscope.streaming import tracker

    settings = S.Settings(sample_rate=32_000.0, num_channels=64, decimation=32, hangover_frames=3, min_frames=2, max_frames=10, min_occupancy=0.3)
    rng = np.random.default_rng(3)
    rows = [("c", b, int(f), float(rng.random()), 1.0, 0.5, 0.25) for b in range(6) for f in np.flatnonzero(rng.random(400) < [0.2, 0.4, 0.6, 0.8, 0.95, 1.0][b])]
    rows.append(("c", signal.NO_BIN, 500, 0.0, 0.0, 0.0, 0.0))
    hits = spark.createDataFrame(rows, "capture_id string, bin int, frame long, power double, noise double, left_power double, right_power double").withColumn("frame_ts", F.timestamp_millis(F.col("frame") + 1_000_000))
    for step in range(3):
        hits.where((F.col("frame") >= step * 150) & (F.col("frame") < (step + 1) * 150 + 10_000 * (step == 2))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(hits.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracker.track_stream(stream, settings).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    place = lambda r: (r.bin, r.start_frame, r.end_frame, r.detected_frames, round(r.peak_power, 9), round(r.mean_power, 9))
    want = tracked(hits.where("bin >= 0"), 3, 2, 10, 0.3, ["capture_id"])
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(place, got.collect())) == sorted(map(place, want.collect())) and got.count() > 100


def test_spectrogram_spans_the_capture(spark):
    blocks, _ = signal.synthesise(spark, SCENE, SMALL)
    table = signal.spectrogram(blocks, 500_000.0, SMALL.centre_hz, 1_200_000, max_frames=50).cache()
    frames = sorted(r.frame for r in table.select("frame").distinct().collect())
    assert 40 <= len(frames) <= 50 and frames[0] == 0 and frames[-1] > 0.95 * 1_200_000 / 512
    limits = signal.picture_limits(table).first()
    assert limits.high_db - limits.low_db > 20
    peaks = {r.channel: r.peak_over_floor_db for r in signal.channel_peaks(signal.survey(blocks, 500_000.0, SMALL.centre_hz)).collect()}
    assert max(peaks, key=peaks.get) in (8, 12, 13)


def test_studies(spark):
    from bandscope.operators import studies

    rates = studies.false_alarm_rates(spark, 1e-2, (1e-3, 10.0), 300, 64).collect()
    assert len(rates) == 4 and all(abs(r.rate - 1e-2) < 3e-3 for r in rates)
    pd = {r.snr_db: r.pd for r in studies.detection_sweep(spark, (0.0, 25.0), trials=200).collect()}
    assert pd[0.0] < 0.05 and pd[25.0] > 0.95
    cover = {(r.exponent, r.percentile): r.coverage for r in studies.ring_coverage(spark, trials=300, draws=300).collect()}
    assert abs(cover[3.5, 95] - 0.95) < 0.05 and abs(cover[3.5, 50] - 0.5) < 0.09 and cover[2.5, 95] < 0.7
    spread = {r.source: r.spread for r in studies.range_sensitivity(spark).collect()}
    assert spread["all"] > spread["exponent"] > spread["eirp"] > spread["calibration"] > 1
    assert [r.source_dbm for r in studies.sweep_levels(spark, -70, -60, 5).collect()] == [-70, -65, -60]


def test_command_line(spark, tmp_path, capsys):
    from bandscope.__main__ import main

    iq.write_capture(SCENE.block(0, 1_200_000), str(tmp_path / "cap"), "cf32", start_time=1_000.0)
    store = str(tmp_path / "found.parquet")
    shape = ["--rate", "500000", "--centre", str(SMALL.centre_hz), "--channels", "40"]
    assert main(["node", str(tmp_path / "cap.cf32"), *shape, "--friend", "114.8", "--store", store]) == 0
    assert main(["battle", store, "--json"]) == 0
    told = capsys.readouterr().out
    assert "PMR8/114.8Hz" in told
    assert main(["dashboard", store, str(tmp_path / "d.html")]) == 0 and "off-grid" in (tmp_path / "d.html").read_text()
    assert main(["extract", str(tmp_path / "cap.cf32"), *shape, "--start", "99"]) == 1


def test_command_line_writes_raw_captures(spark, tmp_path):
    from bandscope.__main__ import main
    from bandscope.sources import store

    pytest.importorskip("yaml")
    store.write_scenario(SCENE, str(tmp_path / "s.yaml"))
    assert main(["simulate", str(tmp_path / "s.yaml"), "--out", str(tmp_path / "sim"), "--format", "cs16"]) == 0
    told = json.loads((tmp_path / "sim" / "scene.json").read_text())
    assert told["format"] == "cs16" and told["sample_rate"] == SCENE.sample_rate
    assert spark.read.json(str(tmp_path / "sim.truth")).count() == 2
    found = signal.run_capture(iq.read_iq(spark, str(tmp_path / "sim"), SMALL), SMALL, 114.8).collect()
    assert sorted((r.pmr_channel or 0, r.ctcss_tone_hz) for r in found) == [(0, None), (8, 114.8)]
    shape = ["--rate", "500000", "--centre", str(SMALL.centre_hz), "--channels", "40", "--start", "0.5", "--duration", "1.0", "--target-rate", "250000", "--write", "cf32"]
    assert main(["extract", str(tmp_path / "sim"), *shape, "--store", str(tmp_path / "part")]) == 0
    part = iq.read_iq(spark, str(tmp_path / "part"), SMALL).agg(F.sum("n")).first()[0]
    assert part == 250_000 and json.loads((tmp_path / "part" / "extract.json").read_text())["sample_rate"] == 250_000.0
