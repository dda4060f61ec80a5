"""Stores, sinks, streams, events and reports."""

import socket
import sqlite3
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from bandscope import schema as S
from bandscope.functions import dsp, expr, publish
from bandscope.plans import reports
from bandscope.sources import store
from bandscope.streaming import tracker


def report(i, **more):
    row = dict(timestamp=1_786_950_000.0 + i, frequency_hz=446_093_750.0, pmr_channel=8, bin_index=3, duration_s=2.0, peak_power_dbfs=-20.0, snr_db=30.0, estimated_dbm=None, calibrated=False)
    row |= dict(ctcss_tone_hz=114.8, classification="FRIEND", offset_s=0.0, peak_deviation_hz=1_500.0, gains=(16.0, 20.0, False), attributed_to_hz=None, attribution=None)
    return tuple((row | more).values())


@pytest.fixture
def made(spark):
    return spark.createDataFrame([report(3), report(1, pmr_channel=None, ctcss_tone_hz=None, gains=None, frequency_hz=446_201_000.0, classification="UNKNOWN"), report(2)], S.EMISSION_DDL)


@pytest.mark.parametrize("extension", ["jsonl", "parquet"])
def test_round_trip(spark, made, tmp_path, extension):
    path = str(tmp_path / f"e.{extension}")
    assert store.write_reports(made.limit(2), path) == 2 and store.write_reports(made.limit(0), path) == 0
    store.write_reports(made.where("timestamp = 1786950002"), path)
    got = store.read_reports(spark, path).drop("row_id").collect()
    assert [r.timestamp for r in got] == [1_786_950_001.0, 1_786_950_002.0, 1_786_950_003.0]
    assert got[0].gains is None and got[1].gains.vga_db == 20.0 and got[0].pmr_channel is None and got[1].estimated_dbm is None


def test_cut_line_and_bad_paths(spark, made, tmp_path):
    good = [r for r in made.toJSON().collect()]
    (tmp_path / "a.jsonl").write_text("\n".join([*good[:2], good[2][:40]]))
    rows, bad = store.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert rows.count() == 2 and bad.count() == 1
    with pytest.raises(FileNotFoundError):
        store.read_reports(spark, str(tmp_path / "no.jsonl"))
    with pytest.raises(ValueError):
        store.read_reports(spark, str(tmp_path / "a.csv"))


def test_old_single_file_store(spark, tmp_path):
    path = str(tmp_path / "old.db")
    with sqlite3.connect(path) as db:
        db.execute("create table emissions (id integer primary key, timestamp real, frequency_hz real, pmr_channel integer, bin_index integer, duration_s real, peak_power_dbfs real, snr_db real, estimated_dbm real, calibrated integer, ctcss_tone_hz real, classification text, offset_s real, peak_deviation_hz real, lna_db real, vga_db real, amp_enabled integer)")
        db.execute("insert into emissions values (1, 5, 446e6, null, 1, 2, -3, 10, null, 0, null, 'UNKNOWN', 0, 100, 16, 20, 1)")
    got = store.read_reports(spark, path).collect()
    assert len(got) == 1 and got[0].attribution is None and got[0].gains.amp_enabled is True and got[0].pmr_channel is None


def test_single_file_store_is_written_and_read_by_ranges(spark, made, tmp_path):
    path = str(tmp_path / "new.db")
    many = spark.createDataFrame([report(i, pmr_channel=i % 5 or None) for i in range(1_000)], S.EMISSION_DDL).repartition(4)
    assert store.write_reports(many, path) == 1_000 and store.write_reports(made, path) == 3 and store.write_reports(made.limit(0), path) == 0
    back = store.read_reports(spark, path)
    key = lambda r: str(r[1:])
    assert back.columns == ["row_id", *many.columns]
    assert sorted(map(key, back.collect())) == sorted(map(key, many.unionByName(made).select(F.lit(0), "*").collect()))
    assert sorted(r.row_id for r in back.collect()) == list(range(1, 1_004))
    assert store.read_sqlite(spark, path).rdd.getNumPartitions() == 16
    assert [p.name for p in tmp_path.iterdir()] == ["new.db"]  # no parts are left
    with sqlite3.connect(path) as db:
        assert {r[1] for r in db.execute("pragma index_list(emissions)")} >= {"emissions_timestamp", "emissions_pmr_channel"}


def test_single_file_store_is_counted_by_sqlite_and_indexed_last(spark, made, tmp_path, monkeypatch):
    from bandscope.sources import sqlite

    path = str(tmp_path / "new.db")
    whole = store.read_sqlite
    monkeypatch.setattr(store, "read_sqlite", lambda *a: pytest.fail("a store is read whole to be counted"))
    assert store.write_reports(made, path) == 3 and store.write_reports(made, path) == 3
    part, said = str(tmp_path / "p.part"), []
    with sqlite3.connect(part) as db:
        db.execute("create table part (timestamp real)")
        db.execute("insert into part values (5), (7)")
    connect = sqlite3.connect
    monkeypatch.setattr(sqlite.sqlite3, "connect", lambda *a, **k: (db := connect(*a, **k)).set_trace_callback(said.append) or db)
    sqlite._Writer(str(tmp_path / "one.db"), ["timestamp"]).commit([sqlite.Part(part, 2)])
    assert max(i for i, x in enumerate(said) if x.startswith("INSERT")) < min(i for i, x in enumerate(said) if x.startswith("CREATE INDEX"))
    monkeypatch.setattr(sqlite.sqlite3, "connect", connect)
    with sqlite3.connect(path) as db:  # SQLite allows values of any type in a column
        db.execute("insert into emissions (timestamp, pmr_channel, classification) values (9007199254740993, 3.5, 12)")
    assert [(r.timestamp, r.pmr_channel, r.classification) for r in whole(spark, path).where("row_id = 7").collect()] == [(9007199254740992.0, 3, "12")]


def test_single_file_store_grows_columns_and_keeps_whole_writes(spark, made, tmp_path):
    path = str(tmp_path / "old.sqlite")
    with sqlite3.connect(path) as db:
        db.execute("create table emissions (id integer primary key autoincrement, timestamp real, frequency_hz real)")
        db.execute("insert into emissions values (7, 5, 446e6)")
    assert store.write_reports(made, path) == 3
    rows = store.read_reports(spark, path).collect()
    assert [r.row_id for r in rows if r.timestamp == 5.0] == [7] and {r.classification for r in rows} == {None, "FRIEND", "UNKNOWN"}
    # A task that fails takes the whole write with it.
    bad = F.when(F.col("timestamp") == 1_786_950_002.0, F.raise_error(F.lit("no"))).otherwise(F.col("duration_s"))
    with pytest.raises(Exception, match="no"):
        store.write_reports(made.repartition(3).withColumn("duration_s", bad), path)
    assert store.read_reports(spark, path).count() == 4 and [p.name for p in tmp_path.iterdir()] == ["old.sqlite"]
    for bad_write in (lambda: made.select("timestamp").write.format("sqlite_store").mode("overwrite").save(path), lambda: made.select(F.lit(1).alias("x")).write.format("sqlite_store").mode("append").save(path)):
        with pytest.raises(Exception, match="only appended|no columns"):
            bad_write()
    with sqlite3.connect(tmp_path / "none.db") as db:
        db.execute("create table emissions (id integer primary key, timestamp real)")
    assert store.read_reports(spark, str(tmp_path / "none.db")).count() == 0


def test_schema_evolution_and_sql(spark, made, tmp_path):
    path = str(tmp_path / "e.parquet")
    store.flattened(made).drop("attribution", "attributed_to_hz").write.parquet(path)
    store.write_reports(made, path)
    assert store.read_reports(spark, path).where("attribution is null").count() == 6
    assert store.store_sql(spark, path, "select count(*) as n from emissions where pmr_channel = :c", c=8).first().n == 4


def test_sinks_by_extension(spark, made, tmp_path):
    assert store.open_sink(None) is None
    with pytest.raises(ValueError):
        store.open_sink("x.txt")
    paths = [str(tmp_path / f"s.{e}") for e in ("jsonl", "db", "parquet")]
    out = tracker.fan_out(tracker.null_sink, *(store.open_sink(p) for p in paths))
    assert out(made, 0) == 3 and tracker.fan_out(tracker.null_sink)(made, 0) == 0
    for p in paths:
        assert sorted(r.timestamp for r in store.read_reports(spark, p).collect()) == [1_786_950_001.0, 1_786_950_002.0, 1_786_950_003.0]


def test_scenes_are_written_and_read(tmp_path):
    pytest.importorskip("yaml")
    scene = dsp.Scenario(name="x", exponent=2.5, shadowing_sigma_db=1.0, emitters=[dsp.Emitter("a", channel=3, ctcss_hz=67.0, transmissions=[(0.1, 0.5), (1.0, 2.0)]), dsp.Emitter("b", frequency_hz=446.1e6)])
    store.write_scenario(scene, str(tmp_path / "s.yaml"))
    assert store.read_scenario(str(tmp_path / "s.yaml")) == scene


def test_whole_report(spark):
    e = spark.createDataFrame([report(i, duration_s=2.0, peak_power_dbfs=-20.0) for i in range(0, 30, 3)], S.EMISSION_DDL).withColumn("row_id", F.monotonically_increasing_id())
    found = reports.order_of_battle(e)
    rows = reports.emitter_rows(found).collect()
    assert [(r.label, r.transmissions, r.airtime_s, r.median_gap_s, r.products) for r in rows] == [("PMR8/114.8Hz", 10, 20.0, 1.0, 0)]
    assert tuple(reports.summary(found).first()) == (10, 1, 10, 0, 20.0, 29.0, 20.0 / 29.0)
    assert tuple(reports.summary(reports.order_of_battle(e.limit(0))).first()) == (0, 0, 0, 0, 0.0, 0.0, 0.0)
    assert reports.product_rows(found).count() == 0


def test_scenario_and_calibration_files(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("name: x\nduration_s: 1.0\nemitters:\n- {name: a, channel: 3, transmissions: [{start_s: 0.1, stop_s: 0.5}]}\n")
    s = store.read_scenario(str(tmp_path / "s.yaml"))
    assert s.emitters[0].transmissions == [(0.1, 0.5)] and dsp.Scenario.from_dict({"emitters": []}).truth() == []
    with pytest.raises(TypeError):
        dsp.Scenario.from_dict({"unknown": 1})
    assert store.read_calibrations(spark, str(tmp_path / "none.yaml")).count() == 0
    c = spark.createDataFrame([("lna16_vga20_amp0", -40.0, 1.0, 1.0, 0.1, -60.0, -1.0, 9)], "gain_key string, offset_db double, slope double, r_squared double, residual_rms_db double, valid_lo double, valid_hi double, num_points int")
    store.write_calibrations(c, str(tmp_path / "c.yaml"))
    assert store.read_calibrations(spark, str(tmp_path / "c.yaml")).collect() == c.collect()


def test_events_are_well_formed(spark, made):
    e = made.withColumn("range_m", F.when(F.col("pmr_channel") == 8, F.create_map(F.lit(95), F.lit(1_234.5), F.lit(50), F.lit(700.0)))).withColumn("attribution", F.when(F.col("pmr_channel").isNull(), "SPL<&>"))
    rows = publish.events(e, publish.Site(latitude=1.5)).orderBy("timestamp").collect()
    assert [len(r.events) for r in rows] == [1, 3, 3]
    off, on = ET.fromstring(rows[0].events[0].encode()), [ET.fromstring(x.encode()) for x in rows[1].events]
    assert off.attrib["uid"] == "BAND.446201000.notone" and off.attrib["type"] == "a-u-G" and off.find("point").attrib["ce"] == "9999999.0"
    assert "SPL<&> of an emission at" in off.find("detail/remarks").text and "RANGE UNKNOWN" in off.find("detail/remarks").text
    assert on[0].attrib["start"] == "2026-08-17T07:00:02.00Z" and on[0].attrib["stale"] == "2026-08-17T07:05:04.00Z"
    assert on[0].find("point").attrib == {"lat": "1.5000000", "lon": "0.0000000", "hae": "0.0", "ce": "1234.5", "le": "9999999.0"}
    assert [x.attrib["uid"] for x in on[1:]] == ["BAND.PMR8.114.8.p50", "BAND.PMR8.114.8.p95"]
    assert on[1].find("detail/color").attrib["argb"] == str(0x80FFFF00 - (1 << 32))
    with pytest.raises(ValueError):
        publish.Site(latitude=91)


def test_scalars(spark):
    row = spark.range(1).select(
        expr.channel_at(F.lit(446_006_250.0 + 2_000)).alias("on"),
        expr.channel_at(F.lit(446_006_250.0 + 2_001)).alias("off"),
        expr.iso_time(F.lit(0.999)).alias("t"),
        expr.quantise_gain(F.lit(12.0), 8.0, 40.0).alias("q"),
        expr.gain_key(F.lit(16.0), F.lit(20.0), F.lit(True)).alias("k"),
        expr.tones_match(F.lit(None).cast("double"), F.lit(None).cast("double")).alias("nn"),
        expr.tones_match(F.lit(67.0), F.lit(None).cast("double")).alias("tn"),
        expr.adjacent_bins(F.lit(0), F.lit(39), 40).alias("adj"),
        expr.escaped(F.lit("<&\"'>")).alias("x"),
        expr.emitter_label(F.lit(446_201_000.0), F.lit(None).cast("int"), F.lit(0.0)).alias("l"),
        *(c.alias(n) for c, n in zip(expr.plan_gains(F.lit(20.0)), ("g1", "g2"), strict=True)),
    ).first()
    assert row.on == 1 and row.off is None and row.t == "1970-01-01T00:00:00.99Z" and row.q == 16.0 and row.k == "lna16_vga20_amp1"
    assert row.nn and not row.tn and row.adj and row.x == "&lt;&amp;&quot;&apos;&gt;" and row.l == "446.20100/no-tone" and (row.g1, row.g2) == (32.0, 0.0)


def test_targets():
    assert store.parsed_target(None) is None and store.parsed_target("tls://h") == ("tls", "h", 4242)
    for bad in ("http://h", "udp://"):
        with pytest.raises(ValueError):
            store.parsed_target(bad)


def test_socket_writer():
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as server:
        server.bind(("127.0.0.1", 0))
        server.settimeout(5)
        w = tracker.SocketWriter(("udp", "127.0.0.1", server.getsockname()[1]))
        assert w.open(0, 0)
        w.process({"event": "<e/>"})
        assert server.recv(100) == b"<e/>"
        w.close(None)
    dead = tracker.SocketWriter(("tcp", "127.0.0.1", 9))
    assert dead.open(0, 0)
    dead.process({"event": "x"})
    dead.close(None)


def hit_rows():
    frames = [*range(0, 60), *range(75, 120), *range(400, 430), 900]
    return [("c", 5, f, 1.0 + f % 3, 0.1, 0.2, 0.3) for f in frames] + [("c", 9, f, 2.0, 0.1, 0.2, 0.3) for f in range(100, 160)]


def test_stream_equals_batch(spark, tmp_path):
    from bandscope.operators.sessions import tracked

    s = S.Settings(hangover_frames=20, min_frames=10, max_frames=5_000, min_occupancy=0.35)
    ddl = "capture_id string, bin int, frame long, power double, noise double, left_power double, right_power double"
    batch = spark.createDataFrame(hit_rows(), ddl)
    want = sorted((r.bin, r.start_frame, r.end_frame, r.detected_frames) for r in tracked(batch, 20, 10, 5_000, 0.35, ["capture_id"]).collect())
    stamped = batch.withColumn("frame_ts", F.timestamp_micros((1e9 + F.col("frame") / s.frame_rate * 1e6).cast("long")))
    for i, (a, b) in enumerate(((0, 110), (110, 500), (500, 2_000))):
        stamped.where(f"frame >= {a} and frame < {b}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # A far frame of another key pushes the watermark past every open emission.
    late = spark.createDataFrame([("end", 0, 100_000, 1.0, 0.1, 0.1, 0.1)], ddl).withColumn("frame_ts", F.timestamp_micros((1e9 + F.col("frame") / s.frame_rate * 1e6).cast("long")))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(stamped.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracker.track_stream(stream, s).writeStream.format("memory").queryName("tracked_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    got = sorted((r.bin, r.start_frame, r.end_frame, r.detected_frames) for r in spark.table("tracked_out").where("capture_id = 'c'").collect())
    assert got == want


def test_fan_out_survives_a_failing_sink(spark, tmp_path):
    def broken(df, i):
        raise RuntimeError("no")

    write = tracker.fan_out(broken, tracker.table_sink(str(tmp_path / "t")), tracker.json_sink(str(tmp_path / "j")))
    df = spark.range(5)
    assert write(df, 0) == 5 and write(df, 0) == 5
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5 and spark.read.json(str(tmp_path / "j")).count() == 5


def test_order_of_battle_and_page(spark, made):
    e = made.withColumn("row_id", F.monotonically_increasing_id())
    found = reports.order_of_battle(e)
    assert found["emitters"].count() == 2 and found["emitters"].first().label == "PMR8/114.8Hz"
    assert reports.order_of_battle(e, channel=8)["detections"].count() == 2
    page = reports.dashboard_page(e)
    assert page.count("<tr>") >= 4 and "off-grid" in page and "http" not in page
    assert reports.order_of_battle(e.limit(0))["emitters"].count() == 0
    text = publish.describe(found["emitters"].collect(), "emitters", ["label", "transmissions"])
    assert text.splitlines()[0] == "emitters" and "PMR8/114.8Hz" in text
    assert reports.published(e.withColumn("estimated_dbm", F.lit(-60.0)), draws=50).count() == 3 * 6


def test_demo(spark):
    scene = dsp.Scenario(duration_s=1.2, sample_rate=500_000.0, centre_frequency=446_206_250.0, noise_floor_dbm=-95, emitters=[dsp.Emitter("a", channel=8, distance_m=300, transmissions=[(0.2, 1.0)])])
    out = reports.demo(spark, scene, S.Settings(sample_rate=500_000.0, centre_hz=446_206_250.0, num_channels=40, decimation=20))
    told, first = reports.demo_rows(out, scene)
    assert {(r.emitter, r.distance_m) for r in told.collect()} == {(e.name, float(e.distance_m)) for e in scene.emitters if e.transmissions}
    times = [r.timestamp for r in first.collect()]
    assert times == sorted(times) and len(times) <= 12
    s = out["summary"].first()
    assert (s.transmissions, s.detected, s.spurious, s.channel_accuracy) == (1, 1, 0, 1.0) and abs(s.duration_rmse_s) < 0.05
