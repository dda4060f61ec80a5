"""Every query with SQL against DuckDB, and the queries that SQL can't express against plain Python."""

import bisect
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bandscope import schema as S
from bandscope.functions import expr
from bandscope.operators import attribution, calibration, clustering, joins, occupancy, scoring, sessions
from bandscope.operators.staging import staged
from bandscope.plans import queries, views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in ("events", "embeddings", "supplier"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    return "nan" if v != v else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    theirs = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert sorted([norm(r[c]) for c in order] for r in df.toArrow().to_pylist()) == sorted([norm(r[c]) for c in order] for r in theirs)


def emissions(spark, rows):
    """(row_id, timestamp, duration, frequency, power, tone)."""
    e = spark.createDataFrame(rows, "row_id long, timestamp double, duration_s double, frequency_hz double, peak_power_dbfs double, ctcss_tone_hz double")
    from bandscope.functions.expr import channel_at

    return e.withColumn("pmr_channel", channel_at("frequency_hz"))


def brute_attribution(rows, tol=2_000.0, margin=10.0):
    meet = lambda a, b: a[1] < b[1] + b[2] and b[1] < a[1] + a[2]
    order = sorted(rows, key=lambda r: (-r[4], r[0]))
    out = {}
    for w in order:
        parents = [s for s in order if meet(s, w) and s[4] - w[4] >= margin]
        found = next(((p[3], "SPLATTER") for p in parents if any(o is not w and o is not p and abs(o[3] - 2 * p[3] + w[3]) <= tol and p[4] - o[4] >= margin and meet(o, p) for o in order)), None)
        found = found or next(((p[3], "INTERMOD3") for p in parents if any(q is not p and abs(w[3] - 2 * p[3] + q[3]) <= tol for q in parents)), None)
        out[w[0]] = found or (None, None)
    return out


def test_attribution_by_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.uniform(0, 60), rng.choice([0.5, 3.0, 40.0, 2_000.0]), 446e6 + 12_500.0 * rng.randint(0, 9) + rng.uniform(-900, 900), float(rng.choice([-1, -15, -15, -30, -31])), None) for i in range(120)]
    got = attribution.attribute(emissions(spark, rows)).collect()
    assert {r.row_id: (r.attributed_to_hz, r.attribution) for r in got} == brute_attribution(rows)
    assert {k for _, k in brute_attribution(rows).values()} == {None, "SPLATTER"}
    pair = [(1, 0.0, 9.0, 446_031_272.0, -1.0, None), (2, 0.0, 9.0, 446_093_731.0, -2.0, None), (3, 1.0, 1.0, 445_968_813.0, -40.0, None), (4, 1.0, 1.0, 446_156_190.0, -41.0, None), (5, 1.0, 1.0, 446_300_000.0, -41.0, None)]
    got = attribution.attribute(emissions(spark, pair)).collect()
    assert {r.row_id: (r.attributed_to_hz, r.attribution) for r in got} == brute_attribution(pair)
    assert [r.attribution for r in sorted(got)] == [None, None, "INTERMOD3", "INTERMOD3", None]
    assert attribution.attribute(emissions(spark, rows[:0])).count() == 0


def test_symmetric_pair_is_splatter(spark):
    rows = [(1, 0.0, 9.0, 446_093_757.0, -0.6, 114.8), (2, 1.0, 2.0, 446_055_734.0, -26.7, None), (3, 1.0, 2.0, 446_131_991.0, -26.1, None), (4, 20.0, 2.0, 446_131_991.0, -26.1, None)]
    got = {r.row_id: r.attribution for r in attribution.attribute(emissions(spark, rows)).collect()}
    assert got == {1: None, 2: "SPLATTER", 3: "SPLATTER", 4: None}


def test_interval_join_meets_each_pair_once(spark):
    rng = random.Random(4)
    a = [(i, s := rng.uniform(-100, 1_000), s + rng.choice([0.0, 0.1, 30.0, 5_000.0, 1e7])) for i in range(150)]
    b = [(i, s := rng.uniform(-100, 1_000), s + rng.choice([0.2, 15.0, 64.0, 90_000.0])) for i in range(150)]
    left, right = spark.createDataFrame(a, "i long, a0 double, a1 double"), spark.createDataFrame(b, "j long, b0 double, b1 double")
    got = sorted((r.i, r.j) for r in joins.interval_join(left, right, ("a0", "a1"), ("b0", "b1"), F.lit(True)).collect())
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2])


def test_interval_join_has_no_nested_loop(spark):
    e = staged(views.emissions(spark, SF))
    plan = attribution.parent_pairs(e)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def odd_spans(spark):
    rng = random.Random(9)
    length = lambda: rng.choice([0.0, -3.0, 0.0625, 2.0, 2.0, 7.5, 40.0, 1e12, float("inf"), float("nan"), -float("inf"), None, rng.random()])
    rows = [(i, s := rng.choice([float(rng.randrange(-4, 60)), 1e9 + rng.random()]), (d := length()) is not None and s + d or None) for i in range(400)] + [(None, 1.0, 9.0), (400, None, 9.0), (401, float("nan"), 9.0)]
    return spark.createDataFrame(rows, "id long, t0 double, t1 double")


@pytest.mark.parametrize("slab", [0.5, 2.0, 40.0])
def test_overlapping_pairs_meet_once(spark, monkeypatch, slab):
    monkeypatch.setattr(joins, "SLAB", slab)
    e = odd_spans(spark)
    got = joins.overlapping_pairs(e, "id", "t0", "t1").select("a_id", "b_id", expr.rounded_product(F.least("a_t1", "b_t1") - F.greatest("a_t0", "b_t0"), 3).alias("s")).toArrow().to_pylist()
    c = duckdb.connect()
    c.register("e", e.toArrow())
    want = c.sql("SELECT a.id AS a_id, b.id AS b_id, round(least(a.t1, b.t1) - greatest(a.t0, b.t0), 3) AS s FROM e a JOIN e b ON a.id < b.id AND a.t0 < b.t1 AND b.t0 < a.t1").fetchall()
    assert sorted((r["a_id"], r["b_id"], str(r["s"])) for r in got) == sorted((a, b, str(s)) for a, b, s in want) and len(want) > 1_000
    assert joins.overlapping_pairs(e.where("id < 0"), "id", "t0", "t1").count() == 0


def test_overlap_pairs_store_little_more_than_the_rows(spark, monkeypatch):
    monkeypatch.setattr(queries, "staged", lambda df: pytest.fail("rows are stored before the join"))
    plan = queries.QUERIES["overlap_pairs"](spark, SF)
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("ReusedExchange") == 1 == text.count("- Exchange ") and "Broadcast" not in text and "NestedLoop" not in text
    e = odd_spans(spark).where("t0 IS NOT NULL AND NOT isnan(t0) AND t1 IS NOT NULL")
    assert e.count() <= joins.in_slabs(e, "t0", "t1").count() <= (1 + 1 / joins.SLAB) * e.count()


def test_clusters_equal_one_fold(spark):
    rng = random.Random(2)
    for _ in range(3):
        rows = [(i, rng.uniform(0, 1_000), rng.uniform(0.1, 30), 446e6 + rng.choice([0, 2_500, 5_000, 12_500, 40_000]) + rng.uniform(-1_500, 1_500), -10.0, rng.choice([None, 67.0, 67.9, 68.8, 100.0])) for i in range(200)]
        order = sorted(rows, key=lambda r: (r[1], r[0]))
        want = dict(clustering.fold([(r[0], r[1], r[3], r[5]) for r in order], 3_000.0, 1.0))
        assert {r.row_id: r.profile_id for r in clustering.cluster(emissions(spark, rows)).collect()} == want


def test_running_medians_bound_the_exact_ones():
    rng = random.Random(11)
    for cell in (0.25, 1.0, 1_024.0):
        for few in (0, 5):
            m, seen, split = clustering.RunningMedian(set(), few, cell), [], set()
            for _ in range(400):
                v = 446e6 + rng.choice([rng.uniform(0, 4 * cell), rng.randrange(4) * cell, 7.25])
                m.add(v)
                bisect.insort(seen, v)
                exact = clustering._median(seen)
                assert m.low <= exact <= m.high and m.high - m.low <= cell
                split.update(m.unknown())
            # With all those cells split, and theirs, and theirs, the median is exact.
            for _ in range(3):
                m = clustering.RunningMedian(split, few, cell)
                for v in seen:
                    m.add(v)
                split = split | set(m.unknown())
            m = clustering.RunningMedian(split, few, cell)
            for v in seen:
                m.add(v)
            assert m.low == m.high == clustering._median(seen)


@pytest.mark.parametrize(("few", "cell"), [(1, 1_024.0), (0, 4_096.0), (8, 1.0), (3, 16_384.0)])
def test_clusters_by_counted_medians_equal_one_fold(spark, few, cell):
    """Few kept values and wide cells: decisions hang on the place within a cell, and islands are folded again."""
    rng = random.Random(3)
    rows = [(i, rng.choice([rng.uniform(0, 1_000), 5.0]), 1.0, 446e6 + rng.choice([0, 2_500, 5_000, 12_500, 40_000]) + rng.uniform(-1_500, 1_500), -10.0, rng.choice([None, 67.0, 67.9, 68.8, 100.0])) for i in range(600)]
    want = dict(clustering.fold([(r[0], r[1], r[3], r[5]) for r in sorted(rows, key=lambda r: (r[1], r[0]))], 3_000.0, 1.0))
    got = clustering.cluster(emissions(spark, rows), few=few, cell=cell)
    assert {r.row_id: r.profile_id for r in got.collect()} == want


def test_clusters_within_a_partition_and_without_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.uniform(0, 100), 1.0, 446e6 + rng.uniform(0, 9_000), -10.0, None) for i in range(60)]
    e = emissions(spark, rows).withColumn("day", F.when(F.col("row_id") % 3 > 0, F.col("row_id") % 3))
    got = {r.row_id: r.profile_id for r in clustering.cluster(e, ["day"]).collect()}
    want = {}
    for d in range(3):
        order = sorted((r for r in rows if r[0] % 3 == d), key=lambda r: (r[1], r[0]))
        want |= dict(clustering.fold([(r[0], r[1], r[3], r[5]) for r in order], 3_000.0, 1.0))
    assert got == want
    assert clustering.cluster(e.limit(0), ["day"]).count() == 0


def test_runs_cut_at_gaps_equal_sorted_values(spark):
    rng = random.Random(6)
    values = [rng.choice([rng.uniform(0, 60), float(rng.randrange(0, 60, 2))]) for _ in range(40)] + [-7.0, -5.0, None]
    df = spark.createDataFrame([(i, "k" if i % 2 else None, v) for i, v in enumerate(values)], "i int, k string, v double")
    got = {r.i: (r.k, r.run) for r in clustering.cut_at_gaps(df, ["k"], "v", 2.0, "run").collect()}
    for k in ("k", None):
        own = sorted((v, i) for i, v in enumerate(values) if v is not None and (i % 2 == 1) == (k == "k"))
        run = 0
        for n, (v, i) in enumerate(own):
            run += n == 0 or v - own[n - 1][0] > 2.0
            assert got[i] == (k, run)
    assert len(got) == len(values) - 1


def test_clustering_plan_has_no_python_group(spark):
    plan = clustering.cluster(staged(views.emissions(spark, SF)))
    rows = clustering._folded(spark.createDataFrame([], "island__ string, timestamp double, row_id long, frequency_hz double, ctcss_tone_hz double"), None, 3_000.0, 1.0, 4, 1.0)
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in text and "MapInArrow" in text and "Sort" in text
    assert plan.count() == 1_000


def test_profile_figures(spark):
    rows = [(1, 0.0, 2.0, 446e6, -10.0, None), (2, 5.0, 2.0, 446e6, -12.0, None), (3, 6.0, 2.0, 446e6, -20.0, None)]
    p = occupancy.profile_stats(emissions(spark, rows), ["ctcss_tone_hz"]).first()
    assert (p.transmissions, p.airtime_s, p.median_gap_s, p.proven_multiple, p.count_is_lower_bound) == (3, 6.0, 3.0, True, False)
    one = occupancy.profile_stats(emissions(spark, rows[:1]), ["ctcss_tone_hz"]).first()
    assert (one.duty_cycle, one.power_spread_db, one.median_gap_s) == (1.0, 0.0, 0.0)
    assert tuple(occupancy.band_load(emissions(spark, rows[:0])).first()) == (0.0, 0.0, 0.0)


def test_sessions_merge_at_the_gap_and_cut_at_the_longest(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (0, 2, 4, 7, 8)], "k string, t double")
    runs = sessions.by_lag(df, ["k"], "t", 2.0)
    assert sorted((r.t, r.run) for r in runs.collect()) == [(0, 1), (2, 1), (4, 1), (7, 2), (8, 2)]
    assert sorted((r.t, r.piece) for r in sessions.by_lag(df, ["k"], "t", 3.0, 5.0).collect()) == [(0, 0), (2, 0), (4, 0), (7, 1), (8, 1)]


def test_scoring_cases(spark):
    truth = spark.createDataFrame([(1, 0.0, 10.0, 446e6, 1, 67.0, 10.0), (2, 20.0, 30.0, 446e6, 1, None, 12.0), (3, 40.0, 50.0, 446e6, 1, 67.0, 31.0)], "truth_id long, start_s double, stop_s double, frequency_hz double, pmr_channel int, ctcss_hz double, snr_db double")
    reports = emissions(spark, [(1, 0.0, 4.0, 446e6, -1.0, 67.2), (2, 5.0, 4.0, 446e6, -1.0, None), (3, 21.0, 25.0, 446e6, -1.0, None), (4, 70.0, 1.0, 446e6, -1.0, None)]).withColumn("pmr_channel", F.lit(1))
    met = scoring.hits(reports, truth, 0.0)
    matched = scoring.matches(met)
    assert sorted((r.report_id, r.truth_id, r.met) for r in matched.collect()) == [(1, 1, 1), (2, 1, 1), (3, 2, 2)]
    told = scoring.by_truth(reports, truth, matched)
    assert sorted((r.truth_id, r.detected, r.fragmented, r.ctcss_correct) for r in told.collect()) == [(1, True, True, True), (2, True, False, True), (3, False, False, False)]
    s = scoring.summary(told, matched, scoring.spurious(reports, met).count(), 100.0).first()
    assert (s.transmissions, s.detected, s.spurious, s.fragmented, s.merged) == (3, 2, 1, 1, 1)
    assert s.duration_rmse_s == pytest.approx(np.sqrt((2.0**2 + 15.0**2) / 2))
    empty = scoring.summary(told.limit(0), matched.limit(0), 0, 0.0).first()
    assert (empty.transmissions, empty.probability_of_detection, empty.duration_rmse_s) == (0, 0.0, 0.0)


@pytest.mark.parametrize("slab, few", [(2.0, 1), (40.0, 1), (3.0, 8)])
def test_best_matches_equal_those_of_listed_pairs(spark, monkeypatch, slab, few):
    from bandscope.operators import bestmatch

    monkeypatch.setattr(bestmatch, "SLAB", slab)
    monkeypatch.setattr(bestmatch, "FEW", few)
    pick = random.Random(int(slab))
    length = lambda: pick.choice([0.0, -3.0, 1.0, 2.0, 5.0, 5.0, 9.0, 40.0, 1e-17, pick.random()])
    tf = [446e6, 446e6 + 700.0, 446e6 - 5_900.0, 446e6 + 6_250.0, 446e6 + 12_500.0]
    reports = emissions(spark, [(2 * i, float(pick.randrange(-4, 60)), length(), pick.choice([446e6, 446e6 + 350.0]), -1.0, None) for i in range(300)] + [(601, None, 1.0, 446e6, -1.0, None), (603, 1.0, 1.0, None, -1.0, None)])
    # Ends that differ by less than a difference of times can tell.
    told = [(i, a := float(pick.randrange(-4, 60)), a + length(), pick.choice(tf)) for i in range(300, 0, -1)] + [(301, 1e-18, 30.0, 446e6), (300, 2e-18, 30.0, 446e6), (302, None, 1.0, 446e6)]
    truth = spark.createDataFrame(told, "truth_id long, start_s double, stop_s double, frequency_hz double")
    columns = ["report_id", "truth_id", "overlap_s", "met"]
    want = sorted(map(tuple, scoring.matches(scoring.hits(reports, truth, 0.0)).select(columns).collect()))
    assert sorted(map(tuple, scoring.best_matches(reports, truth, 0.0).select(columns).collect())) == want and len(want) > 200
    assert scoring.best_matches(reports.where("row_id < 0"), truth).count() == 0 == scoring.best_matches(reports, truth.where("truth_id < 0"), 0.0).count()


@pytest.mark.parametrize("name", ["score_matches", "spurious", "score_summary", "detection_by_snr"])
def test_scores_list_no_pairs(spark, monkeypatch, name):
    monkeypatch.setattr(queries.R, "interval_join", lambda *a, **k: pytest.fail("pairs are listed"))
    queries.QUERIES[name](spark, SF).collect()


def test_calibration_trims_compression_and_refuses_outside(spark):
    points = [("g", float(x), x + 50.0 if x < -10 else -5.0 + 45.0) for x in range(-70, 1, 5)]
    df = spark.createDataFrame(points, "gain_key string, measured_dbfs double, input_dbm double")
    c = calibration.fit_trimmed(df).first()
    assert c.slope == pytest.approx(1.0, abs=0.02) and c.offset_db == pytest.approx(50.0, abs=1.0) and c.valid_hi <= 0
    e = spark.createDataFrame([(1, "g", -30.0), (2, "g", -99.0), (3, "other", -30.0), (4, None, -30.0)], "row_id long, gain_key string, peak_power_dbfs double")
    got = {r.row_id: (r.estimated_dbm is not None, r.calibrated) for r in calibration.to_dbm(e, calibration.fit_trimmed(df)).collect()}
    assert got == {1: (True, True), 2: (False, False), 3: (False, False), 4: (False, False)}


def test_trimming_leaves_keys_that_are_done_and_tells_the_driver_no_points(spark, monkeypatch):
    """Points of keys that are done aren't stored again, and no dropped point passes through the driver."""
    rng = random.Random(3)
    rows = [(k, i, float(i), 2.0 * i + rng.random() / 10 + (9.0 + i if i % 12 == 5 and i // 12 < k else 0.0)) for k in range(5) for i in range(60)] + [(7, 1, 1.0, 1.0), (None, 1, 1.0, 1.0), (None, 2, 2.0, 2.0), (8, 1, None, 1.0)]
    stored = []
    monkeypatch.setattr(calibration, "staged", lambda df: stored.append(staged(df)) or stored[-1])
    df = spark.createDataFrame(rows, "k long, i long, x double, y double")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: pytest.fail("rows of the driver"))
    got = {r.gain_key: r.num_points for r in calibration.fit_trimmed(df, "k", "x", "y").collect()}
    assert got == {None: 2, 0: 60, 1: 59, 2: 58, 3: 57, 4: 56}
    assert [t.count() for t in stored if "place" in t.columns] == [303, 59 * 4, 58 * 3, 57 * 2, 56]


def test_one_chain_and_its_antennas(spark):
    """The deployed chain without a key: one row, the published formula."""
    stages = calibration.chain_table(spark)
    got = calibration.cascade(stages).first()
    factor, ahead = 1.0, 1.0
    for _, _, gain, noise, _ in S.CHAIN:
        factor += (10 ** (noise / 10) - 1) / ahead
        ahead *= 10 ** (gain / 10)
    assert got.total_gain_db == pytest.approx(sum(r[2] for r in S.CHAIN)) and got.noise_figure_db == pytest.approx(10 * np.log10(factor))
    assert got.detectable_dbm == pytest.approx(-174 + 10 * np.log10(12_500) + got.noise_figure_db + 13)
    assert [r.stage_idx for r in calibration.input_violations(stages, -20.0).collect()] == [4]
    assert calibration.required_attenuation(stages, -20.0).first()[0] == 20.0 and calibration.required_attenuation(stages, -90.0).first()[0] == 0.0
    found = {r.name: r.finding for r in calibration.audit(calibration.antenna_table(spark), 900e6).collect()}
    assert found["panel 700-2700 MHz 35 dBi"] == "implausible gain" and found["8 dBi 2.4/5/5.8 GHz"] == "out of band" and len(found) < len(S.ANTENNAS)


def test_range_percentiles(spark):
    e = spark.createDataFrame([(1, 446e6, -60.0), (2, 446e6, None)], "row_id long, frequency_hz double, estimated_dbm double")
    got = {r.row_id: r.range_m for r in calibration.estimate_range(e, draws=4_000).collect()}
    rng = np.random.default_rng(1)
    n, p = np.clip(rng.normal(3.5, 0.5, 200_000), 2, None), rng.normal(27, 3, 200_000)
    loss = p - (-60 + rng.normal(0, 2, 200_000)) - 20 * np.log10(4 * np.pi * 446e6 / 299_792_458.0) - rng.normal(0, 8, 200_000)
    want = np.percentile(10 ** (loss / (10 * n)), [5, 50, 95])
    assert got[2] is None and sorted(got[1]) == [5, 50, 68, 90, 95]
    assert np.allclose([got[1][5], got[1][50], got[1][95]], want, rtol=0.12)
    exact = calibration.estimate_range(e, 3, exponent_sigma=0.0, shadowing_sigma_db=0.0, eirp_sigma_db=0.0, calibration_sigma_db=0.0).first().range_m
    assert exact[50] == pytest.approx(10 ** ((27 + 60 - 20 * np.log10(4 * np.pi * 446e6 / 299_792_458.0)) / 35))
    with pytest.raises(ValueError):
        calibration.estimate_range(e, 0)


def test_range_query_covers_all_emissions_with_default_draws(spark, monkeypatch):
    asked = []
    whole = calibration.estimate_range
    monkeypatch.setattr(queries.C, "estimate_range", lambda e, *a, **k: asked.append((a, k)) or whole(e, *a, **k))
    got = {r.row_id: r for r in queries.QUERIES["range_monte_carlo"](spark, SF).collect()}
    rows = {r.row_id: r for r in views.emissions(spark, SF).collect()}
    assert asked == [((), {})] and got.keys() == rows.keys() and len(rows) == 1_000
    rng = np.random.default_rng(2)
    n, db = np.clip(rng.normal(3.5, 0.5, 200_000), 2, None), rng.normal(27, 3, 200_000) - rng.normal(0, 2, 200_000) - rng.normal(0, 8, 200_000)
    for i in sorted(rows)[:5]:
        loss = db - (rows[i].peak_power_dbfs / 4 - 60) - 20 * np.log10(4 * np.pi * rows[i].frequency_hz / 299_792_458.0)
        assert np.allclose(got[i][1:], np.percentile(10 ** (loss / (10 * n)), [5, 50, 68, 90, 95]), rtol=0.08)


def test_order_statistics_are_those_of_a_sort():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 1_000):
        for x in (rng.standard_normal(n), rng.integers(0, 4, n).astype(np.float32), np.full(n, np.inf)):
            ranks = np.unique(rng.integers(0, n, 6)).tolist()
            a, b = calibration.order_statistics(x.copy(), ranks, calibration.settling(ranks, n))
            assert (a == np.sort(x)[ranks]).all() and (b == np.sort(x)[np.minimum(np.add(ranks, 1), n - 1)]).all()


def test_every_row_ranks_all_draws_of_its_own(spark):
    """Each row's percentiles are those of its own stream of 20,000 draws, in full; the same power gives other draws in another row."""
    e = spark.createDataFrame([(i, 446e6, -60.0 - i // 2) for i in range(6)] + [(6, 446e6, None)], "row_id long, frequency_hz double, estimated_dbm double")
    told = calibration.estimate_range(e).select("row_id", "range_m", F.xxhash64("row_id", F.lit(1)).alias("key")).collect()
    z = calibration._quantiles()
    assert len(set(z)) == 1 << 16 and abs(z.mean()) < 1e-12 and abs(z.std() - 1) < 1e-4
    for r in told[:6]:
        bits = np.random.SFC64(0)
        bits.state = bits.state | {"state": {"state": np.array([r.key % 2**64] * 3 + [1], np.uint64)}}
        words = bits.random_raw(12 + 10_000)[12:].view(np.uint16)
        loss = 27 + 60 + r.row_id // 2 - 20 * np.log10(4 * np.pi * 446e6 / 299_792_458.0)
        metres = 10 ** ((loss + np.sqrt(77) * z[words[:20_000]]) / (10 * np.maximum(3.5 + 0.5 * z[words[20_000:]], 2)))
        assert [r.range_m[p] for p in (5, 50, 68, 90, 95)] == pytest.approx(np.percentile(metres, [5, 50, 68, 90, 95]).tolist(), rel=1e-5)
    assert told[6].range_m is None and len({r.range_m[50] for r in told[:6]}) == 6
    odd = calibration.estimate_range(e.limit(1), 7, (1, 99)).first().range_m
    assert sorted(odd) == [1, 50, 99] and odd[1] < odd[50] < odd[99]


def test_gaps_and_ranks_are_those_of_whole_groups(spark):
    """Days apart, emissions over midnight, ties, nulls and single rows: the cut by day and cell changes nothing."""
    rng = random.Random(5)
    rows = [(i, rng.choice([10.0, 86_399.0, 86_400.0, 400_000.0]) + rng.randrange(0, 90_000, 7), rng.choice([1.0, 5.0, 100_000.0]), 446e6 + rng.choice([0, 3, 3, 7, 12_500]), rng.choice([-10.0, -10.001, -50.0]), rng.choice([None, 67.0, 67.0, 67.0])) for i in range(300)]
    rows.append((999, 5.0, 1.0, 446e6, -7.0, 99.0))
    got = {r.ctcss_tone_hz: r for r in occupancy.profile_stats(emissions(spark, rows), ["ctcss_tone_hz"]).collect()}
    assert set(got) == {None, 67.0, 99.0}
    for tone, r in got.items():
        group = sorted((x for x in rows if x[5] == tone), key=lambda x: (x[1], x[0]))
        gaps = [b[1] - (a[1] + a[2]) for a, b in zip(group, group[1:]) if b[1] >= a[1] + a[2]]
        power = sorted(x[4] for x in group)
        n = len(power)
        spread = power[3 * n // 4 - (n % 4 == 0)] - power[n // 4] if n >= 2 else 0.0
        assert r.transmissions == n and r.median_gap_s == pytest.approx(float(np.median(gaps)) if gaps else 0.0)
        assert r.median_power_dbfs == pytest.approx(np.median(power)) and r.power_spread_db == pytest.approx(spread)
        assert r.median_frequency_hz == pytest.approx(np.median([x[3] for x in group]), abs=1e-6)
        assert r.proven_multiple == any(b[1] < a[1] + a[2] for i, b in enumerate(group) for a in group[:i])


def test_dynamic_range_leaves_out_compressed_levels(spark):
    line = [("a", float(x), x + 3.0) for x in range(-60, 0, 5)] + [("a", 5.0, 30.0)] + [("b", -1.0, 0.0), ("b", -9.0, 0.0)]
    points = spark.createDataFrame(line, "gain_key string, measured_dbfs double, input_dbm double")
    got = {r.gain_key: r.dynamic_range_db for r in calibration.dynamic_range(points).collect()}
    assert got["a"] == pytest.approx(55.0) and got["b"] == 0.0


def test_attribution_reads_staged_pairs(spark):
    plan = attribution.attribute(staged(views.emissions(spark, SF)))._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(sequence(FLOOR((w_t0" not in plan and "NestedLoop" not in plan


def test_attribution_lists_no_pairs(spark, monkeypatch):
    """Odd rows over many slabs against brute force; no table of pairs is written, which grew with the square of traffic."""
    from bandscope.operators import onair, staging

    monkeypatch.setattr(onair, "SLAB", 2.0)
    rng = random.Random(6)
    line = lambda i: (i, float(rng.randint(0, 90)), rng.choice([0.0, 0.0, -3.0, 1.0, 2.0, 7.0, 60.0]), 446e6 + rng.choice([500.0, 900.0, 12_500.0]) * rng.randint(0, 9) + rng.choice([0.0, 0.125]), float(rng.choice([-1, -9, -11, -15, -25])), None)
    rows = [line(i) for i in range(250)]
    before = set(staging._written)
    told = attribution.attribute(emissions(spark, rows + [(900, None, 1.0, 446e6, -1.0, None), (901, 1.0, 5.0, 446e6, None, None)])).collect()
    assert set(staging._written) == before
    want = brute_attribution(rows) | {900: (None, None), 901: (None, None)}
    assert {r.row_id: (r.attributed_to_hz, r.attribution) for r in told} == want
    assert {k for _, k in want.values()} >= {None, "SPLATTER"}
    few = [(i, t, d, f, p, None) for i, t, d, f, p, _ in rows if p > -12]
    told = attribution.intermodulation(emissions(spark, rows)).count(), attribution.splatter(emissions(spark, few)).count()
    assert told[0] > 0 and told[1] == sum(k == "SPLATTER" for _, k in brute_attribution(few).values())


def test_mean_errors_ties_and_halves(spark, tmp_path):
    """Of equal peaks the first counts, and a mean that ends in a half is rounded up whatever the order of summation."""
    rows = [(i, 1, v) for i, v in enumerate([5.0, 90.5, 3.25, 90.5, None])]
    cents = [36.03] * 63 + [36.05 + 0.24]  # 2306.18 / 64 = 36.0340625
    for user in range(2, 12):
        random.Random(user).shuffle(cents)
        rows += [(100 * user + i, user, v) for i, v in enumerate(cents)]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.user_id: (r.peak_id, r.mean_hz) for r in queries.QUERIES["mean_errors"](spark, str(tmp_path)).collect()}
    assert got[1][0] == 1 and {got[u][1] for u in range(2, 12)} == {36.034063}


def test_mean_errors_round_as_the_sql_does(spark, tmp_path):
    """Where a mean ends in a half, the sum of the rows as they come decides, in Spark as in DuckDB."""
    rng = random.Random(3)
    rows = []
    for user in range(60):
        cents = [rng.randrange(1, 20_000) for _ in range(63)]
        cents.append(100 + (2 - sum(cents) - 100) % 4)  # the sum of cents is 2 modulo 4, so a 64th of it ends in a half at the seventh place
        rows += [(64 * user + i, user, c / 100) for i, c in enumerate(cents)]
    rows += [(10_000 + i, 99, v) for i, v in enumerate([-3.5, None, -0.0000005])]
    spark.createDataFrame(rows, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = {r[0]: r for r in c.sql(queries.ORACLE["mean_errors"]).fetchall()}
    assert {r[0]: tuple(r) for r in queries.QUERIES["mean_errors"](spark, str(tmp_path)).collect()} == want
    ups = [want[u][2] * 6_400 > sum(round(v * 100) for _, x, v in rows if x == u) for u in range(60)]
    assert 0 < sum(ups) < 60


def test_attribution_sends_counts_alone(spark, monkeypatch):
    """Emissions that cross slabs are told counts, once for each frequency; lists of parents by slab filled the disk."""
    from bandscope.operators import onair

    monkeypatch.setattr(onair, "SLAB", 0.5)
    rng = random.Random(8)
    rows = [(i, rng.uniform(0, 300), rng.uniform(20, 60), 446e6 + 900.0 * rng.randint(0, 60), rng.uniform(-60, 0), None) for i in range(800)]
    e = staged(emissions(spark, rows))
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = sent()
    told = {r.row_id: (r.attributed_to_hz, r.attribution) for r in attribution.attribute(e).collect()}
    assert 0 < sent() - before < 800_000
    assert told == brute_attribution(rows)
