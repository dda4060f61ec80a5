"""The jobs: two runs over growing copies, reruns, repeated batches, edges, and their SQL."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

duckdb = pytest.importorskip("duckdb")

from bandscope.operators import attribution  # noqa: E402
from bandscope.operators.staging import staged  # noqa: E402
from bandscope.plans.views import as_emissions  # noqa: E402
from jobs import activity_store, publish_log, registry  # noqa: E402
from jobs.common import read_config  # noqa: E402

SF = "/root/testdata/sf0.001"


def whole(spark, path):
    """What one pass over all reports says of each emission."""
    e = staged(as_emissions(spark.read.parquet(path)))
    return sorted((r.row_id, r.attributed_to_hz, r.attribution) for r in attribution.attribute(e).collect())


def stored(spark, out):
    return sorted((r.row_id, r.attributed_to_hz, r.attribution) for r in activity_store.read_activity(spark, out).collect())


def test_activity_takes_only_what_is_new_and_equals_one_pass(spark, tmp_path):
    reports, out, mark = str(tmp_path / "reports"), str(tmp_path / "out"), str(tmp_path / "mark")
    events = spark.read.parquet(f"{SF}/events.parquet")
    # Not in time order: the second part changes what the first run said of days it had done.
    parts = [events.where(F.col("event_id") % 3 == k) for k in range(3)]
    parts[0].coalesce(1).write.mode("append").parquet(reports)
    assert activity_store.run(spark, reports, out, mark) == {"batches": 1, "reports": parts[0].count()}
    first = stored(spark, out)
    assert first == whole(spark, reports)
    parts[1].coalesce(1).write.mode("append").parquet(reports)
    parts[2].coalesce(1).write.mode("append").parquet(reports)
    one = activity_store.Config(files_per_batch=1)
    assert activity_store.run(spark, reports, out, mark, one) == {"batches": 2, "reports": parts[1].count() + parts[2].count()}
    second = stored(spark, out)
    assert second == whole(spark, reports)
    told = {r[0]: r for r in second}
    assert any(told[r[0]] != r for r in first)
    assert activity_store.run(spark, reports, out, mark) == {"batches": 0, "reports": 0}
    assert stored(spark, out) == second


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    events = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 60")
    for _ in range(2):
        activity_store.take(events, 0, out, activity_store.Config())
    assert activity_store.read_activity(spark, out).count() == 60
    assert spark.read.schema(activity_store.RECEIVED).parquet(f"{out}/received").count() == 60


def test_only_days_in_reach_are_written_again(spark, tmp_path):
    out = tmp_path / "out"
    events = spark.read.parquet(f"{SF}/events.parquet")
    early, late = events.where("ts < '2024-01-20'"), events.where("ts >= '2024-01-20'")
    activity_store.take(early, 0, str(out), activity_store.Config())
    before = {p.parent.name: p.stat().st_mtime_ns for p in out.glob("activity/day=*/*.parquet")}
    activity_store.take(late, 1, str(out), activity_store.Config())
    after = {p.parent.name: p.stat().st_mtime_ns for p in out.glob("activity/day=*/*.parquet")}
    assert {d for d in before if before[d] == after[d]} >= {f"day=2024-01-{k:02d}" for k in range(1, 19)}


def test_activity_of_reports_without_values(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = [(1, None, 2, None, None, None), (None, None, None, None, None, None), (3, None, 4, "x", 5.0, '{"k": 1}')]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    activity_store.take(events, 0, out, activity_store.Config())
    assert activity_store.read_activity(spark, out).count() == 3
    activity_store.take(events.where("event_id > 5"), 1, out, activity_store.Config())
    assert activity_store.read_activity(spark, out).count() == 3


def test_published_parts_are_whole_and_fit(spark, tmp_path):
    hostile = "\"'&<>" * 4_001 + "é\u0001￾\n𝄞" * 30
    rows = [("a", "notes", "s&<", hostile), ("b", "notes", None, None), ("c", "notes", "", ""), ("b", "notes", None, None), (None, "notes", "x", "a\tb")]
    config = publish_log.Config(part_characters=9_999)
    events = publish_log.events(spark.createDataFrame(rows, "name string, log string, sender string, text string"), config).collect()
    assert len(events) == 7 and max(len(r.event.encode()) for r in events) <= publish_log.DATAGRAM_BYTES
    parts = sorted((r.part, ET.fromstring(r.event.encode())) for r in events if r["name"] == "a")
    assert "".join(e.find("detail/remarks").text for _, e in parts) == hostile.replace("\u0001", "").replace("￾", "")
    assert {e.find("detail/contact").get("callsign") for _, e in parts} == {"s&<"}
    assert sorted((r.sender, r.part, r.parts) for r in events if r["name"] in ("b", "c")) == [("unknown", 1, 1)] * 3


def test_publishing_again_gives_the_same(spark, tmp_path):
    out = str(tmp_path / "events")
    n = publish_log.run(spark, f"{SF}/documents.parquet", f"{SF}/conversations.parquet", out)
    first = sorted(map(tuple, publish_log.read_events(spark, out).collect()))
    assert publish_log.run(spark, f"{SF}/documents.parquet", f"{SF}/conversations.parquet", out) == n == len(first)
    assert sorted(map(tuple, publish_log.read_events(spark, out).collect())) == first
    assert {p.name for p in (tmp_path / "events").iterdir() if p.is_dir()} == {"log=notes", "log=messages"}


def test_settings_files(tmp_path):
    assert read_config(activity_store.Config, None) == activity_store.Config()
    assert read_config(activity_store.Config, "jobs/activity_store.json") == activity_store.Config()
    assert read_config(publish_log.Config, "jobs/publish_log.json").latitude == 48.0
    (tmp_path / "c.json").write_text(json.dumps({"no_such": 1}))
    with pytest.raises(ValueError):
        read_config(publish_log.Config, str(tmp_path / "c.json"))
    with pytest.raises(ValueError):
        publish_log.Config(part_characters=60_000)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_jobs_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    before = dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())
    mine = registry.QUERIES[name](spark, SF)
    assert (dict(spark.conf.getAll) if not callable(spark.conf.getAll) else dict(spark.conf.getAll())) == before
    columns = sorted(mine.columns)
    theirs = con.sql(registry.ORACLE[name])
    assert sorted(theirs.columns) == columns
    want = sorted(map(str, con.sql(f"select {','.join(columns)} from theirs").fetchall()))
    assert sorted(str(tuple(r[c] for c in columns)) for r in mine.collect()) == want
