"""Command line: ``python -m bandscope {node,battle,demo,simulate,extract,dashboard,frequency} ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S


def _show(df: DataFrame) -> None:
    for row in df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator():
        print(row.j)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="bandscope")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("node", "extract", "frequency"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("--format")
        c.add_argument("--rate", type=float, default=2_000_000.0)
        c.add_argument("--centre", type=float, default=S.RECEIVER_CENTRE_HZ)
        c.add_argument("--channels", type=int, default=160)
        c.add_argument("--store")
        c.add_argument("--friend", type=float)
        c.add_argument("--nominal", type=float)
        c.add_argument("--start", type=float, default=0.0)
        c.add_argument("--duration", type=float, default=1.0)
        c.add_argument("--target-rate", type=float)
        c.add_argument("--target-centre", type=float)
        c.add_argument("--write", choices=("cf32", "cs16", "cs8"))
    c = sub.add_parser("battle")
    c.add_argument("path")
    c.add_argument("--json", action="store_true")
    c.add_argument("--since", type=float)
    c.add_argument("--channel", type=int)
    c = sub.add_parser("dashboard")
    c.add_argument("path")
    c.add_argument("out")
    for name in ("demo", "simulate"):
        c = sub.add_parser(name)
        c.add_argument("scenario")
        c.add_argument("--out")
        c.add_argument("--format", default="cs16")
    a = p.parse_args(argv)

    from .functions import publish
    from .operators import signal
    from .plans import reports
    from .plans.shipping import ship
    from .sources import iq, store

    spark = SparkSession.builder.appName("bandscope").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ship(spark)
    if a.command in ("node", "extract", "frequency"):
        settings = S.Settings(sample_rate=a.rate, centre_hz=a.centre, num_channels=a.channels, decimation=a.channels // 2)
        blocks = iq.read_iq(spark, a.path, settings, a.format)
        if a.command == "node":
            found = signal.run_capture(blocks, settings, a.friend)
            print(store.write_reports(found, a.store)) if a.store else _show(found)
        elif a.command == "extract":
            part = iq.extract(blocks, a.start, a.duration, a.rate)
            if part.isEmpty():
                print("the span is not in the capture", file=sys.stderr)
                return 1
            if a.target_rate:
                part = iq.extract_span(blocks, a.start, a.duration, a.rate, a.target_rate, (a.target_centre or a.centre) - a.centre)
            if a.write:  # raw samples, counted from the span's first, with a sidecar
                if not a.target_rate:
                    first = int(a.start * a.rate)
                    part = part.withColumn("start_sample", F.col("start_sample") - F.lit(first // iq.block_samples(settings) * iq.block_samples(settings)))
                name, began = (F.lit("extract"), F.lit(a.start)) if a.target_rate else (F.col("capture_id"), F.col("start_time"))
                iq.write_blocks(part.withColumns({"capture_id": name, "start_time": began}), a.store or "extract", a.write, sample_rate=a.target_rate or a.rate, centre_hz=a.target_centre or a.centre)
            else:
                part.drop("halo", "last").write.mode("overwrite").parquet(a.store or "extract.parquet")
        else:
            spectrum = signal.survey(blocks, a.rate, a.centre, 1 << 13, 1 << 13).select("capture_id", "frequency_hz", F.pow(F.lit(10.0), F.col("power_db") / 10).alias("power"))
            _show(signal.mean_error(signal.reference_errors(spectrum, a.nominal, a.centre)))
    elif a.command == "battle":
        found = reports.order_of_battle(store.read_reports(spark, a.path), a.since, a.channel)
        columns = ["label", "transmissions", "airtime_s", "duty_cycle", "proven_multiple"]
        rows = found["emitters"].select(*columns).collect()
        print(json.dumps([r.asDict() for r in rows], indent=2) if a.json else publish.describe(rows, "emitters", columns))
    elif a.command == "dashboard":
        with open(a.out, "w", encoding="utf-8") as f:
            f.write(reports.dashboard_page(store.read_reports(spark, a.path)))
    else:
        scene = store.read_scenario(a.scenario)
        settings = S.Settings(sample_rate=scene.sample_rate, centre_hz=scene.centre_frequency, num_channels=int(scene.sample_rate // S.CHANNEL_SPACING_HZ), decimation=int(scene.sample_rate // S.CHANNEL_SPACING_HZ) // 2)
        if a.command == "demo":
            _show(reports.demo(spark, scene, settings)["summary"])
        else:
            blocks, truth = signal.synthesise(spark, scene, settings)
            iq.write_blocks(blocks, a.out or scene.name, a.format, sample_rate=scene.sample_rate, centre_hz=scene.centre_frequency)
            truth.write.mode("overwrite").json(f"{a.out or scene.name}.truth")
    return 0


if __name__ == "__main__":
    sys.exit(main())
