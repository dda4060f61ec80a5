"""Keep a store of attributed emissions by day, from an archive of reports that grows.

    python -m jobs.activity_store --reports PATH --out PATH --checkpoint PATH [--config FILE]

Each run takes the files that have arrived since the run before (a file stream
with ``availableNow``; its checkpoint holds what has been taken) and writes

* ``out/received``: the new emissions, partitioned by day and batch,
* ``out/activity``: emissions with the stronger emission that explains them, partitioned by day,
* ``out/batches``: what each batch held.

A new emission can change what is said of others, even of another day: it may
explain a by-product, or be the mirror partner of one. Both are linked through
emissions that are on air together, so only emissions that start within two
longest durations of it can change. The days that hold those are worked out
again, from the rows that may bear on them; other days aren't read.

Reruns are safe. A batch that is repeated after a failure holds the same files
and replaces its own partitions; a day's partition is replaced whole. A run
without new files writes nothing. Late reports go to their own day.
"""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandscope import schema as S
from bandscope.functions.expr import utc_hour
from bandscope.operators import attribution
from bandscope.operators.staging import released, staged
from bandscope.plans.views import as_emissions

from .common import log, read_config, session

RECEIVED = (
    "row_id bigint, timestamp double, frequency_hz double, pmr_channel int, duration_s double, peak_power_dbfs double, snr_db double, ctcss_tone_hz double, "
    "source_id bigint, kind string, day date, batch bigint"
)
ACTIVITY = RECEIVED.replace("batch bigint", "hour int, attributed_to_hz double, attribution string").replace("day date, ", "") + ", day date"
BATCHES = "reports bigint, longest_s double, first_s double, last_s double, batch bigint"
DAY_S = 86_400.0


@dataclass(frozen=True)
class Config:
    files_per_batch: int = 1_000
    tolerance_hz: float = S.PRODUCT_TOLERANCE_HZ
    margin_db: float = S.LEVEL_MARGIN_DB


def day_of(seconds) -> F.Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / DAY_S).cast("int"))


def _replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write ``rows``; partitions that they touch are replaced, others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take(new: DataFrame, batch: int, out: str, config: Config) -> None:
    """Store one batch of reports and work out again the days that it bears on."""
    spark = new.sparkSession
    e = as_emissions(new).withColumns({"day": day_of(F.col("timestamp")), "batch": F.lit(batch).cast("bigint")})
    # Rows without a time or an extent can't be placed; they are kept under the null day and explain nothing.
    _replace(e, f"{out}/received", "day", "batch")
    received = spark.read.schema(RECEIVED).parquet(f"{out}/received")
    mine = received.where(F.col("batch") == batch)
    told = mine.agg(F.count("*").alias("reports"), F.max("duration_s").alias("longest_s"), F.min("timestamp").alias("first_s"), F.max("timestamp").alias("last_s"))
    _replace(told.withColumn("batch", F.lit(batch).cast("bigint")), f"{out}/batches", "batch")

    # One row a batch: the longest emission so far, without a look at what earlier batches stored.
    longest = spark.read.schema(BATCHES).parquet(f"{out}/batches").agg(F.coalesce(F.max("longest_s"), F.lit(0.0))).first()[0]
    reach = 2 * max(longest, 0.0)
    touched = F.sequence(F.floor((F.col("timestamp") - reach) / DAY_S), F.floor((F.col("timestamp") + F.greatest("duration_s", F.lit(0.0)) + reach) / DAY_S))
    spans = mine.where("timestamp is not null").withColumn("duration_s", F.coalesce("duration_s", F.lit(0.0)))
    days = sorted(r.d for r in spans.select(F.explode(touched).alias("d")).distinct().collect())  # a few numbers: days of the calendar
    around = sorted({d + k for d in days for k in range(-int(reach // DAY_S) - 1, int(reach // DAY_S) + 2)})
    date = lambda d: day_of(F.lit(float(d) * DAY_S))
    context = received.where(F.col("day").isin([date(d) for d in around]) | F.col("day").isNull()).drop("batch")
    with released(spark):
        found = attribution.attribute(staged(context), config.tolerance_hz, config.margin_db)
        found = found.where(F.col("day").isin([date(d) for d in days]) | F.col("day").isNull()).withColumn("hour", utc_hour("timestamp"))
        _replace(found.select(*(c.split()[0] for c in ACTIVITY.split(", "))).hint("rebalance", "day"), f"{out}/activity", "day")
    log.info("batch %d: read %d reports, wrote %d days of %s/activity", batch, mine.count(), len(days), out)


def run(spark: SparkSession, reports: str, out: str, checkpoint: str, config: Config = Config()) -> dict:
    """Take what is new under ``reports``; returns how many batches and reports that were."""
    log.info("reading %s with %s", reports, asdict(config))
    known = spark.read.parquet(reports).schema
    # As a pattern that the path alone matches: then a single file will do as well as a folder.
    only = reports.rstrip("/")
    stream = spark.readStream.schema(known).option("maxFilesPerTrigger", config.files_per_batch).parquet(f"{only[:-1]}[{only[-1]}]")
    done: list[int] = []

    def each(new: DataFrame, batch: int) -> None:
        take(new, batch, out, config)
        done.append(batch)

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    n = spark.read.schema(BATCHES).parquet(f"{out}/batches").where(F.col("batch").isin(done)).agg(F.sum("reports")).first()[0] if done else 0
    log.info("%d batches, %d new reports", len(done), n)
    return {"batches": len(done), "reports": n}


def read_activity(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(ACTIVITY).parquet(f"{out}/activity")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.activity_store", description=__doc__.splitlines()[0])
    for name in ("reports", "out", "checkpoint"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    spark = session("activity_store")
    try:
        run(spark, a.reports, a.out, a.checkpoint, read_config(Config, a.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
