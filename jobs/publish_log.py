"""Publish text logs as event documents that each fit a datagram.

    python -m jobs.publish_log --notes PATH --messages PATH --out PATH [--config FILE]

``notes`` are rows of ``documents`` (doc_id, text, source), ``messages`` rows of
``conversations`` (conv_id, turn, role, text). Whole texts are published: a long
one becomes several events, numbered from 1, whose remarks joined are the text.
A part has so few characters that its event fits a datagram even if every
character must be escaped. Characters that XML can't hold are left out.

The output is partitioned by log and sender, and replaced whole, so a rerun
gives the same rows. Rows are dealt by sender and a busy sender is split over
tasks and files. A null or empty text is one event without remarks; a null or
empty sender is published as ``unknown``; rows that occur twice are published twice.
"""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandscope.functions import publish

from .common import log, read_config, session

EVENTS = "name string, part int, parts int, event string, log string, sender string"
#: Largest payload of a datagram, and the most bytes that one character of a text becomes (``&quot;``).
DATAGRAM_BYTES, CHARACTER_BYTES = 65_507, 6
#: Room for the rest of an event.
FRAME_BYTES = 4_096


@dataclass(frozen=True)
class Config:
    part_characters: int = 10_000
    rows_per_file: int = 100_000
    #: When the log was released, in seconds of UTC: texts have no time of their own.
    released_s: float = 1_786_950_000.0
    stale_s: float = 300.0
    latitude: float = 0.0
    longitude: float = 0.0
    altitude_m: float = 0.0
    prefix: str = "BAND"

    def __post_init__(self):
        if not 1 <= self.part_characters <= (DATAGRAM_BYTES - FRAME_BYTES) // CHARACTER_BYTES:
            raise ValueError("a part's event must fit a datagram")


def events(texts: DataFrame, config: Config) -> DataFrame:
    """Event documents of ``texts`` (name, log, sender, text): one row for each part."""
    size = config.part_characters
    site = publish.Site(config.latitude, config.longitude, config.altitude_m, config.prefix)
    text = F.coalesce("text", F.lit(""))
    parts = F.greatest(F.ceil(F.char_length(text) / size), F.lit(1)).cast("int")
    sender = F.coalesce(F.nullif("sender", F.lit("")), F.lit("unknown"))
    each = texts.select("name", "log", sender.alias("sender"), text.alias("text"), parts.alias("parts")).withColumn("part", F.explode(F.sequence(F.lit(1), "parts")))
    each = each.withColumns({"text": F.substring("text", (F.col("part") - 1) * size + 1, F.lit(size)), "timestamp": F.lit(config.released_s), "duration_s": F.lit(0.0)})
    uid = F.concat_ws(".", F.lit(site.prefix), "name", F.col("part").cast("string"))
    return each.select("name", "part", "parts", publish.note(site, uid, F.col("sender"), F.col("text"), config.stale_s).alias("event"), "log", "sender")


def named(*parts) -> F.Column:
    return F.concat_ws(".", *(F.coalesce(F.col(p).cast("string"), F.lit("none")) for p in parts))


def run(spark: SparkSession, notes: str, messages: str, out: str, config: Config = Config()) -> int:
    """Publish both logs into ``out``; returns how many events it holds."""
    log.info("reading %s and %s with %s", notes, messages, asdict(config))
    a = spark.read.parquet(notes).select(F.concat(F.lit("note."), named("doc_id")).alias("name"), F.lit("notes").alias("log"), F.col("source").alias("sender"), "text")
    b = spark.read.parquet(messages).select(F.concat(F.lit("message."), named("conv_id", "turn")).alias("name"), F.lit("messages").alias("log"), F.col("role").alias("sender"), "text")
    told = events(a.unionByName(b), config).hint("rebalance", "log", "sender")
    told.write.mode("overwrite").option("maxRecordsPerFile", config.rows_per_file).partitionBy("log", "sender").parquet(out)
    written = {r["log"]: r["n"] for r in read_events(spark, out).groupBy("log").agg(F.count("*").alias("n")).collect()}
    log.info("wrote %s events to %s", written or "no", out)
    return sum(written.values())


def read_events(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(out)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="jobs.publish_log", description=__doc__.splitlines()[0])
    for name in ("notes", "messages", "out"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--config")
    a = p.parse_args(argv)
    spark = session("publish_log")
    try:
        run(spark, a.notes, a.messages, a.out, read_config(Config, a.config))
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
