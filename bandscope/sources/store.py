"""Stored emissions: readers, writers, scenario and calibration files, and the store's SQL."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import asdict
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.dsp import Scenario
from .sqlite import SqliteStore, count_rows

GAIN_FIELDS = ("lna_db", "vga_db", "amp_enabled")


def _exists(spark: SparkSession, path: str) -> bool:
    """On any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def flattened(reports: DataFrame) -> DataFrame:
    """The store's columns: gains become three columns, null where none were recorded."""
    if "gains" in reports.columns:
        reports = reports.select("*", *(F.col(f"gains.{c}").alias(c) for c in GAIN_FIELDS)).drop("gains")
    return reports.select(*(F.col(c) if c in reports.columns else F.lit(None).alias(c) for c in S.STORE_COLUMNS))


def nested(rows: DataFrame) -> DataFrame:
    """Reports with the gains as a structure; columns that an older store lacks are null."""
    types = dict(x.strip().split(" ", 1) for x in S.EMISSION_DDL.replace("gains struct<lna_db: double, vga_db: double, amp_enabled: boolean>, ", "").split(","))
    col = lambda c, t: (F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c)
    some = F.coalesce(*(F.col(c).cast("string") for c in GAIN_FIELDS)) if all(c in rows.columns for c in GAIN_FIELDS) else F.lit(None)
    gains = F.when(some.isNotNull(), F.struct(*(col(c, "boolean" if c == "amp_enabled" else "double") for c in GAIN_FIELDS))).alias("gains")
    first = [col(c, t) for c, t in types.items()]
    row_id = [F.col("row_id")] if "row_id" in rows.columns else []
    return rows.select(*row_id, *first[:13], gains, *first[13:])


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Reports of an archive with one JSON object a line, and the lines that are no reports (a cut last line, for one).

    A line is either good or bad as a whole. ``row_id`` follows the order of the files and of the lines in them.
    """
    schema = f"{S.EMISSION_DDL}, _corrupt_record string"
    text = spark.read.text(path).where(F.trim("value") != "").withColumn("row_id", F.monotonically_increasing_id())
    parsed = text.withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    good = parsed.where(~bad).select("row_id", "r.*").drop("_corrupt_record")
    flat = good.select("*", *(F.col(f"gains.{c}").alias(c) for c in GAIN_FIELDS)).drop("gains")
    return nested(flat), parsed.where(bad).select("row_id", F.col("value").alias("line"))


def read_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """Reports of a single-file store, by ranges of its key, which becomes ``row_id``."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    spark.dataSource.register(SqliteStore)
    return nested(spark.read.format("sqlite_store").load(path).withColumnRenamed("id", "row_id"))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """Reports by the store's extension, in time order (the stored order among equals)."""
    extension = os.path.splitext(path)[1].lower()
    if extension not in (".jsonl", ".db", ".sqlite", ".parquet"):
        raise ValueError(f"unknown store type {extension or path}")
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    if extension == ".jsonl":
        out = read_jsonl(spark, path)[0]
    elif extension == ".parquet":
        out = nested(spark.read.option("mergeSchema", True).parquet(path).withColumn("row_id", F.monotonically_increasing_id()))
    else:
        out = read_sqlite(spark, path)
    return out.orderBy("timestamp", "row_id")


def write_reports(reports: DataFrame, path: str) -> int:
    """Append reports to a store, by its extension; returns how many."""
    extension = os.path.splitext(path)[1].lower()
    if extension not in (".jsonl", ".parquet", ".db", ".sqlite"):
        raise ValueError(f"unknown store type {extension or path}")
    if extension in (".db", ".sqlite"):
        rows = flattened(reports)
        rows = rows.withColumns({c: F.col(c).cast("string" if c in ("classification", "attribution") else "bigint" if c in ("pmr_channel", "bin_index", "calibrated", "amp_enabled") else "double") for c in rows.columns})
        spark = reports.sparkSession
        spark.dataSource.register(SqliteStore)
        before = count_rows(path)
        rows.write.format("sqlite_store").mode("append").save(path)
        return count_rows(path) - before
    if extension == ".jsonl":
        out = reports.select(*(c for c in reports.columns if c in S.STORE_COLUMNS or c == "gains"))
        before = out.count()
        out.write.mode("append").option("ignoreNullFields", False).json(path)
        return before
    flat = flattened(reports)
    n = flat.count()
    flat.write.mode("append").parquet(path)
    return n


def open_sink(path: str | None) -> Callable[[DataFrame, int], int] | None:
    """A sink for ``foreachBatch`` or a single write, by the store's extension; None where no store is wanted. It appends: a batch that is
    repeated is appended again, which ``table_sink`` avoids."""
    if path is None:
        return None
    if os.path.splitext(path)[1].lower() not in (".jsonl", ".parquet", ".db", ".sqlite"):
        raise ValueError(f"unknown store type {path}")
    return lambda reports, batch=0: write_reports(reports, path)


def store_sql(spark: SparkSession, path: str, sql: str, **parameters) -> DataFrame:
    """Run SQL with named parameters over the store, as the view ``emissions``."""
    spark.read.option("mergeSchema", True).parquet(path).createOrReplaceTempView("emissions")
    return spark.sql(sql, args=parameters)


def read_scenario(path: str) -> Scenario:
    import yaml

    with open(path, encoding="utf-8") as f:
        return Scenario.from_dict(yaml.safe_load(f))


def write_scenario(scene: Scenario, path: str) -> None:
    """The scene's settings as a file that ``read_scenario`` reads back."""
    import yaml

    told = asdict(scene)
    told["propagation"] = {"path_loss_exponent": told.pop("exponent"), "shadowing_sigma_db": told.pop("shadowing_sigma_db")}
    for e in told["emitters"]:
        e["transmissions"] = [{"start_s": a, "stop_s": b} for a, b in e["transmissions"]]
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(told, f, sort_keys=False)


def read_calibrations(spark: SparkSession, path: str) -> DataFrame:
    """Calibrations by gain setting; a missing file means none, which is no error."""
    from ..operators.calibration import CALIBRATION_DDL

    rows: list[tuple] = []
    if os.path.exists(path):
        import yaml

        with open(path, encoding="utf-8") as f:
            for key, c in (yaml.safe_load(f) or {}).get("calibrations", {}).items():
                low, high = c.get("valid_range_dbfs", (None, None))
                rows.append((key, c["offset_db"], c["slope"], c.get("r_squared"), c.get("residual_rms_db"), low, high, c.get("num_points")))
    return spark.createDataFrame(rows, CALIBRATION_DDL)


def write_calibrations(calibrations: DataFrame, path: str) -> None:
    """One entry for each gain setting, a handful."""
    import yaml

    entries = {r.gain_key: {"offset_db": r.offset_db, "slope": r.slope, "r_squared": r.r_squared, "residual_rms_db": r.residual_rms_db, "valid_range_dbfs": [r.valid_lo, r.valid_hi], "num_points": r.num_points} for r in calibrations.collect()}
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump({"calibrations": entries}, f, sort_keys=True)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of the non-blank lines of files that arrive in a folder."""
    return spark.readStream.text(folder).where(F.trim("value") != "")


def parsed_target(url: str | None) -> tuple[str, str, int] | None:
    """Scheme, host and port of a publishing target; none means that nothing is published."""
    if url is None:
        return None
    u = urlparse(url)
    if u.scheme not in ("udp", "tcp", "tls"):
        raise ValueError(f"unknown transport {u.scheme or url}")
    if not u.hostname:
        raise ValueError(f"no host in {url}")
    return u.scheme, u.hostname, u.port or 4242
