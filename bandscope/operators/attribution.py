"""Attribution of by-products to stronger simultaneous emissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .joins import interval_join
from .onair import related, strongest_parents


def _side(emissions: DataFrame, prefix: str) -> DataFrame:
    return emissions.select(
        F.col("row_id").alias(f"{prefix}_id"),
        F.col("timestamp").alias(f"{prefix}_t0"),
        (F.col("timestamp") + F.col("duration_s")).alias(f"{prefix}_t1"),
        F.col("frequency_hz").alias(f"{prefix}_f"),
        F.col("peak_power_dbfs").alias(f"{prefix}_p"),
    )


def parent_pairs(emissions: DataFrame, margin_db: float = S.LEVEL_MARGIN_DB) -> DataFrame:
    """(weak, strong) pairs on air together, the strong one at least the margin above. They grow with the square of traffic; attribution itself doesn't list them."""
    return interval_join(_side(emissions, "w"), _side(emissions, "s"), ("w_t0", "w_t1"), ("s_t0", "s_t1"), F.col("s_p") - F.col("w_p") >= margin_db)


def splatter(emissions: DataFrame, tolerance_hz: float = S.PRODUCT_TOLERANCE_HZ, margin_db: float = S.LEVEL_MARGIN_DB) -> DataFrame:
    """Weak emissions with a mirror partner about a parent: the partner is a weak child of the same parent."""
    return strongest_parents(emissions, tolerance_hz, margin_db, ("SPLATTER",)).drop("kind")


def intermodulation(emissions: DataFrame, tolerance_hz: float = S.PRODUCT_TOLERANCE_HZ, margin_db: float = S.LEVEL_MARGIN_DB) -> DataFrame:
    """Weak emissions at twice one parent's frequency less another's; the doubled parent is named."""
    return strongest_parents(emissions, tolerance_hz, margin_db, ("INTERMOD3",)).drop("kind")


def attribute(emissions: DataFrame, tolerance_hz: float = S.PRODUCT_TOLERANCE_HZ, margin_db: float = S.LEVEL_MARGIN_DB) -> DataFrame:
    """All rows, with ``attributed_to_hz`` and ``attribution`` set where a relation explains them; splatter comes first."""
    first = F.min(F.struct((F.col("kind") != "SPLATTER").alias("later"), (-F.col("p")).alias("o"), "parent_id", "parent_hz", "kind"))
    found = related(emissions, tolerance_hz, margin_db).groupBy("row_id").agg(first.alias("b"))
    found = found.select("row_id", F.col("b.parent_hz").alias("attributed_to_hz"), F.col("b.kind").alias("attribution"))
    return emissions.drop("attributed_to_hz", "attribution").join(found, "row_id", "left")


def totals(attributed: DataFrame) -> DataFrame:
    """How many emissions there are, and how many each relation explains; one row, zeros for an empty table."""
    kind = F.col("attribution")
    return attributed.agg(F.count("*").alias("emissions"), F.count_if(kind == "SPLATTER").alias("splatter"), F.count_if(kind == "INTERMOD3").alias("intermod"), F.count_if(kind.isNull()).alias("own"))
