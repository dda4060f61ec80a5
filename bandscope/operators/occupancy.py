"""Occupancy by channel and hour, its marginals, and profile statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import utc_hour
from .staging import staged


def own_emissions(emissions: DataFrame) -> DataFrame:
    """Without by-products, if the table says which they are."""
    return emissions.where(F.col("attribution").isNull()) if "attribution" in emissions.columns else emissions


def channel_hour(emissions: DataFrame) -> DataFrame:
    """Air time and count by channel (null: off the grid, a class of its own) and hour in UTC."""
    return own_emissions(emissions).groupBy("pmr_channel", utc_hour("timestamp").alias("hour")).agg(F.sum("duration_s").alias("airtime_s"), F.count("*").alias("n"))


def marginals(emissions: DataFrame) -> DataFrame:
    """Air time by channel, by hour and in all, in one pass; ``level`` is 1, 2 or 3."""
    e = own_emissions(emissions).withColumn("hour", utc_hour("timestamp"))
    return (
        e.groupingSets([["pmr_channel"], ["hour"], []], "pmr_channel", "hour")
        .agg(F.sum("duration_s").alias("airtime_s"), F.count("*").alias("n"), F.grouping_id().alias("level"))
    )


def busiest(emissions: DataFrame, by: str, limit: int = 5) -> DataFrame:
    e = own_emissions(emissions).withColumn("hour", utc_hour("timestamp"))
    return e.groupBy(by).agg(F.sum("duration_s").alias("airtime_s")).orderBy(F.desc("airtime_s"), F.asc_nulls_last(by)).limit(limit)


def band_load(emissions: DataFrame) -> DataFrame:
    """Total air time, observed window and their quotient; zeros for an empty table."""
    e = own_emissions(emissions).agg(F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("airtime_s"), F.coalesce(F.max(F.col("timestamp") + F.col("duration_s")) - F.min("timestamp"), F.lit(0.0)).alias("window_s"))
    return e.withColumn("duty_cycle", F.when(F.col("window_s") > 0, F.col("airtime_s") / F.col("window_s")).otherwise(F.lit(0.0)))


def grid(emissions: DataFrame) -> DataFrame:
    """Channels by rows and the 24 hours by columns, off-grid emissions last."""
    hours = list(range(24))
    out = channel_hour(emissions).groupBy("pmr_channel").pivot("hour", hours).agg(F.sum("airtime_s"))
    return out.select("pmr_channel", *(F.coalesce(F.col(str(h)), F.lit(0.0)).alias(f"h{h:02d}") for h in hours)).orderBy(F.asc_nulls_last("pmr_channel"))


#: Values of a profile and their cells: narrow ranges of value that hold few distinct values each. A cell's number never falls as the value rises.
_CELLS = {
    "duration_s": lambda v: F.floor(F.log2(F.greatest(v, F.lit(0.0)) + 1) * 1024),
    "gap": lambda v: F.floor(F.log2(F.greatest(v, F.lit(0.0)) + 1) * 1024),
    "peak_power_dbfs": lambda v: F.floor(v * 100),
    "frequency_hz": lambda v: F.floor(v / 10),
}
DAY_S = 86_400.0


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on columns that may be null; the left side's are kept."""
    names = {c: f"{c}__r" for c in on}
    condition = None
    for c, r in names.items():
        same = F.col(c).eqNullSafe(F.col(r))
        condition = same if condition is None else condition & same
    return left.join(right.withColumnsRenamed(names), condition, how).drop(*names.values())


def with_gaps(members: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``gap``, the silence since the end of the emission before in the group (null if it was still on), and ``together``:
    whether any earlier one of the group was still on.

    Groups are cut by day; each day is told what the days before leave, so no task holds a group's whole history.
    """
    order = F.struct("timestamp", "row_id")
    e = members.withColumn("end__", F.col("timestamp") + F.col("duration_s")).withColumn("day__", F.floor(F.col("timestamp") / DAY_S))
    along = Window.partitionBy(*keys).orderBy("day__")
    days = e.groupBy(*keys, "day__").agg(F.max_by("end__", order).alias("last__"), F.max("end__").alias("top__"))
    left = days.select(*keys, "day__", F.lag("last__").over(along).alias("before__"), F.max("top__").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("open__"))
    w = Window.partitionBy(*keys, "day__").orderBy("timestamp", "row_id")
    e = _met(e, left, [*keys, "day__"])
    gap = F.col("timestamp") - F.when(F.row_number().over(w) == 1, F.col("before__")).otherwise(F.lag("end__").over(w))
    latest = F.greatest(F.col("open__"), F.max("end__").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.withColumns({"gap": gap, "together": F.coalesce(F.col("timestamp") < latest, F.lit(False))})
    return e.withColumn("gap", F.when(F.col("gap") >= 0, F.col("gap"))).drop("end__", "day__", "before__", "open__", "last__", "top__")


def order_statistics(members: DataFrame, keys: list[str], cells: dict = _CELLS) -> DataFrame:
    """For each group the exact median and index spread of each column of ``cells``, as ``median_<column>`` and ``spread_<column>``.

    The spread is the inner-quartile distance by index of the sorted values, zero below two values. Equal values are counted first;
    cells are summed and only the cells that hold a wanted rank are ordered, so a task orders a few values and never a group.
    """
    values = F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).alias("v"), cell(F.col(c)).alias("cell")) for c, cell in cells.items()))
    each = members.select(*keys, F.explode(values).alias("x__")).select(*keys, "x__.*").where("v is not null")
    counted = each.groupBy(*keys, "of", "cell", "v").agg(F.count("*").alias("n"))
    group = [*keys, "of"]
    along = Window.partitionBy(*group).orderBy("cell")
    sums = counted.groupBy(*group, "cell").agg(F.sum("n").alias("inside"))
    sums = sums.withColumns({"below": F.sum("inside").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("inside"), "total": F.sum("inside").over(Window.partitionBy(*group))})
    n = F.col("total")
    ranks = {"m0": F.floor((n - 1) / 2), "m1": F.floor(n / 2), "q1": F.floor(n / 4), "q3": F.floor(3 * n / 4) - F.when(n % 4 == 0, 1).otherwise(0)}
    sums = sums.withColumns(ranks)
    within = lambda r, lo, size: (F.col(r) >= lo) & (F.col(r) < lo + size)
    wanted = None
    for r in ranks:
        here = within(r, F.col("below"), F.col("inside"))
        wanted = here if wanted is None else wanted | here
    found = _met(counted, sums.where(wanted), [*group, "cell"])
    inner = Window.partitionBy(*group, "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("from", F.col("below") + F.sum("n").over(inner) - F.col("n"))
    at = found.groupBy(*group).agg(F.max("total").alias("total"), *(F.max(F.when(within(r, F.col("from"), F.col("n")), F.col("v"))).alias(r) for r in ranks))
    told = at.select(*group, ((F.col("m0") + F.col("m1")) / 2).alias("median"), F.when(F.col("total") >= 2, F.col("q3") - F.col("q1")).otherwise(F.lit(0.0)).alias("spread"))
    pick = lambda c, what: F.coalesce(F.max(F.when(F.col("of") == c, F.col(what))), F.lit(0.0)).alias(f"{what}_{c}")
    return told.groupBy(*keys).agg(*(pick(c, what) for c in cells for what in ("median", "spread")))


def percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], cell_width: float) -> DataFrame:
    """Exact percentiles by key, by linear interpolation between ranks; ``shares`` names them (0 to 1). Nulls and NaN don't count.

    Cells of ``cell_width`` are counted first, which merges on the map side; only values in cells that hold a wanted rank are put in
    order, and equal values are one row. So no task holds a key's values.
    """
    v = df.select(*keys, F.col(value).cast("double").alias("v__")).where("v__ is not null and not isnan(v__)").withColumn("cell__", F.floor(F.col("v__") / cell_width))
    counted = v.groupBy(*keys, "cell__", "v__").agg(F.count("*").alias("n__"))
    along = Window.partitionBy(*keys).orderBy("cell__").rowsBetween(Window.unboundedPreceding, 0)
    cells = counted.groupBy(*keys, "cell__").agg(F.sum("n__").alias("inside__"))
    cells = cells.withColumns({"below__": F.sum("inside__").over(along) - F.col("inside__"), "total__": F.sum("inside__").over(Window.partitionBy(*keys))})
    place = {name: (F.col("total__") - 1) * F.lit(float(share)) for name, share in shares.items()}
    low = {name: F.floor(p) for name, p in place.items()}
    high = {name: F.ceil(p) for name, p in place.items()}

    def holds(rank, first, size):
        return (rank >= first) & (rank < first + size)

    wanted = F.lit(False)
    for rank in (*low.values(), *high.values()):
        wanted = wanted | holds(rank, F.col("below__"), F.col("inside__"))
    found = _met(counted, cells.where(wanted), [*keys, "cell__"])
    inner = Window.partitionBy(*keys, "cell__").orderBy("v__").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("from__", F.col("below__") + F.sum("n__").over(inner) - F.col("n__"))
    at = {f"{side}__{name}": F.max(F.when(holds(rank, F.col("from__"), F.col("n__")), F.col("v__"))) for side, ranks in (("low", low), ("high", high)) for name, rank in ranks.items()}
    out = found.groupBy(*keys).agg(F.max("total__").alias("total__"), *(x.alias(n) for n, x in at.items()))
    return out.select(*keys, *((F.col(f"low__{n}") + (F.col(f"high__{n}") - F.col(f"low__{n}")) * (place[n] - low[n])).alias(n) for n in shares))


def shares(emissions: DataFrame, key: str) -> DataFrame:
    """Each emission with the number of its key's emissions and its share of their air time. Totals are joined, so a busy key is no one's window."""
    e = own_emissions(emissions)
    totals = e.groupBy(F.col(key).alias("key__")).agg(F.count("*").alias("n"), F.sum("duration_s").alias("sum__"))
    return e.join(totals, F.col(key).eqNullSafe(F.col("key__"))).withColumn("share", F.col("duration_s") / F.col("sum__")).drop("key__", "sum__")


def profile_stats(members: DataFrame, keys: list[str]) -> DataFrame:
    """Figures of groups of emissions: counts, span, duty, medians and spreads. No task holds a group's values or its history;
    the rows with their gaps are written to the shared folder, as totals and ranks both read them."""
    e = staged(with_gaps(members.select(*keys, "row_id", "timestamp", *(c for c in _CELLS if c != "gap")), keys))
    out = e.groupBy(*keys).agg(
        F.count("*").alias("transmissions"),
        F.sum("duration_s").alias("airtime_s"),
        F.min("timestamp").alias("first_seen"),
        F.max(F.col("timestamp") + F.col("duration_s")).alias("last_seen"),
        F.max("together").alias("proven_multiple"),
    )
    out = _met(out, order_statistics(e, keys), keys, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    span = F.col("last_seen") - F.col("first_seen")
    return out.select(
        *keys,
        "transmissions",
        "airtime_s",
        "first_seen",
        "last_seen",
        zero("median_duration_s").alias("median_duration_s"),
        zero("median_gap").alias("median_gap_s"),
        zero("median_peak_power_dbfs").alias("median_power_dbfs"),
        zero("median_frequency_hz").alias("median_frequency_hz"),
        "proven_multiple",
        F.when(span > 0, F.col("airtime_s") / span).otherwise(F.lit(0.0)).alias("duty_cycle"),
        zero("spread_peak_power_dbfs").alias("power_spread_db"),
        zero("spread_frequency_hz").alias("frequency_spread_hz"),
        (~F.col("proven_multiple")).alias("count_is_lower_bound"),
    )
