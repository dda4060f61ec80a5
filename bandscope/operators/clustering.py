"""Grouping of emissions into emitters: greedy in time order, with a moving centre.

The rule depends on order: an emission joins the first group, by age, whose
running median frequency is within tolerance and whose tone matches. It can be
split exactly. Groups never mix tones, and tones that differ by more than the tolerance
from all tones between them can never meet; neither can frequencies across a
gap wider than the tolerance, as a median lies within its members. So tones
and then frequencies are cut into islands, and each island is folded on its own.

An island's rows are sorted by Spark and pass by the fold one after the other; the task holds
none of them. What it keeps is a running median for each group: the values while
they are few, then counts of values by cell (``RunningMedian``), which the band plan bounds and
traffic doesn't. A median that is known to a cell decides nearly every emission. Where the decision
hangs on where in its cell the median is, that cell is split and the island is folded again from the
stored rows, until nothing hangs: every pass is right up to the first such emission, so the passes end,
and the result is that of exact medians. The fold of one island remains sequential; ``partition`` (a capture, a
day) splits it further where groups may not span its values.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from .joins import band_join
from .staging import staged

NO_TONE = -1.0
#: Values of a group that are kept as they are; from then on they are counted by cell.
FEW = 1_024
#: Width in Hz of a cell, a power of two, and how many parts a cell is split into (so many powers of two).
CELL_HZ, SPLIT_BITS = 1.0, 12


def cut_at_gaps(df: DataFrame, keys: list[str], value: str, gap: float, name: str) -> DataFrame:
    """Number the runs of ``value`` (within ``keys``) that no gap wider than ``gap`` cuts.

    Values are first put into cells as wide as the gap, which no run's end can lie inside; only the least and greatest value of each
    cell are compared with those of the next, so what is sorted is as small as the band, whatever the number of values.
    """
    cell = F.floor(F.col(value) / gap)
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, cell.alias("cell__")).agg(F.min(value).alias("low__"), F.max(value).alias("high__"))
    w = Window.partitionBy(*keys).orderBy("cell__")
    jump = F.when(F.coalesce(F.col("low__") - F.lag("high__").over(w) > gap, F.lit(True)), 1).otherwise(0)
    numbered = cells.withColumn("jump__", jump).withColumn(name, F.sum("jump__").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    on = [F.col(k).eqNullSafe(F.col(f"{k}__of")) for k in keys] + [cell == F.col("cell__")]
    found = numbered.select(*(F.col(k).alias(f"{k}__of") for k in keys), "cell__", name)
    return df.join(found, on).drop("cell__", *(f"{k}__of" for k in keys))


def islands(emissions: DataFrame, partition: list[str], tolerance_hz: float, tone_tolerance: float) -> DataFrame:
    """Add ``tone_island`` and ``island``; emissions without a frequency belong to none and go."""
    e = emissions.withColumn("tone__", F.coalesce("ctcss_tone_hz", F.lit(NO_TONE))).withColumn("silent__", F.col("ctcss_tone_hz").isNull())
    e = cut_at_gaps(e, [*partition, "silent__"], "tone__", tone_tolerance, "tone_island")
    return cut_at_gaps(e, [*partition, "silent__", "tone_island"], "frequency_hz", tolerance_hz, "island")


def _median(ordered: list[float]) -> float:
    n = len(ordered)
    return ordered[n // 2] if n % 2 else (ordered[n // 2 - 1] + ordered[n // 2]) / 2


def fold(rows: list[tuple], tolerance_hz: float, tone_tolerance: float) -> list[tuple]:
    """(row, group founder) for rows (row_id, timestamp, frequency, tone) in order; a group's frequencies are kept sorted."""
    groups: list[list] = []  # founder, tone, sorted frequencies, median
    out = []
    for row, _, f, tone in rows:
        for g in groups:
            same = (tone is None and g[1] is None) or (tone is not None and g[1] is not None and abs(tone - g[1]) <= tone_tolerance)
            if same and abs(f - g[3]) <= tolerance_hz:
                bisect.insort(g[2], f)
                g[3] = _median(g[2])
                break
        else:
            g = [row, tone, [f], f]
            groups.append(g)
        out.append((row, g[0]))
    return out


class RunningMedian:
    """The median of values that arrive one by one, as bounds that are equal where it is known exactly.

    Up to ``few`` values are kept. Then there are only counts: of cells of ``cell`` Hz, of the parts of cells in ``split``, of parts of
    those, down to single numbers. ``split`` holds (level, lower edge) of cells to be split.
    """

    def __init__(self, split: set[tuple[int, float]], few: int, cell: float):
        self.split, self.few, self.cell = split, few, cell
        self.values: list[float] = []
        self.counts: dict[float, int] = {}  # by the cell's lower edge
        self.level: dict[float, int] = {}
        self.edges: list[float] = []
        self.n = 0
        self.at = self.below = 0  # the cell of the lower middle value, as a place in ``edges``, and how many values lie below it
        self.low = self.high = 0.0

    def place(self, v: float) -> tuple[int, float]:
        """The cell of a value: its level and lower edge. Scales are powers of two, so nothing is rounded."""
        level, scale = 0, 1 / self.cell
        while (found := (level, math.floor(v * scale) / scale)) in self.split:
            level, scale = level + 1, scale * (1 << SPLIT_BITS)
        return found

    def count(self, v: float) -> None:
        level, edge = self.place(v)
        if edge in self.counts:
            self.counts[edge] += 1
        else:
            i = bisect.bisect_left(self.edges, edge)
            self.edges.insert(i, edge)
            self.counts[edge], self.level[edge] = 1, level
            self.at += i <= self.at and self.n > 0
        self.n += 1
        if self.n > 1 and edge < self.edges[self.at]:
            self.below += 1
        rank = (self.n - 1) // 2
        while rank < self.below:
            self.at -= 1
            self.below -= self.counts[self.edges[self.at]]
        while rank >= self.below + self.counts[self.edges[self.at]]:
            self.below += self.counts[self.edges[self.at]]
            self.at += 1

    def middle(self) -> list[float]:
        """Edges of the cells of the two middle values."""
        first = self.edges[self.at]
        return [first, first if self.n // 2 < self.below + self.counts[first] else self.edges[self.at + 1]]

    def greatest(self, edge: float) -> float:
        """The greatest number in a cell."""
        return max(edge, math.nextafter(edge + self.cell / (1 << SPLIT_BITS * self.level[edge]), -math.inf))

    def add(self, v: float) -> None:
        if not self.counts:
            bisect.insort(self.values, v)
            self.low = self.high = _median(self.values)
            if len(self.values) > self.few:
                for x in self.values:
                    self.count(x)
                self.values.clear()
            return
        self.count(v)
        a, b = self.middle()
        if self.n % 2:
            self.low, self.high = a, self.greatest(a)
        else:
            self.low, self.high = (a + b) / 2, (self.greatest(a) + self.greatest(b)) / 2

    def unknown(self) -> list[tuple[int, float]]:
        """The cells that must be split to know the median better."""
        return [(self.level[e], e) for e in dict.fromkeys(self.middle()) if self.greatest(e) > e] if self.counts else []


class Fold:
    """The groups of one island, in the order of their founding."""

    def __init__(self, tolerance_hz: float, tone_tolerance: float, few: int = FEW, cell: float = CELL_HZ):
        self.tolerance, self.tone_tolerance, self.few, self.cell = tolerance_hz, tone_tolerance, few, cell
        self.split: dict[object, set[tuple[int, float]]] = {}  # by founder
        self.groups: list[tuple[object, float | None, RunningMedian]] = []

    def take(self, row, f: float, tone: float | None) -> tuple[object, list[tuple[object, int, float]]]:
        """The founder of the emission's group, and the cells (founder, level, edge) on which the decision hung."""
        hung: list[tuple[object, int, float]] = []
        for founder, own, median in self.groups:
            same = (tone is None and own is None) or (tone is not None and own is not None and abs(tone - own) <= self.tone_tolerance)
            if not same:
                continue
            inside, also = abs(f - median.low) <= self.tolerance, abs(f - median.high) <= self.tolerance
            # Outside either bound may still be inside between them if they lie on both sides of the emission.
            if inside != also or (not inside and median.low < f < median.high):
                hung += [(founder, *c) for c in median.unknown()]
                inside = abs(f - (median.low + median.high) / 2) <= self.tolerance
            if inside:
                median.add(f)
                return founder, hung
        median = RunningMedian(self.split.get(row, set()), self.few, self.cell)
        median.add(f)
        self.groups.append((row, tone, median))
        return row, hung


def _folded(rows: DataFrame, splits: DataFrame | None, tolerance_hz: float, tone_tolerance: float, few: int, cell: float) -> DataFrame:
    """(island__, row_id, profile_id, level, edge) for each emission, and again with a cell for each cell that a decision hung on.

    Cells to split come before the emissions of their island in its stream of rows.
    """
    kind = rows.schema["row_id"].dataType
    every = rows.select("island__", F.lit(1).alias("after"), "timestamp", "row_id", "frequency_hz", "ctcss_tone_hz", F.lit(None).cast("int").alias("level"))
    if splits is not None:
        first = splits.select("island__", F.lit(0).alias("after"), F.lit(None).cast("double").alias("timestamp"), F.col("profile_id").alias("row_id"), F.col("edge").alias("frequency_hz"), F.lit(None).cast("double").alias("ctcss_tone_hz"), "level")
        every = every.unionByName(first)
    dealt = every.repartition("island__").sortWithinPartitions("island__", "after", F.asc_nulls_last("timestamp"), "row_id")
    schema = T.StructType([T.StructField("island__", T.StringType()), T.StructField("row_id", kind), T.StructField("profile_id", kind), T.StructField("level", T.IntegerType()), T.StructField("edge", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        island, fold = None, None
        for batch in batches:
            out: list[tuple] = []
            for name, after, row, f, tone, level in zip(*(batch.column(c).to_pylist() for c in ("island__", "after", "row_id", "frequency_hz", "ctcss_tone_hz", "level")), strict=True):
                if name != island:
                    island, fold = name, Fold(tolerance_hz, tone_tolerance, few, cell)
                if not after:
                    fold.split.setdefault(row, set()).add((level, f))
                    continue
                profile, hung = fold.take(row, f, tone)
                out.append((name, row, profile, None, None))
                out += [(name, None, *c) for c in hung]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), batch.schema.field("row_id").type, batch.schema.field("row_id").type, pa.int32(), pa.float64()), strict=True)], names=schema.names)

    return dealt.mapInArrow(run, schema)


def cluster(
    emissions: DataFrame, partition: list[str] | None = None, tolerance_hz: float = S.EMITTER_TOLERANCE_HZ, tone_tolerance: float = S.TONE_TOLERANCE_HZ, few: int = FEW, cell: float = CELL_HZ
) -> DataFrame:
    """The emissions (by-products left out) with ``profile_id``, the row id of the group's first member.

    ``row_id`` must be unique and not null. The cut rows and each pass are written to the shared folder.
    """
    partition = partition or []
    own = emissions.where(F.col("attribution").isNull()) if "attribution" in emissions.columns else emissions
    name = F.to_json(F.struct(*partition, "silent__", "tone_island", "island"))
    rows = staged(islands(own, partition, tolerance_hz, tone_tolerance).select(name.alias("island__"), "timestamp", "row_id", F.col("frequency_hz").cast("double").alias("frequency_hz"), F.col("ctcss_tone_hz").cast("double").alias("ctcss_tone_hz")))
    found = staged(_folded(rows, None, tolerance_hz, tone_tolerance, few, cell))
    splits: DataFrame | None = None
    while not (more := found.where("edge is not null")).isEmpty():
        more = more.select("island__", "profile_id", "level", "edge").distinct()
        splits = staged(more if splits is None else splits.unionByName(more).distinct())
        again = staged(more.select("island__").distinct())
        whole = rows.join(again, "island__", "left_semi")
        told = _folded(whole, splits.join(again, "island__", "left_semi"), tolerance_hz, tone_tolerance, few, cell)
        found = staged(found.join(again, "island__", "left_anti").unionByName(told))
    return own.join(found.select("row_id", "profile_id"), "row_id")


def attach_products(products: DataFrame, profiles: DataFrame, tolerance_hz: float = S.EMITTER_TOLERANCE_HZ) -> DataFrame:
    """Each by-product with the nearest profile to the frequency it was attributed to; ties go to the older profile."""
    p = profiles.select(F.col("profile_id"), F.col("median_frequency_hz").alias("profile_hz"), F.col("first_seen").alias("founded"))
    near = band_join(products.where(F.col("attributed_to_hz").isNotNull()).select("row_id", "attributed_to_hz"), p, "attributed_to_hz", "profile_hz", tolerance_hz)
    best = F.min(F.struct(F.abs(F.col("profile_hz") - F.col("attributed_to_hz")).alias("d"), F.col("founded"), F.col("profile_id")))
    return near.groupBy("row_id").agg(best.alias("b")).select("row_id", F.col("b.profile_id").alias("profile_id"), F.col("b.d").alias("distance_hz"))


def bin_groups(emissions: DataFrame, bins: int, keys: list[str]) -> DataFrame:
    """Merge emissions of one transmitter that fell in adjacent bins: greedy by start, then bin; joins the first group that touches.

    Adds ``group_id``, the place of the group in its key. Rows are sorted by Spark and pass by one after the other: what ended before an
    emission starts can't touch it or any later one, so a task holds only what is on air, which the number of bins bounds.
    """
    schema = T.StructType([*emissions.schema.fields, T.StructField("group_id", T.LongType())])
    dealt = emissions.repartition(*keys).sortWithinPartitions(*keys, "start_frame", "bin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count, live = None, 0, {}
        for batch in batches:
            numbers = []
            of = lambda c: batch.column(c).to_pylist()  # noqa: B023, E731
            for now, b, start, end in zip(zip(*map(of, keys), strict=True), of("bin"), of("start_frame"), of("end_frame"), strict=True):
                if now != key:
                    key, count, live = now, 0, {}
                beside = {(b - 1) % bins, (b + 1) % bins} - {b}
                for x in beside & live.keys():
                    live[x] = [(g, stop) for g, stop in live[x] if stop >= start]
                group = min((g for x in beside for g, _ in live.get(x, ())), default=count)
                count += group == count
                live.setdefault(b, []).append((group, end))
                if len(live[b]) > 1:
                    live[b] = [(g, stop) for g, stop in live[b] if stop >= start]
                numbers.append(group)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], names=schema.names)

    return dealt.mapInArrow(run, schema)


def group_summary(grouped: DataFrame, bins: int, keys: list[str]) -> DataFrame:
    """One row for each group of bins: the strongest bin, extent, and the power-weighted centre in bins about it."""
    strongest = F.max_by("bin", F.struct("mean_power", -F.col("bin"))).over(Window.partitionBy(*keys, "group_id"))
    g = grouped.withColumn("lead", strongest)
    offset = F.pmod(F.col("bin") - F.col("lead") + bins // 2, F.lit(bins)) - bins // 2
    total = F.sum("mean_power")
    return g.groupBy(*keys, "group_id", "lead").agg(
        F.min("start_frame").alias("start_frame"),
        F.max("end_frame").alias("end_frame"),
        F.max("peak_power").alias("peak_power"),
        F.count("*").alias("bins"),
        F.when(total > 0, F.sum(F.col("mean_power") * offset) / total).otherwise(F.lit(0.0)).alias("offset_bins"),
    )


__all__ = ["attach_products", "bin_groups", "cluster", "cut_at_gaps", "fold", "group_summary", "islands"]
