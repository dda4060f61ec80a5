"""Who is on air with whom, by slabs of time, without a row for each pair.

Pairs of emissions that are on air together grow with the square of traffic. What attribution asks of them does not: of
each emission, how many weaker and stronger ones of each frequency it meets (two are as good as more), and the strongest.
Spark deals emissions to slabs of time; within one, a kernel answers that by tables over powers of two, for each frequency
in about rows times the logarithm of rows. Few emissions cross from slab to slab; how many they meet is summed up over slabs
and told to each of theirs, which then names the strongest it holds. So counts by frequency travel, no parents.

A task holds the emissions of one slab (``SLAB`` mean durations) and a number for each of them and frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of a slab in mean durations: emissions visit 1 + 1/SLAB slabs more than one on average.
SLAB = 16.0
#: Numbers in a kernel's tables at a time.
CELLS = 1 << 24
Two = tuple[np.ndarray, np.ndarray]

COUNTS = "fs array<double>, weaker array<tinyint>, stronger array<tinyint>"
FOUND = "row_id bigint, kind string, p double, parent_id bigint, parent_hz double"


def _merge(a: Two, b: Two) -> Two:
    """The two highest ranks of two sets, of which each is known by its two highest; -1 is none."""
    low = np.where(a[0] == b[0], -1, np.minimum(a[0], b[0]))
    return np.maximum(a[0], b[0]), np.maximum(np.maximum(a[1], b[1]), low)


class _Group:
    """Intervals between unique whole places; the two highest ranks among those that a question's interval meets."""

    def __init__(self, start: np.ndarray, end: np.ndarray, rank: np.ndarray, odd: np.ndarray):
        self.odd = start[odd], end[odd], rank[odd]  # end before they start: met by what holds both places
        start, end, rank = start[~odd], end[~odd], rank[~odd]
        order = np.argsort(start)
        self.start, self.end, self.rank = start[order], end[order], rank[order].astype(np.int32)
        n = len(start)
        # Runs of neighbours by start.
        depth = max(n, 1).bit_length()
        self.runs = np.full((2, depth, n), -1, np.int32)
        self.runs[0, 0] = self.rank
        for k in range(1, depth):
            half, m = 1 << (k - 1), n - (1 << k) + 1
            self.runs[:, k, :m] = _merge(tuple(self.runs[:, k - 1, :m]), tuple(self.runs[:, k - 1, half : half + m]))
        # Who is on air between one change and the next.
        self.cuts = np.sort(np.concatenate([self.start, self.end]))
        a, b = np.searchsorted(self.cuts, self.start) + 1, np.searchsorted(self.cuts, self.end) + 1
        on = b > a
        a, b, r = a[on], b[on], self.rank[on]
        k = np.frexp(b - a)[1] - 1
        depth, width = int(k.max(initial=0)) + 1, 2 * n + 1
        air = np.full((2, depth, width), -1, np.int32)
        slot, r = np.concatenate([k * width + a, k * width + b - (1 << k)]), np.concatenate([r, r])
        order = np.argsort(r, kind="stable")
        slot, r = slot[order], r[order]
        first, second = air[0].reshape(-1), air[1].reshape(-1)
        first[slot] = r  # the last of equal places stays: the highest
        rest = first[slot] != r
        second[slot[rest]] = r[rest]
        for j in range(depth - 1, 0, -1):
            half = 1 << (j - 1)
            air[:, j - 1] = _merge(tuple(air[:, j - 1]), tuple(air[:, j]))
            air[:, j - 1, half:] = _merge(tuple(air[:, j - 1, half:]), tuple(air[:, j, :-half]))
        self.air = air[:, 0]

    def two(self, start: np.ndarray, end: np.ndarray, odd: np.ndarray, base: int = -1) -> Two:
        """``base``: only pairs of which one starts after that place."""
        lo, hi = np.searchsorted(self.start, np.maximum(start, base), "right"), np.searchsorted(self.start, end)
        size = np.maximum(hi - lo, 0)
        k = np.maximum(np.frexp(size)[1] - 1, 0)
        out = (np.full(len(start), -1, np.int32), np.full(len(start), -1, np.int32))
        some = np.flatnonzero((size > 0) & ~odd)
        if len(some):
            k, lo, hi = k[some], lo[some], hi[some]
            for x, y in zip(out, _merge(tuple(self.runs[:, k, lo]), tuple(self.runs[:, k, hi - (1 << k)])), strict=True):
                x[some] = y
        air = np.where((start > base) & ~odd, self.air[:, np.searchsorted(self.cuts, start)], -1)
        out = _merge(out, tuple(air))
        for s, e, r in zip(*self.odd, strict=True):
            met = (s < end) & (start < e) & (np.maximum(s, start) > base) & ~odd
            out = _merge(out, (np.where(met, r, -1), np.full(len(start), -1)))
        for i in np.flatnonzero(odd):
            met = np.sort(self.rank[(self.start < end[i]) & (start[i] < self.end) & (np.maximum(self.start, start[i]) > base)])[::-1]
            out[0][i], out[1][i] = (*met[:2], -1, -1)[:2]
        return out


class _Slab:
    """Emissions of a slab as places and ranks: a stronger one ranks higher, of equals the one of the smaller number."""

    def __init__(self, rows: pa.Table, margin_db: float):
        columns = rows.select(["row_id", "t0", "t1", "f", "p"]).to_pandas()
        kept = np.flatnonzero(~columns.duplicated().to_numpy())  # a row that was told twice is one emission
        self.kept = kept[np.argsort(columns["t0"].to_numpy()[kept], kind="stable")]  # questions in order of time are found faster
        self.id, self.t0, self.t1, self.f, self.p = (columns[c].to_numpy()[self.kept] for c in columns)
        n, self.margin = len(self.id), margin_db
        # Half-open: at equal times, ends come before starts, and instants start before what they would else be part of.
        when = np.concatenate([self.t1, self.t0])
        order = np.lexsort((np.concatenate([np.zeros(n), np.where(self.t1 > self.t0, 2, 1)]), when))
        place = np.empty(2 * n, np.int64)
        place[order] = np.arange(2 * n)
        self.end, self.start, self.when = place[:n], place[n:], when[order]
        self.odd = self.t1 < self.t0
        self.by_rank = np.lexsort((-self.id, self.p))
        self.rank = np.empty(n, np.int64)
        self.rank[self.by_rank] = np.arange(n)

    def group(self, rows: np.ndarray, weak: bool = False) -> _Group:
        rank = len(self.id) - 1 - self.rank[rows] if weak else self.rank[rows]
        return _Group(self.start[rows], self.end[rows], rank, self.odd[rows])

    def around(self, asked: np.ndarray, f: np.ndarray, base: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each row asked for and each frequency: weaker and stronger ones met (0, 1, or 2 for more), and the strongest or -1."""
        shape, n = (len(asked), len(f)), len(self.id)
        weaker, stronger, best = np.zeros(shape, np.int8), np.zeros(shape, np.int8), np.full(shape, -1, np.int32)
        q = self.start[asked], self.end[asked], self.odd[asked], base
        p, by_power = self.p[asked], self.p[self.by_rank]
        at = np.searchsorted(f, self.f)
        order = np.argsort(at, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            j = at[rows[0]]
            for r in self.group(rows, weak=True).two(*q):
                weaker[:, j] += (r >= 0) & (p - by_power[n - 1 - np.maximum(r, 0)] >= self.margin)
            found = self.group(rows).two(*q)
            for r in found:
                stronger[:, j] += (r >= 0) & (by_power[r] - p >= self.margin)
            best[:, j] = np.where(stronger[:, j] > 0, found[0], -1)
        return weaker, stronger, best


def _band(f: np.ndarray, x: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """First and last place (exclusive) of the sorted ``f`` within the tolerance of each ``x``, by the difference itself."""
    near = lambda i: (i >= 0) & (i < len(f)) & (np.abs(f[np.clip(i, 0, len(f) - 1)] - x) <= tolerance)
    lo, hi = np.searchsorted(f, x - tolerance), np.searchsorted(f, x + tolerance, "right")
    lo = np.where(near(lo - 1), lo - 1, np.where(near(lo), lo, lo + 1))  # the bounds above are rounded
    hi = np.where(near(hi), hi + 1, np.where(near(hi - 1), hi, hi - 1))
    lo = np.minimum(lo, len(f))
    return lo, np.maximum(hi, lo)


def _chunks(rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    step = max(1, CELLS // max(width, 1))
    for i in range(0, len(rows), step):
        yield rows[i : i + step]


def _summed(counts: np.ndarray) -> np.ndarray:
    return np.pad(np.cumsum(counts, axis=1, dtype=np.int32), ((0, 0), (1, 0)))


def _lists(counts: np.ndarray, f: np.ndarray, weaker: np.ndarray, stronger: np.ndarray) -> list[pa.Array]:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((f, pa.float64()), (weaker, pa.int8()), (stronger, pa.int8()))]


def crossing(width: float, margin_db: float):
    """Kernel: how many of each frequency emissions that cross slabs meet in this one, each pair in the slab in which the later one starts."""

    def kernel(rows: pa.Table) -> pa.Table:
        s = _Slab(rows, margin_db)
        asked = np.flatnonzero(rows["crosses"].to_numpy()[s.kept])
        slab = rows["slab"][0].as_py()
        out: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int8), np.zeros(0, np.int8))]
        f = np.unique(s.f)
        base = int(np.searchsorted(s.when, slab * width)) - 1
        for some in _chunks(asked, len(f)):
            weaker, stronger, _ = s.around(some, f, base)
            i, j = np.nonzero((weaker > 0) | (stronger > 0))
            out.append((np.bincount(i, minlength=len(some)), f[j], weaker[i, j], stronger[i, j]))
        lists = _lists(*(np.concatenate(x) for x in zip(*out, strict=True)))
        return pa.table([pa.array(s.id[asked], pa.int64()), pa.array(np.full(len(asked), slab), pa.int64()), *lists], names=["row_id", "slab", "fs", "weaker", "stronger"])

    return kernel


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each row and frequency over all its slabs, 2 for more."""
    for batch in batches:
        n, (fs, weaker, stronger) = batch.num_rows, (batch.column(c) for c in ("fs", "weaker", "stronger"))
        whose = np.repeat(np.arange(n), np.diff(fs.offsets.to_numpy()))
        f, weaker, stronger = (x.flatten().to_numpy(zero_copy_only=False) for x in (fs, weaker, stronger))
        order = np.lexsort((f, whose))
        whose, f = whose[order], f[order]
        first = np.flatnonzero(np.concatenate([[True], (np.diff(whose) > 0) | (np.diff(f) > 0)])[: len(f)])
        of = lambda x: np.minimum(np.add.reduceat(x[order].astype(np.int64), first), 2) if len(first) else x  # noqa: B023, E731
        lists = _lists(np.bincount(whose[first], minlength=n), f[first], of(weaker), of(stronger))
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("slabs"), *lists], names=["row_id", "slabs", "fs", "weaker", "stronger"])


def _told(known: pa.Table, ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """What is known of the ``rows`` with these ids: whose it is, frequency, weaker and stronger ones met."""
    by_id = known["row_id"].to_numpy()
    order = np.argsort(by_id, kind="stable")
    place = np.searchsorted(by_id[order], ids)
    lists = [pa.concat_arrays(known[c].chunks) if known[c].num_chunks else pa.array([], known.schema.field(c).type) for c in ("fs", "weaker", "stronger")]
    counts = np.diff(lists[0].offsets.to_numpy())
    begin, own = (np.cumsum(counts) - counts)[order][place], counts[order][place]
    at = np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(own.sum())
    return np.repeat(rows, own), *(x.flatten().to_numpy(zero_copy_only=False)[at] for x in lists)


def relations(tolerance: float, margin_db: float, kinds: tuple[str, ...]):
    """Kernel: the strongest parent of each emission in this slab; of those that cross, what they meet in all is ``known``."""

    def kernel(rows: pa.Table, known: pa.Table) -> pa.Table:
        s = _Slab(rows, margin_db)
        n = len(s.id)
        crosses = rows["crosses"].to_numpy()[s.kept]
        across = np.flatnonzero(crosses)
        whose, told_f, told_weaker, told_stronger = _told(known, s.id[across], across)
        f = np.unique(np.concatenate([s.f, told_f]))
        d, at, known_at = len(f), np.searchsorted(f, s.f), np.searchsorted(f, told_f)
        x = 2 * f[:, None] - f[None, :]  # [parent, weak]
        lo, hi = _band(f, x, tolerance)
        weaker = np.zeros((n, d), np.int8)
        out: list[tuple] = []

        def tell(kind: str, weak: np.ndarray, p: np.ndarray, parent: np.ndarray, hz: np.ndarray) -> None:
            out.append((s.id[weak], np.full(len(weak), kind), p, parent, hz))

        def intermodulation(weak: np.ndarray, stronger: np.ndarray, best: np.ndarray) -> None:
            total = _summed(stronger)
            row, w = np.arange(len(weak))[:, None], at[weak][:, None]
            every = np.arange(d)[None, :]
            own = np.abs(x[every, w] - f[every]) <= tolerance  # the parent itself lies where the other one is sought
            good = (best >= 0) & (total[row, hi[every, w]] - total[row, lo[every, w]] > own)
            b = s.by_rank[best]
            p, parent = np.where(good, s.p[b], -np.inf), s.id[b]
            top = p.max(axis=1, initial=-np.inf)
            first = np.where(good & (p == top[:, None]), parent, np.iinfo(np.int64).max)
            j = first.argmin(axis=1)
            some = np.flatnonzero(good.any(axis=1))
            tell("INTERMOD3", weak[some], top[some], first[some, j[some]], f[j[some]])

        # Emissions of this slab alone meet all they meet here; of the others, the strongest of every slab are compared later.
        for some in _chunks(np.arange(n), d):
            met, stronger, best = s.around(some, f)
            mine = slice(*np.searchsorted(whose, [some[0], some[-1] + 1]))
            i, j = whose[mine] - some[0], known_at[mine]
            for table, told in ((met, told_weaker), (stronger, told_stronger)):
                table[crosses[some]] = 0
                np.add.at(table, (i, j), told[mine])
            weaker[some] = met
            if "INTERMOD3" in kinds:
                intermodulation(some, stronger, best)
        if "SPLATTER" in kinds:
            fit = np.zeros((n, d), bool)  # [parent, frequency of a weak one]
            own = np.abs(f[None, :] - x) <= tolerance  # the weak one itself lies where its partner is sought
            for some in _chunks(np.arange(n), d):
                total = _summed(weaker[some])
                row = np.arange(len(some))[:, None]
                fit[some] = total[row, hi[at[some]]] - total[row, lo[at[some]]] > own[at[some]]
            for j in range(d):
                weak, parents = np.flatnonzero(at == j), np.flatnonzero(fit[:, j])
                if len(weak) and len(parents):
                    r, _ = s.group(parents).two(s.start[weak], s.end[weak], s.odd[weak])
                    b = s.by_rank[r]
                    good = np.flatnonzero((r >= 0) & (s.p[b] - s.p[weak] >= margin_db))
                    b = b[good]
                    tell("SPLATTER", weak[good], s.p[b], s.id[b], s.f[b])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 5
        types = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c.tolist() if t == pa.string() else c, t, safe=False) for c, t in zip(columns, types, strict=True)], names=["row_id", "kind", "p", "parent_id", "parent_hz"])

    return kernel


def related(emissions: DataFrame, tolerance_hz: float, margin_db: float, kinds: tuple[str, ...] = ("SPLATTER", "INTERMOD3")) -> DataFrame:
    """(row_id, kind, p, parent_id, parent_hz): the strongest parents by each relation, one for each slab of an emission.

    Emissions without a number, time, frequency or power take no part.
    """
    spark = emissions.sparkSession
    e = emissions.select("row_id", F.col("timestamp").alias("t0"), (F.col("timestamp") + F.col("duration_s")).alias("t1"), F.col("frequency_hz").alias("f"), F.col("peak_power_dbfs").alias("p")).dropna()
    mean = e.agg(F.avg(F.abs(F.col("t1") - F.col("t0")))).first()[0]
    width = SLAB * (mean or 1.0)
    first, last = (F.floor(c / width) for c in (F.least("t0", "t1"), F.greatest("t0", "t1")))
    dealt = e.withColumn("crosses", first != last).withColumn("slab", F.explode(F.sequence(first, last)))
    tasks = 4 * spark.sparkContext.defaultParallelism  # narrow rows with long work: by size alone they would be one task
    slabs = dealt.repartition(tasks, "slab").groupBy("slab")  # read twice, dealt once
    met = slabs.applyInArrow(crossing(width, margin_db), f"row_id bigint, slab bigint, {COUNTS}")
    lists = ["fs", "weaker", "stronger"]
    met = met.groupBy("row_id").agg(F.collect_list(F.struct("slab", *lists)).alias("c"))
    met = met.select("row_id", F.array_distinct("c.slab").alias("slabs"), *(F.flatten(F.col(f"c.{c}")).alias(c) for c in lists))
    met = met.mapInArrow(_summed_up, f"row_id bigint, slabs array<bigint>, {COUNTS}").select(F.explode("slabs").alias("slab"), "row_id", *lists)
    return slabs.cogroup(met.repartition(tasks, "slab").groupBy("slab")).applyInArrow(relations(tolerance_hz, margin_db, kinds), FOUND)


def strongest_parents(emissions: DataFrame, tolerance_hz: float, margin_db: float, kinds: tuple[str, ...] = ("SPLATTER", "INTERMOD3")) -> DataFrame:
    """(row_id, kind, parent_id, parent_hz): the strongest parent by each relation, of equals the one of the smaller number."""
    best = F.min(F.struct((-F.col("p")).alias("o"), F.col("parent_id").alias("id"), F.col("parent_hz").alias("f")))
    found = related(emissions, tolerance_hz, margin_db, kinds)
    return found.groupBy("row_id", "kind").agg(best.alias("b")).select("row_id", "kind", F.col("b.id").alias("parent_id"), F.col("b.f").alias("parent_hz"))
