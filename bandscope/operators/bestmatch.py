"""Each report's best transmission, by slabs of time and cells of frequency, without a row for each pair.

Reports and transmissions that meet grow with the square of traffic. What scoring asks of them does not: of each report, how
many transmissions it meets, and the one of the greatest overlap. Spark deals both sides to slabs of time and cells of
frequency; a pair belongs to the slab in which the later of the two starts. Within one slab and cell a kernel asks, for all
reports that can hear the same transmissions at once, for the best of those that start within a range and end on one side of
a place: about rows times the square of the logarithm of rows. Only where reports differ in what they can hear, down to each
having a set of its own, does it try pairs one by one, in bounded memory.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .onair import CELLS, SLAB, _band, _chunks

BEST = "report_id bigint, n bigint, overlap_s double, truth_id bigint"
#: Fewer reports than this try their pairs one by one.
FEW = 8
_NONE = np.iinfo(np.int64).max


class _Best:
    """What a table of reports has found so far: number of transmissions met, greatest overlap, smallest number of those that have it."""

    def __init__(self, n: int):
        self.met, self.overlap, self.id = np.zeros(n, np.int64), np.full(n, -np.inf), np.full(n, _NONE)

    def tell(self, rows: np.ndarray, overlap: np.ndarray, ids: np.ndarray) -> None:
        """Each row once."""
        better = (overlap > self.overlap[rows]) | ((overlap == self.overlap[rows]) & (ids < self.id[rows]))
        rows = rows[better]
        self.overlap[rows], self.id[rows] = overlap[better], ids[better]


def _ask(ranks: np.ndarray, asks: list[tuple[np.ndarray, np.ndarray, np.ndarray, bool, np.ndarray]]) -> list[np.ndarray]:
    """Of each (first place, last place exclusive, bound, below, value by rank): the greatest value in the range among ranks under the bound, or from it on; -1 is none.

    ``ranks`` is a permutation whose length is a power of two; blocks of powers of two are sorted level by level, and a range is a few of them.
    """
    n = len(ranks)
    at = [(lo.astype(np.int64), hi.astype(np.int64)) for lo, hi, *_ in asks]
    out = [np.full(len(lo), -1, np.int64) for lo, _ in at]
    block, k = ranks.astype(np.int64), 0
    while 1 << k <= n and any((lo < hi).any() for lo, hi in at):
        block = np.sort(block.reshape(-1, 1 << k), axis=1)
        flat = (block + n * np.arange(len(block))[:, None]).ravel()
        for (lo, hi), found, (_, _, bound, below, value) in zip(at, out, asks, strict=True):
            v = value[block]
            v = (np.maximum.accumulate(v, axis=1) if below else np.maximum.accumulate(v[:, ::-1], axis=1)[:, ::-1]).ravel()
            for left in (True, False):
                some = np.flatnonzero((lo < hi) & ((lo if left else hi) & 1 == 1))
                if left:
                    b = lo[some]
                    lo[some] += 1
                else:
                    hi[some] -= 1
                    b = hi[some]
                p = np.searchsorted(flat, b * n + bound[some]) - below
                good = (p >= b << k) & (p < (b + 1) << k)
                some, p = some[good], p[good]
                found[some] = np.maximum(found[some], v[p])
            lo >>= 1
            hi >>= 1
        k += 1
    return out


def _by_ranges(best: _Best, rows: np.ndarray, r0: np.ndarray, r1: np.ndarray, s0: np.ndarray, s1: np.ndarray, ids: np.ndarray) -> None:
    """All reports ``rows`` against all transmissions, none of which ends before it starts."""
    order = np.lexsort((ids, s0))
    s0, s1, ids = s0[order], s1[order], ids[order]
    n = len(ids)
    size = 1 << (n - 1).bit_length()
    by_end = np.argsort(s1, kind="stable")
    ends = s1[by_end]
    ranks = np.arange(size)  # the rest holds no transmission
    ranks[by_end] = np.arange(n)

    def valued(order: np.ndarray) -> np.ndarray:
        """By rank of the end: the place in an order of rising worth."""
        worth = np.empty(n, np.int64)
        worth[order] = np.arange(n)
        return np.concatenate([worth[by_end], np.full(size - n, -1)])

    before = np.searchsorted(s0, r1)  # transmissions that start before the report ends
    instants = np.sort(s0[s0 == s1])
    at_once = np.searchsorted(instants, r0, "right") - np.searchsorted(instants, r0)
    over = np.searchsorted(ends, r0, "right")  # transmissions that end before the report starts
    best.met[rows] += before - over + np.where(r0 == r1, at_once, 0)

    # On air when the report starts: what lasts longest, at most to the report's end; of all that last as long, the smallest number.
    on = np.minimum(np.searchsorted(s0, r0, "right"), before)
    latest = np.maximum.accumulate(s1)[np.maximum(on - 1, 0)]
    on = np.where(latest > r0, on, 0)
    overlap_on = np.minimum(latest, r1) - r0
    bound = np.maximum(np.searchsorted(ends, np.minimum(latest, r1)), over)
    while True:  # ends so near that the difference is rounded to the same
        last = ends[np.maximum(bound - 1, 0)]
        same = (on > 0) & (bound > 0) & (last > r0) & (last - r0 >= overlap_on)
        if not same.any():
            break
        bound = np.where(same, np.searchsorted(ends, last), bound)
    # Started later: the longest that ends in time, and of the others the first.
    first, end = np.searchsorted(s0, r0, "right"), np.searchsorted(ends, r1, "right")
    by_id, by_length, by_start = np.lexsort((-np.arange(n), -ids)), np.lexsort((-ids, s1 - s0)), np.arange(n)[::-1]
    low = np.zeros(len(rows), np.int64)
    a, b, c = _ask(ranks, [(low, on, bound, False, valued(by_id)), (first, before, end, True, valued(by_length)), (first, before, end, False, valued(by_start))])
    some = np.flatnonzero(a >= 0)
    best.tell(rows[some], overlap_on[some], ids[by_id[a[some]]])
    some = np.flatnonzero(b >= 0)
    place = by_length[b[some]]
    best.tell(rows[some], s1[place] - s0[place], ids[place])
    some = np.flatnonzero(c >= 0)
    place = by_start[c[some]]
    overlap = r1[some] - s0[place]
    best.tell(rows[some], overlap, ids[place])
    # Starts so near that the difference is rounded to the same.
    stop = np.searchsorted(s0, s0[place], "right")
    while True:
        same = (stop < before[some]) & (r1[some] - s0[np.minimum(stop, n - 1)] >= overlap)
        if not same.any():
            break
        stop = np.where(same, np.searchsorted(s0, s0[np.minimum(stop, n - 1)], "right"), stop)
    more = np.flatnonzero(stop > np.searchsorted(s0, s0[place], "right"))
    if len(more):
        d = _ask(ranks, [(place[more], stop[more], end[some[more]], False, valued(by_id))])[0]
        best.tell(rows[some[more]], overlap[more], ids[by_id[d]])


def best_in_slab(width: float, tolerance: float):
    """Kernel: of each report in a slab and cell, how many transmissions it meets in it, the greatest overlap and whose it is."""

    def kernel(table: pa.Table) -> pa.Table:
        slab, is_report = table["slab"][0].as_py(), table["report"].to_numpy()
        if is_report.all() or not is_report.any():
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.int64())], names=["report_id", "n", "overlap_s", "truth_id"])
        columns = [table[c].to_numpy() for c in ("id", "t0", "t1", "f")]
        report_id, r0, r1, rf = (c[is_report] for c in columns)
        ids, s0, s1, tf = (c[~is_report] for c in columns)
        order = np.argsort(tf, kind="stable")
        ids, s0, s1, tf = ids[order], s0[order], s1[order], tf[order]
        r_here, s_here = np.floor(r0 / width) == slab, np.floor(s0 / width) == slab
        r_odd, s_odd = r1 < r0, s1 < s0  # end before they start: met by what holds both places
        best = _Best(len(report_id))
        lo, hi = _band(tf, rf, tolerance)

        def one_by_one(rows: np.ndarray, others: np.ndarray) -> None:
            for some in _chunks(rows, 8 * len(others)):
                x0, x1, a, b = r0[some][:, None], r1[some][:, None], s0[others], s1[others]
                start = np.maximum(x0, a)
                met = (x0 < b) & (a < x1) & (np.abs(rf[some][:, None] - tf[others]) <= tolerance) & (np.floor(start / width) == slab)
                overlap = np.where(met, np.minimum(x1, b) - start, -np.inf)
                top = overlap.max(axis=1, initial=-np.inf)
                found = met.any(axis=1)
                best.met[some] += met.sum(axis=1)
                first = np.where(met & (overlap == top[:, None]), ids[others], _NONE).min(axis=1, initial=_NONE)
                best.tell(some[found], top[found], first[found])

        odd = np.flatnonzero(s_odd)
        if len(odd):
            one_by_one(np.arange(len(report_id)), odd)
        if r_odd.any():
            one_by_one(np.flatnonzero(r_odd), np.flatnonzero(~s_odd))
        # A report that started in an earlier slab meets here what starts here.
        for rows, good in ((r_here & ~r_odd, ~s_odd), (~r_here & ~r_odd, ~s_odd & s_here)):
            rows = np.flatnonzero(rows & (hi > lo))
            rows = rows[np.lexsort((hi[rows], lo[rows]))]
            new = np.flatnonzero((np.diff(lo[rows]) != 0) | (np.diff(hi[rows]) != 0)) + 1
            for same in np.split(rows, new) if len(rows) else ():
                heard = slice(lo[same[0]], hi[same[0]])
                others = heard.start + np.flatnonzero(good[heard])
                if not len(others):
                    continue
                if len(same) < FEW:
                    one_by_one(same, others)
                else:
                    _by_ranges(best, same, r0[same], r1[same], s0[others], s1[others], ids[others])
        some = np.flatnonzero(best.met > 0)
        return pa.table([pa.array(report_id[some], pa.int64()), pa.array(best.met[some]), pa.array(best.overlap[some]), pa.array(best.id[some])], names=["report_id", "n", "overlap_s", "truth_id"])

    return kernel


def best_matches(reports: DataFrame, truth: DataFrame, tolerance_hz: float) -> DataFrame:
    """(report_id, truth_id, overlap_s, met) of reports (id, t0, t1, f) that meet transmissions (id, t0, t1, f): the greatest overlap, of equals the
    smallest number, and how many are met. Rows without a number, time or frequency take no part."""
    spark = reports.sparkSession
    names = ["id", "t0", "t1", "f"]
    r, t = (x.select(*(F.col(c).cast("bigint" if c == "id" else "double") for c in names)).dropna() for x in (reports, truth))
    both = r.withColumn("report", F.lit(True)).unionByName(t.withColumn("report", F.lit(False)))
    mean = both.agg(F.avg(F.abs(F.col("t1") - F.col("t0")))).first()[0]
    width, cell = SLAB * (mean or 1.0), 2.0 * tolerance_hz or 1.0
    reach = F.when(F.col("report"), F.lit(0.0)).otherwise(1.000001 * tolerance_hz + 1e-14 * F.abs("f"))  # differences of frequencies are rounded
    slabs = F.sequence(*(F.floor(c / width) for c in (F.least("t0", "t1"), F.greatest("t0", "t1"))))
    cells = F.sequence(F.floor((F.col("f") - reach) / cell), F.floor((F.col("f") + reach) / cell))
    dealt = both.withColumn("slab", F.explode(slabs)).withColumn("cell", F.explode(cells))
    tasks = 4 * spark.sparkContext.defaultParallelism  # narrow rows with long work: by size alone they would be one task
    found = dealt.repartition(tasks, "slab", "cell").groupBy("slab", "cell").applyInArrow(best_in_slab(width, tolerance_hz), BEST)
    top = F.max(F.struct("overlap_s", (-F.col("truth_id")).alias("o")))
    out = found.groupBy("report_id").agg(top.alias("b"), F.sum("n").alias("met"))
    return out.select("report_id", (-F.col("b.o")).alias("truth_id"), F.col("b.overlap_s").alias("overlap_s"), "met")
