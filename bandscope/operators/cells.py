"""Detection in arrays of cells: constant false-alarm rate, pairs, hold, tones, runs; array expressions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S


def ca_factor(pfa: float, cells: int = 24) -> float:
    """Threshold factor on the mean of exponential cells."""
    return cells * (pfa ** (-1.0 / cells) - 1.0)


def os_factor(pfa: float, cells: int = 24, rank: int = 18) -> float:
    """Threshold factor on the ``rank``-th smallest cell, by bisection of the false-alarm probability."""

    def rate(alpha: float) -> float:
        return math.prod((cells - i) / (cells - i + alpha) for i in range(rank))

    return _bisect(rate, pfa)


def _bisect(rate, pfa: float) -> float:
    low, high = 0.0, 1.0
    while rate(high) > pfa:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if rate(mid) > pfa else (low, mid)
    return (low + high) / 2


def pair_factor(factor_of_noise, pfa: float) -> float:
    """Threshold factor for the sum of two cells: ``factor_of_noise(alpha)`` is the mean of exp(-alpha x)(1 + alpha x) over the noise estimate x."""
    return _bisect(factor_of_noise, pfa)


def ca_pair_rate(cells: int = 24):
    """P(sum of two cells > alpha * mean): gamma(2) against a gamma(cells) mean, in closed form."""
    return lambda a: (1 + a / cells) ** -cells * (1 + cells * (a / cells) / (1 + a / cells))


def os_pair_rate(cells: int = 24, rank: int = 18):
    """P(sum of two cells > alpha * x) for the ``rank``-th smallest of ``cells`` exponential cells as x.

    x is a sum of ``rank`` independent exponentials with rates ``cells`` downwards, one for each step from a smallest cell to the next. So
    exp(-alpha x) has the mean L, a product of rate / (rate + alpha), and exp(-alpha x)(1 + alpha x), the tail of two cells, L - alpha L'.
    """
    rates = [float(cells - i) for i in range(rank)]

    def rate(alpha: float) -> float:
        laplace = math.exp(-sum(math.log1p(alpha / r) for r in rates))
        return laplace * (1 + sum(alpha / (r + alpha) for r in rates))

    return rate


def pair_threshold(pfa: float, method: str = "os", cells: int = 24, rank: int = 18) -> float:
    """Threshold factor on one cell's noise estimate for the sum of two adjacent cells."""
    if method not in ("os", "ca"):
        raise ValueError("the method is os or ca")
    return pair_factor(os_pair_rate(cells, rank) if method == "os" else ca_pair_rate(cells), pfa)


def reference_offsets(cells: int, guard: int) -> list[int]:
    half = cells // 2
    return [*range(-half - guard, -guard), *range(guard + 1, guard + half + 1)]


def references(power: Column, bins: int, cells: int = 24, guard: int = 2) -> Column:
    """For each cell, the array of its reference cells, taken around the circle."""
    offsets = F.array(*map(F.lit, reference_offsets(cells, guard)))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.transform(offsets, lambda o: F.get(power, F.pmod(i + o, F.lit(bins)).cast("int"))))


def noise_estimate(power: Column, bins: int, method: str = "os", cells: int = 24, guard: int = 2, rank: int = 18) -> Column:
    gathered = references(power, bins, cells, guard)
    if method == "os":
        return F.transform(gathered, lambda r: F.get(F.array_sort(r), F.lit(rank - 1)))
    return F.transform(gathered, lambda r: F.aggregate(r, F.lit(0.0), lambda a, x: a + x) / cells)


def mask(power: Column, noise: Column, factor: float, excluded: list[int] | None = None) -> Column:
    """Cells strictly above the threshold, outside the excluded bins."""
    hit = F.zip_with(power, noise, lambda p, n: p > n * factor)
    if not excluded:
        return hit
    out = F.array(*map(F.lit, excluded))
    return F.transform(hit, lambda h, i: h & ~F.array_contains(out, i))


def pair_mask(power: Column, noise: Column, bins: int, factor: float, excluded: list[int] | None = None) -> Column:
    """Cells of adjacent pairs whose sum exceeds the threshold on the larger of the two noise estimates."""
    at = lambda c, i: F.get(c, F.pmod(i, F.lit(bins)).cast("int"))
    barred = F.array(*map(F.lit, excluded)) if excluded else F.array().cast("array<int>")
    free = lambda i: ~F.array_contains(barred, F.pmod(i, F.lit(bins)).cast("int"))
    fires = lambda i: (at(power, i) + at(power, i + 1) > F.greatest(at(noise, i), at(noise, i + 1)) * factor) & free(i) & free(i + 1)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: fires(k) | fires(k - 1))


def detections(frames: DataFrame, bins: int, pfa: float = 1e-8, method: str = "os", cells: int = 24, guard: int = 2, rank: int = 18, excluded: list[int] | None = None) -> DataFrame:
    """Rows (keys, bin, power, noise, snr_db) of hit cells of frames with a ``power`` array; the array is exploded only after the filter."""
    factor = os_factor(pfa, cells, rank) if method == "os" else ca_factor(pfa, cells)
    keys = [c for c in frames.columns if c != "power"]
    noisy = frames.withColumn("noise", noise_estimate(F.col("power"), bins, method, cells, guard, rank))
    hit = mask(F.col("power"), F.col("noise"), factor, excluded)
    row = F.zip_with(F.zip_with("power", "noise", lambda p, n: F.struct(p.alias("power"), n.alias("noise"))), hit, lambda x, h: F.when(h, x))
    indexed = F.filter(F.transform(row, lambda x, i: F.struct(i.alias("bin"), x.alias("x"))), lambda s: s["x"].isNotNull())
    return noisy.select(*keys, F.explode(indexed).alias("d")).select(*keys, F.col("d.bin").alias("bin"), F.col("d.x.power").alias("power"), F.col("d.x.noise").alias("noise"), (10 * F.log10(F.col("d.x.power") / F.col("d.x.noise"))).alias("snr_db"))


def held_levels(frames: DataFrame, frame: str = "frame", every: int = 64, exclusion: float = 8.0) -> DataFrame:
    """Each frame's mean power over bins below the exclusion level of the held noise, and its ratio to the anchor frame of its hold.

    The anchor is the first frame of ``floor(frame / every)``, so the result doesn't depend on blocks or partitions.
    """
    w = Window.partitionBy("hold").orderBy(frame)
    f = frames.withColumn("hold", F.floor(F.col(frame) / every)).withColumn("anchor", F.first("power").over(w))
    quiet = F.filter(F.zip_with("power", "anchor", lambda p, a: F.when(p < exclusion * a, p)), lambda x: x.isNotNull())
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / F.size(c)
    f = f.withColumn("level", F.when(F.size(quiet) > 0, mean(quiet)).otherwise(mean(F.col("power"))))
    return f.withColumn("ratio", F.col("level") / F.greatest(F.first("level").over(w), F.lit(1e-300))).drop("anchor")


def tone_magnitude(samples: Column, frequency: float, rate: float) -> Column:
    """Magnitude of one frequency in an array of samples, scaled so that a sine of amplitude one gives one."""
    step = 2 * math.pi * frequency / rate
    part = lambda f: F.aggregate(F.transform(samples, lambda x, i: x * f(i * step)), F.lit(0.0), lambda a, x: a + x)
    return 2 * F.sqrt(part(F.cos) * part(F.cos) + part(F.sin) * part(F.sin)) / F.size(samples)


def tone_windows(windows: DataFrame, rate: float, tones=S.TONES_HZ) -> DataFrame:
    """Add the strongest tone of each window (``samples``) and its contrast with the median of the others."""
    table = F.array(*(F.struct(tone_magnitude(F.col("samples"), t, rate).alias("m"), F.lit(t).alias("tone")) for t in tones))
    w = windows.withColumn("tones__", F.array_sort(table, lambda a, b: F.when(a["m"] > b["m"], -1).when(a["m"] < b["m"], 1).otherwise(F.when(a["tone"] < b["tone"], -1).otherwise(1))))
    n = len(tones) - 1
    others = F.slice("tones__", 2, n)
    middle = (others[(n - 1) // 2]["m"] + others[n // 2]["m"]) / 2
    return w.withColumn("tone_hz", F.col("tones__")[0]["tone"]).withColumn("contrast", F.col("tones__")[0]["m"] / (middle + 1e-12)).drop("tones__")


def tone_vote(windows: DataFrame, key: str, order: str, min_contrast: float = 8.0, share: float = 0.6, least: int = 2) -> DataFrame:
    """The tone that wins enough of an emission's windows, the first voted of equals; null without a majority."""
    good = windows.where(F.col("contrast") >= min_contrast)
    votes = good.groupBy(key, "tone_hz").agg(F.count("*").alias("votes"), F.min(order).alias("first_vote"))
    best = votes.groupBy(key).agg(F.max(F.struct("votes", (-F.col("first_vote")).alias("o"), "tone_hz")).alias("b"), F.sum("votes").alias("voting"))
    all_ = windows.groupBy(key).agg(F.count("*").alias("windows"), F.median("contrast").alias("median_contrast"))
    wins = (F.col("windows") >= least) & (F.col("b.votes") >= share * F.col("windows"))
    return all_.join(best, key, "left").select(key, F.when(wins, F.col("b.tone_hz")).alias("tone_hz"), F.coalesce("b.votes", F.lit(0)).alias("votes"), "windows", "median_contrast")


def code_histogram(codes: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    """Built-in-test figures from a histogram of sample codes, which is the whole sufficient statistic."""
    h = codes.groupBy(*keys, code).agg(F.count("*").alias("k"))
    n, c = F.sum("k"), F.col(code).cast("double")
    mean = F.sum(c * F.col("k")) / n
    return h.groupBy(*keys).agg(
        F.count("*").alias("occupied_codes"),
        F.log2(F.count("*").cast("double")).alias("approx_bits"),
        (20 * F.log10(F.greatest(F.max(F.abs(c)), F.lit(1e-12)) / 128)).alias("peak_dbfs"),
        mean.alias("mean_code"),
        F.sqrt(F.greatest(F.sum(c * c * F.col("k")) / n - mean * mean, F.lit(0.0))).alias("std_code"),
        (F.max(code) - F.min(code) + 1).alias("code_range"),
        n.alias("n_samples"),
    )


def longest_run(df: DataFrame, keys: list[str], order: str, condition: Column) -> DataFrame:
    """Length of the longest consecutive run of rows that meet a condition (gaps and islands)."""
    w, own = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys, "ok__").orderBy(order)
    r = df.withColumn("ok__", condition).withColumn("island__", F.row_number().over(w) - F.row_number().over(own))
    runs = r.where("ok__").groupBy(*keys, "island__").agg(F.count("*").alias("n"))
    return runs.groupBy(*keys).agg(F.max("n").alias("longest"))


def smoothed(df: DataFrame, keys: list[str], order: str, value: str, taps: int = 9) -> Column:
    """Moving average with zeros beyond the ends: always divided by the number of taps."""
    half = taps // 2
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, half)) / taps
