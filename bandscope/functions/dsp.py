"""NumPy kernels: filter design, channeliser, demodulation, tones, survey, frequency references, synthesis."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from .. import schema as S

# Limits of the narrow-band FM standard, and of the tone analysis.
MAX_DEVIATION_HZ = 2_500.0
VOICE_HZ = (250.0, 3_000.0)
DEVIATION_PERCENTILE = 99
TONE_RATE_HZ = 1_000.0
TONE_WINDOW_S = 0.5
TONE_CUTOFF_HZ = 300.0


def kaiser_beta(attenuation_db: float) -> float:
    """The published rule for the shape of a Kaiser window."""
    if attenuation_db > 50:
        return 0.1102 * (attenuation_db - 8.7)
    return 0.5842 * (attenuation_db - 21) ** 0.4 + 0.07886 * (attenuation_db - 21) if attenuation_db > 21 else 0.0


def lowpass(taps: int, cutoff_hz: float, rate: float, window: np.ndarray) -> np.ndarray:
    """Windowed-sinc low-pass filter with unit gain at zero."""
    n = np.arange(taps) - (taps - 1) / 2
    h = np.sinc(2 * cutoff_hz / rate * n) * window
    return h / h.sum()


def bandpass(taps: int, low_hz: float, high_hz: float, rate: float) -> np.ndarray:
    """Hamming-windowed band-pass filter with unit gain at its centre."""
    n = np.arange(taps) - (taps - 1) / 2
    h = (2 * high_hz / rate * np.sinc(2 * high_hz / rate * n) - 2 * low_hz / rate * np.sinc(2 * low_hz / rate * n)) * np.hamming(taps)
    return h / np.abs((h * np.exp(-2j * np.pi * n * (low_hz + high_hz) / 2 / rate)).sum())


def prototype(s: S.Settings, attenuation_db: float = 80.0) -> np.ndarray:
    """The channeliser's filter: minus 6 dB at the channel edge."""
    spacing = s.sample_rate / s.num_channels
    if spacing < S.OCCUPIED_BANDWIDTH_HZ:
        raise ValueError("channels are narrower than an emission")
    return lowpass(s.num_taps, spacing / 2, s.sample_rate, np.kaiser(s.num_taps, kaiser_beta(attenuation_db))).astype(np.float32)


def response_db(taps: np.ndarray, rate: float, points: int = 8_192) -> tuple[np.ndarray, np.ndarray]:
    h = np.fft.rfft(taps, 2 * points)
    return np.fft.rfftfreq(2 * points, 1 / rate), 20 * np.log10(np.maximum(np.abs(h), 1e-15))


#: Frames filtered at once, so that the work stays in the cache.
CHUNK = 512


class Channelizer:
    """Weighted-overlap filter bank, anchored on absolute sample numbers, so any cut of the stream gives the same frames.

    Frame ``f`` covers samples ``f * decimation`` onwards for ``num_taps``; bin ``k`` is the signal about ``k`` channel spacings.
    """

    def __init__(self, s: S.Settings):
        self.s = s
        m, d = s.num_channels, s.decimation
        self.segments = prototype(s).reshape(s.taps_per_phase, m)
        # A frame starts d samples after the last, which turns bin k by k * d / m; the turns repeat.
        start = np.arange(m // np.gcd(m, d)) * d % m
        self.turns = np.exp(-2j * np.pi * (start[:, None] * np.arange(m) % m) / m).astype(np.complex64)

    @property
    def halo(self) -> int:
        """Samples after a block that its frames need."""
        return self.s.num_taps - 1

    def frames(self, x: np.ndarray, start: int, until: int) -> tuple[int, np.ndarray]:
        """First frame number and spectra of the frames that begin in samples ``start`` to ``until`` and fit in ``x`` (from ``start``)."""
        s = self.s
        first = -(-start // s.decimation)
        last = min((until - 1) // s.decimation, (start + len(x) - s.num_taps) // s.decimation)
        if last < first:
            return first, np.zeros((0, s.num_channels), np.complex64)
        m, n = s.num_channels, last - first + 1
        out = np.empty((n, m), np.complex64)
        # Rows of one channel period each; the segments of a frame lie whole periods apart.
        rows = np.lib.stride_tricks.sliding_window_view(x, m)[first * s.decimation - start :]
        for lo in range(0, n, CHUNK):
            k = min(CHUNK, n - lo)
            part = np.zeros((k, m), np.complex64)
            for j in range(s.taps_per_phase):
                at = lo * s.decimation + j * m
                part += rows[at : at + (k - 1) * s.decimation + 1 : s.decimation] * self.segments[j]
            turn = self.turns[(first + lo + np.arange(k)) % len(self.turns)]
            np.multiply(np.fft.fft(part, axis=1), turn, out=out[lo : lo + k], casting="same_kind")
        return first, out


    def bins(self, x: np.ndarray, start: int, until: int, wanted: list[tuple[int, int, int]]) -> list[tuple[int, np.ndarray]]:
        """For each wanted (first frame, last frame, bin) its first frame here and its samples, by the frames that ``frames`` would give.

        Only the wanted stretches are folded, each once for all its bins, and only the wanted bins are turned.
        """
        s, m = self.s, self.s.num_channels
        least = -(-start // s.decimation)
        most = min((until - 1) // s.decimation, (start + len(x) - s.num_taps) // s.decimation)
        cut = [(max(lo, least), min(hi, most), k) for lo, hi, k in wanted]
        stretches: list[list[int]] = []
        for lo, hi, _ in sorted(cut):
            if hi < lo:
                continue
            if stretches and lo <= stretches[-1][1] + 1:
                stretches[-1][1] = max(stretches[-1][1], hi)
            else:
                stretches.append([lo, hi])
        out: list[tuple[int, np.ndarray]] = [(lo, np.zeros(max(0, hi - lo + 1), np.complex64)) for lo, hi, _ in cut]
        rows = np.lib.stride_tricks.sliding_window_view(x, m) if len(x) >= m else None
        for a, b in stretches:
            own = [i for i, (lo, hi, _) in enumerate(cut) if lo <= hi and a <= lo and hi <= b]
            ks = np.unique([cut[i][2] for i in own])
            column = {int(k): j for j, k in enumerate(ks)}
            turn = np.exp(-2j * np.pi * (np.arange(m)[:, None] * ks % m) / m).astype(np.complex64)
            for lo in range(a, b + 1, CHUNK):
                n = min(CHUNK, b - lo + 1)
                part = np.zeros((n, m), np.complex64)
                for j in range(s.taps_per_phase):
                    at = lo * s.decimation - start + j * m
                    part += rows[at : at + (n - 1) * s.decimation + 1 : s.decimation] * self.segments[j]
                y = (part @ turn) * self.turns[(lo + np.arange(n)) % len(self.turns)][:, ks]
                for i in own:
                    first, last, k = cut[i]
                    f, g = max(first, lo), min(last, lo + n - 1)
                    if f <= g:
                        out[i][1][f - first : g - first + 1] = y[f - lo : g - lo + 1, column[k]]
        return out


def cfar(power: np.ndarray, first: int, s: S.Settings, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Mask and noise of frames. The noise shape is estimated on each hold's first frame (holds are counted from frame zero,
    or from the block's start within its first hold) and follows each frame's level over quiet bins."""
    m, half, guard = s.num_channels, s.reference_cells // 2, s.guard_cells
    offsets = np.r_[-half - guard : -guard, guard + 1 : guard + half + 1]
    holds = (np.arange(len(power)) + first) // s.hold_frames
    begin = np.flatnonzero(np.r_[True, holds[1:] != holds[:-1]])
    anchor = power[begin]
    cells = anchor[:, (np.arange(m)[:, None] + offsets) % m]
    held = np.partition(cells, s.order_statistic - 1, axis=2)[:, :, s.order_statistic - 1] if s.method == "os" else cells.mean(axis=2)
    which = np.searchsorted(begin, np.arange(len(power)), side="right") - 1
    quiet = power < s.level_exclusion * held[which]
    count = quiet.sum(axis=1)
    level = np.where(count > 0, (power * quiet).sum(axis=1) / np.maximum(count, 1), power.mean(axis=1))
    noise = held[which] * (level / np.maximum(level[begin][which], 1e-300))[:, None]
    hit = power > noise * factor
    hit[:, s.excluded_bins()] = False
    return hit, noise


def discriminate(iq: np.ndarray, rate: float) -> np.ndarray:
    """Instantaneous deviation in Hz, one sample less than the input."""
    if len(iq) < 2:
        return np.zeros(0)
    x = iq / (np.abs(iq) + 1e-12)
    return np.angle(x[1:] * np.conj(x[:-1])) * rate / (2 * np.pi)


def deviation(iq: np.ndarray, rate: float) -> tuple[float, float]:
    """Peak (99th percentile) and root-mean-square deviation."""
    d = discriminate(iq, rate)
    return (float(np.percentile(np.abs(d), DEVIATION_PERCENTILE)), float(np.sqrt(np.mean(d * d)))) if len(d) else (0.0, 0.0)


def goertzel(x: np.ndarray, tones, rate: float) -> np.ndarray:
    """Magnitudes at any frequencies; a sine of amplitude one gives one."""
    n = np.arange(len(x))
    return np.abs(np.exp(-2j * np.pi * np.outer(np.asarray(tones), n) / rate) @ x) * 2 / max(len(x), 1)


def find_tone(audio: np.ndarray, rate: float, contrast: float = 8.0, share: float = 0.6, least: int = 2) -> tuple[float | None, float, int, int]:
    """The sub-audible tone by vote of half-second windows: tone or None, median contrast, windows, votes."""
    step = int(round(rate / TONE_RATE_HZ))
    low = np.convolve(audio, lowpass(129, TONE_CUTOFF_HZ, rate, np.kaiser(129, 8.0)))[: len(audio)][::step]
    slow = rate / step
    size = int(round(TONE_WINDOW_S * slow))
    windows = len(low) // size if size else 0
    if windows < least:
        return None, 0.0, windows, 0
    votes: dict[float, list[float]] = {}
    for i in range(windows):
        m = goertzel(low[i * size : (i + 1) * size], S.TONES_HZ, slow)
        best = int(m.argmax())
        c = float(m[best] / (np.median(np.delete(m, best)) + 1e-12))
        if c >= contrast:
            votes.setdefault(S.TONES_HZ[best], []).append(c)
    if not votes:
        return None, 0.0, windows, 0
    tone = max(votes, key=lambda t: len(votes[t]))
    agreed = len(votes[tone])
    return (tone, float(np.median(votes[tone])), windows, agreed) if agreed >= share * windows else (None, 0.0, windows, agreed)


def blackman_harris(n: int, periodic: bool = True) -> np.ndarray:
    # The four published coefficients.
    k = 2 * np.pi * np.arange(n) / (n if periodic else n - 1)
    return 0.35875 - 0.48829 * np.cos(k) + 0.14128 * np.cos(2 * k) - 0.01168 * np.cos(3 * k)


def survey_sum(x: np.ndarray, size: int = 1_024, hop: int = 512) -> tuple[np.ndarray, int]:
    """Sum of power spectra (in FFT order) over the frames that fit, and their number: a mergeable state."""
    if len(x) < size:
        return np.zeros(size), 0
    w = blackman_harris(size)
    view = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    total = np.zeros(size)
    for lo in range(0, len(view), 2_048):
        total += (np.abs(np.fft.fft(view[lo : lo + 2_048] * (w / w.sum()), axis=1)) ** 2).sum(axis=0)
    return total, len(view)


def edge(f: np.ndarray, db: np.ndarray, level: float, rising: bool) -> float:
    """The first crossing of a level outwards from the peak, interpolated."""
    peak = int(db.argmax())
    side = db[: peak + 1][::-1] if rising else db[peak:]
    freq = f[: peak + 1][::-1] if rising else f[peak:]
    cross = np.flatnonzero((side[:-1] >= level) & (side[1:] < level))
    if not len(cross):
        raise ValueError("no bin on this side falls below the level")
    i = cross[0]
    return float(freq[i] + (side[i] - level) / (side[i] - side[i + 1]) * (freq[i + 1] - freq[i]))


def flat_top_centre(f: np.ndarray, power: np.ndarray, expected_hz: float, below_db: float = 10.0, tolerance: float = 0.15) -> tuple[float, float]:
    """Centre and half width of a flat-topped signal by its edges; refuses one of another width."""
    db = np.convolve(10 * np.log10(np.maximum(power, 1e-30)), np.ones(9) / 9, mode="same")
    level = db.max() - below_db
    low, high = edge(f, db, level, True), edge(f, db, level, False)
    if abs(high - low - expected_hz) > tolerance * expected_hz:
        raise ValueError("what was measured has not the width of the reference")
    return (low + high) / 2, (high - low) / 2


def notch_offset(f: np.ndarray, power: np.ndarray, nominal_hz: float, tuned_hz: float, half_window_hz: float = 30_000.0, least_width_hz: float = 5_000.0) -> float:
    """Offset of a carrier from its nominal frequency by the axis of symmetry of its empty centre."""
    if abs(tuned_hz - nominal_hz) < 200_000:
        raise ValueError("the receiver is tuned too close to the carrier")
    near = np.abs(f - nominal_hz) < half_window_hz
    if near.sum() < 50:
        raise ValueError("the spectrum does not span the carrier's centre")
    x, db = f[near] - nominal_hz, np.convolve(10 * np.log10(np.maximum(power[near], 1e-30)), np.ones(9) / 9, mode="same")
    flank = np.abs(x) > 0.55 * half_window_hz
    if flank.sum() < 20:
        raise ValueError("no flank to level against")
    flat = db - np.polyval(np.polyfit(x[flank], db[flank], 1), x)
    low = np.r_[False, flat < -3, False]
    turns = np.flatnonzero(np.diff(low)).reshape(-1, 2)
    if (np.diff(turns, axis=1).max(initial=0)) * (f[1] - f[0]) < least_width_hz:
        raise ValueError("no broad dip: no carrier centre here")
    lag, axis = np.arange(-11_000.0, 11_001.0, 50.0), np.arange(-6_000.0, 6_025.0, 25.0)
    cost = ((np.interp(axis[:, None] - lag, x, flat) - np.interp(axis[:, None] + lag, x, flat)) ** 2).mean(axis=1)
    i = int(cost.argmin())
    if 0 < i < len(cost) - 1:
        bend = cost[i - 1] - 2 * cost[i] + cost[i + 1]
        if bend > 0:
            return float(axis[i] + 12.5 * (cost[i - 1] - cost[i + 1]) / bend)
    return float(axis[i])


@dataclass
class Emitter:
    name: str
    frequency_hz: float | None = None
    channel: int | None = None
    eirp_dbm: float = 27.0
    distance_m: float = 1_000.0
    ctcss_hz: float | None = None
    frequency_error_hz: float = 0.0
    deviation_hz: float = 1_500.0
    ramp_ms: float = 5.0
    transmissions: list[tuple[float, float]] = field(default_factory=list)

    def centre(self) -> float:
        base = self.frequency_hz if self.frequency_hz is not None else S.CHANNEL_1_HZ + (self.channel - 1) * S.CHANNEL_SPACING_HZ
        return base + self.frequency_error_hz


@dataclass
class Scenario:
    """A synthetic scene; every block is made on its own, from absolute time and a seed of its number."""

    name: str = "scene"
    duration_s: float = 2.0
    sample_rate: float = 500_000.0
    centre_frequency: float = S.RECEIVER_CENTRE_HZ
    noise_floor_dbm: float = -90.0
    seed: int = 1
    exponent: float = 3.0
    shadowing_sigma_db: float = 0.0
    emitters: list[Emitter] = field(default_factory=list)

    @classmethod
    def from_dict(cls, data: dict) -> Scenario:
        data = dict(data)
        emitters = [Emitter(**{**e, "transmissions": [(t["start_s"], t["stop_s"]) if isinstance(t, dict) else tuple(t) for t in e.get("transmissions", [])]}) for e in data.pop("emitters", [])]
        path = data.pop("propagation", {})
        extra = {"exponent": path.get("path_loss_exponent", 3.0), "shadowing_sigma_db": path.get("shadowing_sigma_db", 0.0)} if path else {}
        return cls(emitters=emitters, **data, **extra)

    def received_dbm(self, e: Emitter, k: int) -> float:
        loss = 20 * np.log10(4 * np.pi * e.centre() / S.SPEED_OF_LIGHT) + 10 * self.exponent * np.log10(max(e.distance_m, 1.0))
        shadow = np.random.default_rng([self.seed, k, len(e.name)]).normal(0, self.shadowing_sigma_db) if self.shadowing_sigma_db else 0.0
        return float(e.eirp_dbm - loss - shadow)

    def truth(self) -> list[tuple]:
        """(emitter, start_s, stop_s, frequency_hz, pmr_channel, ctcss_hz, received_dbm, snr_db) by start."""
        out = []
        for e in self.emitters:
            f = e.centre()
            if abs(f - self.centre_frequency) > self.sample_rate / 2:
                raise ValueError(f"emitter {e.name} lies outside the captured band")
            k = round((f - S.CHANNEL_1_HZ) / S.CHANNEL_SPACING_HZ)
            on = 0 <= k < S.CHANNEL_COUNT and abs(f - S.CHANNEL_1_HZ - k * S.CHANNEL_SPACING_HZ) <= 1_000.0
            floor = self.noise_floor_dbm - 10 * np.log10(self.sample_rate / S.CHANNEL_SPACING_HZ)
            for i, (a, b) in enumerate(e.transmissions):
                p = self.received_dbm(e, i)
                out.append((e.name, float(a), float(min(b, self.duration_s)), float(f), int(k + 1) if on else None, e.ctcss_hz, p, float(p - floor)))
        return sorted(out, key=lambda r: r[1])

    def block(self, start: int, n: int) -> np.ndarray:
        """Samples ``start`` to ``start + n``; the modulation's phase has a closed form, so blocks join seamlessly."""
        rng = np.random.default_rng([self.seed, start])
        x = 10 ** (self.noise_floor_dbm / 20) * np.sqrt(0.5) * (rng.standard_normal(n) + 1j * rng.standard_normal(n))
        t = (start + np.arange(n)) / self.sample_rate
        for e in self.emitters:
            for k, (a, b) in enumerate(e.transmissions):
                on = (t >= a) & (t < min(b, self.duration_s))
                if not on.any():
                    continue
                u = t[on]
                phase = 2 * np.pi * (e.centre() - self.centre_frequency) * u
                for share, hz in ((0.5 * e.deviation_hz, 640.0), (0.3 * e.deviation_hz, 1_750.0), (500.0 if e.ctcss_hz else 0.0, e.ctcss_hz or 1.0)):
                    phase = phase - share / hz * np.cos(2 * np.pi * hz * u)
                ramp = max(e.ramp_ms * 1e-3, 1e-9)
                key = 0.5 * (1 - np.cos(np.pi * np.clip(np.minimum((u - a) / ramp, (b - u) / ramp), 0, 1)))
                x[on] += 10 ** (self.received_dbm(e, k) / 20) * key * np.exp(1j * phase)
        return x.astype(np.complex64)
