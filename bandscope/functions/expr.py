"""Scalar functions as column expressions; all stay inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def channel_at(frequency, tolerance: float = S.CHANNEL_TOLERANCE_HZ) -> Column:
    """The channel whose centre lies within the tolerance, or null."""
    k = F.rint((_c(frequency) - S.CHANNEL_1_HZ) / S.CHANNEL_SPACING_HZ)
    near = F.abs(_c(frequency) - (S.CHANNEL_1_HZ + S.CHANNEL_SPACING_HZ * k)) <= tolerance
    return F.when(near & k.between(0, S.CHANNEL_COUNT - 1), (k + 1).cast("int"))


def channel_frequency(channel) -> Column:
    return S.CHANNEL_1_HZ + (_c(channel) - 1) * S.CHANNEL_SPACING_HZ


def raster_channel(frequency, base: float = S.UHF_BASE_HZ, step: float = S.UHF_STEP_HZ, first: int = S.UHF_CHANNELS[0], last: int = S.UHF_CHANNELS[1]) -> Column:
    """The nearest channel of a regular raster, held within its range; halves go to the even channel."""
    k = F.rint((_c(frequency) - base) / step)
    return F.greatest(F.lit(first), F.least(F.lit(last), k.cast("int")))


def raster_centre(channel, base: float = S.UHF_BASE_HZ, step: float = S.UHF_STEP_HZ) -> Column:
    return base + _c(channel) * step


def nearest_carrier(frequency, raster: float = S.CARRIER_RASTER_HZ) -> Column:
    return F.rint(_c(frequency) / raster) * raster


def image_frequency(frequency, centre: float = S.RECEIVER_CENTRE_HZ) -> Column:
    return 2 * F.lit(centre) - _c(frequency)


def bin_frequency(index, bins: int, rate: float, centre: float) -> Column:
    k = _c(index)
    return centre + F.when(k < bins // 2 + bins % 2, k).otherwise(k - bins) * (rate / bins)


def overlaps(start_a, end_a, start_b, end_b) -> Column:
    """Half-open intervals that share more than a border."""
    return (_c(start_a) < _c(end_b)) & (_c(start_b) < _c(end_a))


def adjacent_bins(a, b, bins: int) -> Column:
    d = _c(a) - _c(b)
    return F.least(F.pmod(d, F.lit(bins)), F.pmod(-d, F.lit(bins))) == 1


def tones_match(a, b, tolerance: float = S.TONE_TOLERANCE_HZ) -> Column:
    """Equal tones; an absent tone equals only an absent one."""
    both = F.coalesce(F.abs(_c(a) - _c(b)) <= tolerance, F.lit(False))
    return both | (_c(a).isNull() & _c(b).isNull())


def classify(tone, known: float | None) -> Column:
    if known is None:
        return F.lit("UNKNOWN")
    return F.when(F.abs(_c(tone) - known) < S.FRIEND_TOLERANCE_HZ, "FRIEND").otherwise("UNKNOWN")


def rounded_product(x, places: int) -> Column:
    """The double rounded by way of its product with a power of ten, halves away from zero: ``F.round`` takes each one through its decimal text, many times slower."""
    x, power = _c(x), 10.0**places
    y = F.abs(x) * power
    whole = F.floor(y)
    near = (whole + F.when(y - whole >= 0.5, 1).otherwise(0)) / power
    return F.when(y < 2.0**52, F.when(x < 0, -near).otherwise(near)).otherwise(x)


def decibels(x, floor: float = 1e-20) -> Column:
    return 10 * F.log10(F.greatest(_c(x), F.lit(floor)))


def free_space_loss_db(frequency, distance=1.0) -> Column:
    return 20 * F.log10(4 * math.pi * _c(distance) * _c(frequency) / S.SPEED_OF_LIGHT)


def path_loss_db(distance, frequency, exponent, reference_m: float = 1.0) -> Column:
    return free_space_loss_db(frequency, reference_m) + 10 * _c(exponent) * F.log10(_c(distance) / reference_m)


def range_m(received_dbm, frequency, exponent, eirp_dbm, receiver_gain_dbi=0.0, shadowing_db=0.0, reference_m: float = 1.0) -> Column:
    """The log-distance model solved for distance."""
    loss = _c(eirp_dbm) + _c(receiver_gain_dbi) - _c(received_dbm) - free_space_loss_db(frequency, reference_m) - _c(shadowing_db)
    return reference_m * F.pow(F.lit(10.0), loss / (10 * _c(exponent)))


def wavelength_m(frequency) -> Column:
    return S.SPEED_OF_LIGHT / _c(frequency)


def plausible_gain_dbi(frequency, dimension) -> Column:
    aperture = 0.6 * _c(dimension) * _c(dimension)
    return 10 * F.log10(F.greatest(4 * math.pi * aperture / (wavelength_m(frequency) * wavelength_m(frequency)), F.lit(1e-6)))


def required_dimension_m(frequency, gain_dbi) -> Column:
    aperture = F.pow(F.lit(10.0), _c(gain_dbi) / 10) * wavelength_m(frequency) * wavelength_m(frequency) / (4 * math.pi)
    return F.sqrt(aperture / 0.6)


def quantise_gain(requested, step: float, most: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(most), F.rint(_c(requested) / step) * step))


def plan_gains(external_gain, target: float = 52.0) -> tuple[Column, Column]:
    """First and second gain stage for what remains of the target."""
    budget = F.greatest(F.lit(0.0), target - _c(external_gain))
    first = F.least(F.lit(40.0), F.floor(budget / 8) * 8.0)
    return quantise_gain(first, 8.0, 40.0), quantise_gain(F.least(F.lit(62.0), budget - first), 2.0, 62.0)


def gain_key(lna, vga, amp) -> Column:
    return F.concat(F.lit("lna"), F.rint(_c(lna)).cast("bigint").cast("string"), F.lit("_vga"), F.rint(_c(vga)).cast("bigint").cast("string"), F.lit("_amp"), _c(amp).cast("int").cast("string"))


def peak_offset_bins(left, centre, right) -> Column:
    """Offset of a peak by a parabola through three levels in dB; zero unless the centre is the highest."""
    a, b, c = (decibels(x, 1e-30) for x in (left, centre, right))
    bend = a - 2 * b + c
    usable = (_c(centre) >= _c(left)) & (_c(centre) >= _c(right)) & (_c(left) > 0) & (_c(right) > 0) & (bend != 0)
    return F.when(usable, F.greatest(F.lit(-0.5), F.least(F.lit(0.5), 0.5 * (a - c) / bend))).otherwise(F.lit(0.0))


def iso_time(seconds) -> Column:
    """UTC time with two decimals, cut off, not rounded."""
    t = F.timestamp_micros(F.floor(_c(seconds) * 1_000_000 + F.lit(0.5)).cast("bigint"))
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SS'Z'")


def utc_hour(seconds) -> Column:
    """Hour of the day in UTC, from arithmetic only."""
    return F.floor(F.pmod(_c(seconds), F.lit(86_400.0)) / 3_600).cast("int")


def escaped(text) -> Column:
    out = _c(text)
    for raw, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(name))
    return out


def tag(name: str, attributes: dict[str, Column] | None = None, text: Column | None = None, children: list[Column] | None = None) -> Column:
    """An XML element; an empty one closes itself."""
    parts: list[Column] = [F.lit(f"<{name}")]
    for key, value in (attributes or {}).items():
        parts += [F.lit(f' {key}="'), escaped(value), F.lit('"')]
    if text is None and not children:
        return F.concat(*parts, F.lit("/>"))
    return F.concat(*parts, F.lit(">"), *([] if text is None else [escaped(text)]), *(children or []), F.lit(f"</{name}>"))


def fixed(x, places: int) -> Column:
    """A number with fixed decimals and no grouping; null stays null."""
    return F.format_string(f"%.{places}f", _c(x).cast("double"))


def place_name(frequency, channel, decimals: int = 5) -> Column:
    return F.when(F.coalesce(_c(channel), F.lit(0)) != 0, F.concat(F.lit("PMR"), _c(channel).cast("string"))).otherwise(fixed(_c(frequency) / 1e6, decimals))


def emitter_label(frequency, channel, tone) -> Column:
    sounds = F.coalesce(_c(tone), F.lit(0.0)) != 0
    return F.concat(place_name(frequency, channel), F.lit("/"), F.when(sounds, F.concat(fixed(tone, 1), F.lit("Hz"))).otherwise(F.lit("no-tone")))
