"""Event documents for emissions, as column expressions, and the plain-text and web reports of small results."""

from __future__ import annotations

import html
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .expr import classify, emitter_label, fixed, iso_time, place_name, tag

# Event types, ways of derivation and ring colours (signed ARGB) of the published format.
TYPE_FRIEND, TYPE_UNKNOWN, TYPE_RING = "a-f-G", "a-u-G", "u-d-r"
HOW_TRACK, HOW_RING = "m-c", "m-g"
# Event type and derivation of a message that a person entered.
TYPE_NOTE, HOW_NOTE = "b-t-f", "h-g-i-g-o"
#: Characters that XML 1.0 cannot hold, not even escaped.
NO_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"
RING_COLOURS = {5: 0x8000FF00, 50: 0x80FFFF00, 68: 0x80FFA500, 90: 0x80FF4500, 95: 0x80FF0000}
OTHER_COLOUR = 0x80FFFFFF
# Remarks of the published interface, word for word as receivers look for them.
NO_RANGE = "RANGE UNKNOWN: power is uncalibrated"
ASSUMED_RANGE = ("RANGE UNCALIBRATED: ", " m from an assumed model, not a measurement")
NO_BEARING = "bearing not measured: single omnidirectional sensor"
HEADER = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


@dataclass(frozen=True)
class Site:
    """The receiver's own place, the only position that is known."""

    latitude: float = 0.0
    longitude: float = 0.0
    altitude_m: float = 0.0
    prefix: str = "BAND"

    def __post_init__(self):
        if not (-90 <= self.latitude <= 90 and -180 <= self.longitude <= 180):
            raise ValueError("latitude or longitude out of range")


def _signed(argb: int) -> int:
    return argb - (1 << 32) if argb >= 1 << 31 else argb


def _heard(tone: Column) -> Column:
    return F.coalesce(tone, F.lit(0.0)) != 0


def uid(site: Site) -> Column:
    channel, tone = F.col("pmr_channel"), F.col("ctcss_tone_hz")
    place = F.when(F.coalesce(channel, F.lit(0)) != 0, F.concat(F.lit("PMR"), channel.cast("string"))).otherwise(fixed("frequency_hz", 0))
    return F.concat_ws(".", F.lit(site.prefix), place, F.when(_heard(tone), fixed(tone, 1)).otherwise(F.lit("notone")))


def remarks() -> Column:
    """What was measured and what wasn't; parts that don't apply are left out."""
    c = F.col
    known = c("range_m").isNotNull()
    middle = F.element_at("range_m", F.lit(50))
    return F.concat_ws(
        " | ",
        F.concat(fixed(c("frequency_hz") / 1e6, 5), F.lit(" MHz")),
        F.when(F.coalesce(c("pmr_channel"), F.lit(0)) != 0, F.concat(F.lit("PMR"), c("pmr_channel").cast("string"))).otherwise(F.lit("off-grid")),
        F.concat(fixed("duration_s", 1), F.lit(" s")),
        F.concat(F.lit("SNR "), fixed("snr_db", 1), F.lit(" dB")),
        F.concat(F.lit("peak "), fixed("peak_power_dbfs", 1), F.lit(" dBFS")),
        F.concat(F.lit("dev "), fixed("peak_deviation_hz", 0), F.lit(" Hz")),
        F.when(_heard(c("ctcss_tone_hz")), F.concat(F.lit("CTCSS "), fixed("ctcss_tone_hz", 1), F.lit(" Hz"))).otherwise(F.lit("no CTCSS")),
        F.when(c("attribution").isNotNull(), F.concat(c("attribution"), F.lit(" of an emission at "), fixed(F.coalesce(c("attributed_to_hz"), F.lit(0.0)) / 1e6, 5), F.lit(" MHz"))),
        F.when(~known, NO_RANGE)
        .when(~c("calibrated"), F.concat(F.lit(ASSUMED_RANGE[0]), fixed(middle, 0), F.lit(ASSUMED_RANGE[1])))
        .otherwise(F.concat(F.lit("range "), fixed(middle, 0), F.lit(" m (median)"))),
        F.lit(NO_BEARING),
    )


def _point(site: Site, error: Column) -> Column:
    unknown = F.lit(f"{S.UNKNOWN_ERROR_M:.1f}")
    return tag("point", {"lat": F.lit(f"{site.latitude:.7f}"), "lon": F.lit(f"{site.longitude:.7f}"), "hae": F.lit(f"{site.altitude_m:.1f}"), "ce": error, "le": unknown})


def _event(site: Site, name: Column, kind: Column, how: str, stale_s: float, children: list[Column]) -> Column:
    end = F.col("timestamp") + F.col("duration_s")
    attributes = {"version": F.lit("2.0"), "uid": name, "type": kind, "how": F.lit(how), "time": iso_time(end), "start": iso_time("timestamp"), "stale": iso_time(end + stale_s)}
    return F.concat(F.lit(HEADER), tag("event", attributes, children=children))


def track(site: Site, stale_s: float = S.STALE_S) -> Column:
    """The event of an emission: at the receiver, with the 95 % range as its circular error if there is one."""
    c = F.col
    error = F.coalesce(F.element_at("range_m", F.lit(95)), F.lit(S.UNKNOWN_ERROR_M))
    text = lambda x: F.coalesce(x, F.lit(""))
    own = tag(
        "measurement",
        {
            "frequency_hz": fixed("frequency_hz", 1),
            "pmr_channel": text(F.when(c("pmr_channel") != 0, c("pmr_channel").cast("string"))),
            "snr_db": fixed("snr_db", 2),
            "peak_power_dbfs": fixed("peak_power_dbfs", 2),
            "peak_deviation_hz": fixed("peak_deviation_hz", 1),
            "ctcss_tone_hz": text(F.when(_heard(c("ctcss_tone_hz")), fixed("ctcss_tone_hz", 1))),
            "duration_s": fixed("duration_s", 3),
            "calibrated": F.when(c("calibrated"), "true").otherwise("false"),
            "attribution": text(c("attribution")),
        },
    )
    label = emitter_label("frequency_hz", "pmr_channel", "ctcss_tone_hz")
    detail = tag("detail", children=[tag("contact", {"callsign": label}), tag("remarks", text=remarks()), own])
    kind = F.when(c("classification") == "FRIEND", TYPE_FRIEND).otherwise(TYPE_UNKNOWN)
    return _event(site, uid(site), kind, HOW_TRACK, stale_s, [_point(site, fixed(error, 1)), detail])


def ring(site: Site, percentile: Column, radius: Column, stale_s: float = S.STALE_S) -> Column:
    """The event of one credible range, linked to its track."""
    label = emitter_label("frequency_hz", "pmr_channel", "ctcss_tone_hz")
    basis = F.when(F.col("calibrated"), "from a calibrated level").otherwise("from the model's assumed level, which nobody has calibrated")
    told = F.concat(label, F.lit(" is within "), fixed(radius, 0), F.lit(" m with "), percentile.cast("string"), F.lit(" % credibility, "), basis, F.lit("; its direction is unknown"))
    colours = F.create_map(*(x for p, v in RING_COLOURS.items() for x in (F.lit(p), F.lit(_signed(v)))))
    colour = F.coalesce(F.try_element_at(colours, percentile), F.lit(_signed(OTHER_COLOUR))).cast("string")
    end = F.col("timestamp") + F.col("duration_s")
    detail = tag(
        "detail",
        children=[
            tag("remarks", text=told),
            tag("link", {"uid": uid(site), "type": F.lit(TYPE_FRIEND), "relation": F.lit("p-p"), "production_time": iso_time(end)}),
            tag("shape", children=[tag("ellipse", {"major": fixed(radius, 1), "minor": fixed(radius, 1), "angle": F.lit("0")})]),
            tag("color", {"argb": colour}),
        ],
    )
    name = F.concat(uid(site), F.lit(".p"), percentile.cast("string"))
    return _event(site, name, F.lit(TYPE_RING), HOW_RING, stale_s, [_point(site, fixed(radius, 1)), detail])


def note(site: Site, name: Column, sender: Column, text: Column, stale_s: float = S.STALE_S) -> Column:
    """The event of a message: at the receiver, its text as remarks without the characters that XML cannot hold."""
    detail = tag("detail", children=[tag("contact", {"callsign": sender}), tag("remarks", text=F.regexp_replace(text, NO_XML, ""))])
    return _event(site, name, F.lit(TYPE_NOTE), HOW_NOTE, stale_s, [_point(site, F.lit(f"{S.UNKNOWN_ERROR_M:.1f}")), detail])


def events(emissions: DataFrame, site: Site | None = None, stale_s: float = S.STALE_S) -> DataFrame:
    """Add ``events``: the track, then a ring for each percentile in order. Needs ``range_m`` (a map, or null)."""
    site = site or Site()
    rings = F.transform(F.array_sort(F.map_keys(F.coalesce("range_m", F.create_map().cast("map<int, double>")))), lambda p: ring(site, p, F.element_at("range_m", p), stale_s))
    return emissions.withColumn("events", F.concat(F.array(track(site, stale_s)), rings))


def describe(rows: list, title: str, columns: list[str]) -> str:
    """A small collected result as aligned text."""
    table = [columns, *([f"{v:.2f}" if isinstance(v, float) else "-" if v is None else str(v) for v in (r[c] for c in columns)] for r in rows)]
    width = [max(len(r[i]) for r in table) for i in range(len(columns))]
    return "\n".join([title, *("  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in table)])


def dashboard(grid_rows: list, profile_rows: list, title: str = "Band occupancy") -> str:
    """A self-contained page: the channel by hour grid as a heat map, and the emitters. Both are bounded by the band plan."""
    hours = [f"h{h:02d}" for h in range(24)]
    top = max((r[h] for r in grid_rows for h in hours), default=0.0) or 1.0

    def cell(v: float) -> str:
        return f'<td style="background:rgba(200,40,40,{0.12 + 0.78 * v / top:.2f})">{v:.0f}</td>' if v else "<td></td>"

    grid = "".join(f"<tr><th>{'off-grid' if r['pmr_channel'] is None else r['pmr_channel']}</th>{''.join(cell(r[h]) for h in hours)}</tr>" for r in grid_rows)
    names = list(profile_rows[0].asDict()) if profile_rows else []
    people = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c]))}</td>" for c in names) + "</tr>" for r in profile_rows)
    head = "".join(f"<th>{h}</th>" for h in range(24))
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"
        f"<table><tr><th>channel</th>{head}</tr>{grid}</table><table><tr>{''.join(f'<th>{html.escape(c)}</th>' for c in names)}</tr>{people}</table></body></html>"
    )


__all__ = ["Site", "classify", "dashboard", "describe", "events", "note", "place_name", "remarks", "ring", "track", "uid"]
