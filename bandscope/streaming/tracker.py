"""Detections as a stream: keyed open emissions across micro-batches, fan-out sinks, publishing."""

from __future__ import annotations

import logging
import socket
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema as S
from ..operators.signal import NO_BIN, detect

log = logging.getLogger(__name__)

STATE = "start long, last long, count long, peak double, total double, noise double, left_p double, right_p double, origin long"
OUT = "capture_id string, bin int, start_frame long, end_frame long, peak_power double, mean_power double, mean_noise double, left_power double, right_power double, detected_frames long"
_COLUMNS = [c.split()[0] for c in OUT.split(", ")]


def track_stream(hits: DataFrame, settings: S.Settings, frame_time: str = "frame_ts") -> DataFrame:
    """Emissions of a stream of hit cells (capture_id, bin, frame, power, noise, left_power, right_power, and ``frame_ts``).

    The event time is the frame's; a key's open emission closes when a hit lies more than the hangover later, at multiples of the
    longest extent from the first hit of its run, as in batches, or when the watermark passes its last hit by the hangover. Later rows than the watermark are dropped by Spark.
    A row of ``NO_BIN`` is no hit: it only moves the watermark, so a mark two hangovers after the end closes what is open.
    """
    hang, least, most, share = settings.hangover_frames, settings.min_frames, settings.max_frames, settings.min_occupancy
    hang_ms = max(1, int(hang / settings.frame_rate * 1000) + 1)

    def close(key: tuple, s: tuple) -> list[tuple]:
        n = s[1] - s[0] + 1
        if n < least or s[2] < share * n:
            return []
        return [(key[0], key[1], s[0], s[1], s[3], s[4] / s[2], s[5] / s[2], s[6] / s[2], s[7] / s[2], s[2])]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        if key[1] == NO_BIN:
            for _ in batches:
                pass
            yield pd.DataFrame(out, columns=_COLUMNS)
            return
        s = state.get if state.exists else None
        if state.hasTimedOut:
            out += close(key, s)
            state.remove()
            yield pd.DataFrame(out, columns=_COLUMNS)
            return
        rows = pd.concat(list(batches)).sort_values("frame")
        for f, p, n, a, b in zip(rows["frame"], rows["power"], rows["noise"], rows["left_power"], rows["right_power"], strict=True):
            goes_on = s is not None and f - s[1] <= hang
            origin = s[8] if goes_on else f
            if s is not None and not (goes_on and (f - origin) // most == (s[0] - origin) // most):
                out += close(key, s)
                s = None
            s = (f, f, 1, p, p, n, a, b, origin) if s is None else (s[0], max(s[1], f), s[2] + 1, max(s[3], p), s[4] + p, s[5] + n, s[6] + a, s[7] + b, origin)
        state.update(tuple(int(v) if i in (0, 1, 2, 8) else float(v) for i, v in enumerate(s)))
        last_ms = int(pd.Timestamp(rows[frame_time].iloc[-1]).timestamp() * 1000)
        state.setTimeoutTimestamp(max(last_ms + hang_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=_COLUMNS)

    marked = hits.withWatermark(frame_time, f"{hang_ms} milliseconds")
    return marked.groupBy("capture_id", "bin").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def capture_stream(blocks: DataFrame, settings: S.Settings) -> DataFrame:
    """Emissions of a stream of sample blocks that carry their halo: the batch kernel, then the keyed tracker.

    Where blocks say which is the ``last`` of its capture, the emissions that are still on air at its end come out as well. The watermark is
    the stream's, so captures of one stream should be of the same time; others get streams of their own.
    """
    if "halo" not in blocks.columns:
        raise ValueError("streamed blocks need their halo")
    # A watermark begins at the epoch and what isn't later is dropped, so a capture that starts there is a second late.
    at = F.timestamp_micros(((F.col("start_time") + 1.0 + F.col("frame") / settings.frame_rate) * 1e6).cast("long"))
    return track_stream(detect(blocks, settings, "last" in blocks.columns).withColumn("frame_ts", at), settings)


def session_stream(hits: DataFrame, gap: str, delay: str, frame_time: str = "frame_ts") -> DataFrame:
    """The same runs by the built-in session window, for use without a longest extent."""
    w = hits.withWatermark(frame_time, delay).groupBy("capture_id", "bin", F.session_window(frame_time, gap).alias("w"))
    return w.agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.max("power").alias("peak_power"), F.count("*").alias("detected_frames")).drop("w")


def fan_out(*sinks: Callable[[DataFrame, int], int]) -> Callable[[DataFrame, int], int]:
    """One ``foreachBatch`` function for several sinks: the batch is computed once; a failing sink is logged and skipped. Returns the most that one wrote."""

    def write(batch: DataFrame, batch_id: int) -> int:
        batch.persist()
        try:
            most = 0
            for sink in sinks:
                try:
                    most = max(most, sink(batch, batch_id) or 0)
                except Exception:
                    log.exception("a sink failed on batch %s", batch_id)
            return most
        finally:
            batch.unpersist()

    return write


def null_sink(batch: DataFrame, batch_id: int) -> int:
    """Takes everything and keeps nothing, not even a count; nothing is computed for it."""
    return 0


def table_sink(path: str) -> Callable[[DataFrame, int], int]:
    """A Parquet store with one folder for each batch, so a batch that is repeated replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> int:
        n = batch.count()
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        return n

    return write


def json_sink(path: str) -> Callable[[DataFrame, int], int]:
    def write(batch: DataFrame, batch_id: int) -> int:
        n = batch.count()
        batch.write.mode("overwrite").json(f"{path}/batch={batch_id}")
        return n

    return write


class SocketWriter:
    """``foreach`` writer of event documents to a datagram or stream target: at least once; a failed send drops the connection."""

    def __init__(self, target: tuple[str, str, int], column: str = "event"):
        self.scheme, self.host, self.port = target
        self.column, self.link = column, None

    def open(self, partition_id: int, epoch_id: int) -> bool:
        try:
            if self.scheme == "udp":
                self.link = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
                self.link.setsockopt(socket.IPPROTO_IP, socket.IP_MULTICAST_TTL, 1)
            else:
                self.link = socket.create_connection((self.host, self.port), timeout=5)
                if self.scheme == "tls":
                    import ssl

                    self.link = ssl.create_default_context().wrap_socket(self.link, server_hostname=self.host)
        except OSError:
            log.exception("no connection to %s:%s", self.host, self.port)
            self.link = None
        return True

    def process(self, row) -> None:
        if self.link is None:
            return
        data = row[self.column].encode()
        try:
            if self.scheme == "udp":
                self.link.sendto(data, (self.host, self.port))
            else:
                self.link.sendall(data)
        except OSError:
            log.exception("an event was not sent")
            if self.scheme != "udp":
                self.link = None

    def close(self, error) -> None:
        if self.link is not None:
            self.link.close()
