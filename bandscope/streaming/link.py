"""Sending event documents over a network link as a data source: ``write.format("event_link")`` and ``writeStream.format("event_link")``.

Delivery is at least once. Events go in chunks; each chunk has its own connection, which is closed in order: the sender says that nothing
more comes and waits until the receiver has closed too. Whatever fails before that (no connection, a dropped link, silence) is tried again
with the whole chunk, after a pause that doubles from one to thirty seconds, and after so many attempts the task fails and Spark
runs it again. So a receiver that is restarted loses nothing and may see an event twice; events carry a name that it can
tell by. Datagrams can't be confirmed and are sent once.
"""

from __future__ import annotations

import logging
import socket
import ssl
import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..sources.store import parsed_target

log = logging.getLogger(__name__)

#: Pauses between attempts in seconds: the first, and the longest.
FIRST_WAIT_S, LONGEST_WAIT_S = 1.0, 30.0


def waits(attempts: int) -> Iterator[float]:
    """The pause after each failed attempt but the last."""
    for k in range(attempts - 1):
        yield min(FIRST_WAIT_S * 2.0**k, LONGEST_WAIT_S)


@dataclass
class Sent(WriterCommitMessage):
    """What one task has sent."""

    events: int
    links: int
    failures: int


class _Link:
    """Sends chunks of events to one target."""

    def __init__(self, options, schema: T.StructType):
        target = parsed_target(options.get("url"))
        if target is None:
            raise ValueError("an event link needs a url")
        self.scheme, self.host, self.port = target
        self.column = schema.fieldNames().index(options.get("column", "event"))
        self.chunk = int(options.get("eventsperlink", 100))
        self.attempts = int(options.get("attempts", 12))
        self.timeout = float(options.get("timeout", 10.0))

    def send(self, events: list[bytes]) -> None:
        """One connection for a chunk, closed in order; raises OSError if the receiver may not have all of it."""
        with socket.create_connection((self.host, self.port), timeout=self.timeout) as link:
            if self.scheme == "tls":
                link = ssl.create_default_context().wrap_socket(link, server_hostname=self.host)
            for event in events:
                link.sendall(event)
            if self.scheme == "tls":
                link = link.unwrap()
            link.shutdown(socket.SHUT_WR)
            while link.recv(4096):
                pass

    def send_until_taken(self, events: list[bytes]) -> int:
        """Try until the receiver has the chunk; returns how often that failed."""
        pauses = waits(self.attempts)
        for failures in range(self.attempts):
            try:
                self.send(events)
                return failures
            except OSError as problem:
                pause = next(pauses, None)
                if pause is None:
                    raise
                log.warning("%s:%s took nothing (%s), again in %s s", self.host, self.port, problem, pause)
                time.sleep(pause)
        raise OSError("no attempts")

    def write(self, rows: Iterator) -> Sent:
        told = Sent(0, 0, 0)
        events = (row[self.column].encode() for row in rows if row[self.column] is not None)
        if self.scheme == "udp":
            with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as link:
                link.setsockopt(socket.IPPROTO_IP, socket.IP_MULTICAST_TTL, 1)
                for event in events:
                    link.sendto(event, (self.host, self.port))
                    told.events += 1
            return told
        while chunk := list(islice(events, self.chunk)):
            told.failures += self.send_until_taken(chunk)
            told.events += len(chunk)
            told.links += 1
        return told


def _report(messages: list[Sent | None], what: str) -> None:
    known = [m for m in messages if m is not None]
    log.info("%s: %d events over %d links after %d failures", what, sum(m.events for m in known), sum(m.links for m in known), sum(m.failures for m in known))


class _Writer(_Link, DataSourceWriter):
    def commit(self, messages) -> None:
        _report(messages, "sent")


class _StreamWriter(_Link, DataSourceStreamWriter):
    def commit(self, messages, batchId: int) -> None:
        _report(messages, f"batch {batchId} sent")

    def abort(self, messages, batchId: int) -> None:
        _report(messages, f"batch {batchId} failed")


class EventLink(DataSource):
    """Options: ``url`` (udp, tcp or tls), ``column`` (``event``), ``eventsperlink`` (100), ``attempts`` (12), ``timeout`` (10 s)."""

    @classmethod
    def name(cls) -> str:
        return "event_link"

    def schema(self) -> T.StructType:
        return T.StructType().add("event", T.StringType())

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options, schema)

    def streamWriter(self, schema, overwrite: bool):
        return _StreamWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLink)
