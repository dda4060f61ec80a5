"""Event links: receivers that drop, stall or come late lose nothing."""

import socket
import struct
import threading

import pytest
from pyspark.sql import functions as F

from bandscope.streaming import link


class Receiver(threading.Thread):
    """Takes connections; the first ``drops`` of them are reset after some bytes, or closed without a read."""

    def __init__(self, drops: int, port: int = 0):
        super().__init__(daemon=True)
        self.drops, self.taken, self.links = drops, [], 0
        self.door = socket.create_server(("127.0.0.1", port))
        self.port = self.door.getsockname()[1]
        self.start()

    def run(self):
        while True:
            try:
                peer, _ = self.door.accept()
            except OSError:
                return
            self.links += 1
            if self.links <= self.drops:
                peer.recv(40)  # a part of a chunk, then gone
                peer.setsockopt(socket.SOL_SOCKET, socket.SO_LINGER, struct.pack("ii", 1, 0))
                peer.close()
                continue
            data = b""
            while part := peer.recv(65_536):
                data += part
            peer.close()
            self.taken.append(data)

    def events(self) -> set[str]:
        return {x.decode() + ">" for data in self.taken for x in data.split(b">") if x}


def test_pauses_double_up_to_thirty_seconds():
    assert list(link.waits(8)) == [1, 2, 4, 8, 16, 30, 30] and list(link.waits(1)) == []


def test_a_dropped_link_loses_nothing(spark):
    link.register(spark)
    receiver = Receiver(drops=2)
    want = {f"<e{i} text=é>" for i in range(500)}
    df = spark.range(500).select(F.concat(F.lit("<e"), F.col("id").cast("string"), F.lit(" text=é>")).alias("event"), F.col("id").alias("other")).repartition(3)
    df = df.unionByName(spark.createDataFrame([(None, 1)], "event string, other long"))
    df.write.format("event_link").option("url", f"tcp://127.0.0.1:{receiver.port}").option("eventsperlink", 40).mode("append").save()
    assert receiver.events() == want and receiver.links >= 2 + 13


def test_a_stream_waits_for_its_receiver(spark, tmp_path):
    link.register(spark)
    with socket.create_server(("127.0.0.1", 0)) as s:
        port = s.getsockname()[1]  # nobody listens there for now
    spark.range(30).select(F.concat(F.lit("<m"), F.col("id").cast("string"), F.lit(">")).alias("event")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event string").parquet(str(tmp_path / "in"))
    late = []
    timer = threading.Timer(2.0, lambda: late.append(Receiver(drops=1, port=port)))
    timer.start()
    q = stream.writeStream.format("event_link").option("url", f"tcp://127.0.0.1:{port}").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start()
    assert q.awaitTermination(90) and q.exception() is None
    assert late[0].events() == {f"<m{i}>" for i in range(30)}


def test_no_receiver_is_an_error(spark):
    link.register(spark)
    with socket.create_server(("127.0.0.1", 0)) as s:
        port = s.getsockname()[1]
    df = spark.createDataFrame([("<x>",)], "event string")
    with pytest.raises(Exception, match="refused|Connection"):
        df.write.format("event_link").option("url", f"tcp://127.0.0.1:{port}").option("attempts", 1).mode("append").save()
    with pytest.raises(Exception, match="url"):
        df.write.format("event_link").mode("append").save()


def test_datagrams(spark):
    link.register(spark)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(10)
        spark.createDataFrame([("<a>",), ("<b>",)], "event string").write.format("event_link").option("url", f"udp://127.0.0.1:{s.getsockname()[1]}").mode("append").save()
        assert {s.recv(100), s.recv(100)} == {b"<a>", b"<b>"}
