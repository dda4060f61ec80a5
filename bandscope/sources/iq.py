"""Captured samples: a byte-range data source, decoding, and encoding with a sidecar."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from .. import schema as S

# On-disk sample types and their full scale.
FORMATS = {"cf32": ("<f4", 1.0), "cs16": ("<i2", 32_768.0), "cs8": ("i1", 128.0)}


def block_samples(s: S.Settings, about: int = 262_144) -> int:
    """Samples in a block: whole noise holds, so that detection doesn't depend on where a capture is cut."""
    hold = s.hold_frames * s.decimation
    return max(1, about // hold) * hold


def decode(raw: bytes, form: str) -> np.ndarray:
    """Interleaved components scaled to full scale one; an odd component at the end is dropped."""
    kind, scale = FORMATS[form]
    x = np.frombuffer(raw[: len(raw) // np.dtype(kind).itemsize * np.dtype(kind).itemsize], dtype=kind).astype(np.float32) / np.float32(scale)
    return x[: len(x) // 2 * 2]


def encode(x: np.ndarray, form: str, peak: float | None = None) -> tuple[bytes, float]:
    """Bytes and the peak that integer types were normalised by, that of ``x`` unless given."""
    kind, scale = FORMATS[form]
    flat = np.ascontiguousarray(x.astype(np.complex64)).view(np.float32)
    if form == "cf32":
        return flat.astype(kind).tobytes(), 1.0
    peak = peak or float(np.abs(flat).max(initial=0.0)) or 1.0
    return np.round(flat / peak * (scale - 1)).astype(kind).tobytes(), peak


def _files(path: str):
    """Sizes and times of a capture or of a folder's captures, by any file system that Arrow knows."""
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else where.get_file_info(fs.FileSelector(at))
    return where, [f for f in found if f.type == fs.FileType.File and f.extension in FORMATS]


def _sidecar(where, path: str) -> dict | None:
    """What a sidecar says; None without a usable one."""
    try:
        with where.open_input_stream(path) as side:
            told = json.loads(side.read())
    except (OSError, ValueError):
        return None
    return told if isinstance(told, dict) else None


#: The name of a segment: a capture and the place of its first sample.
_SEGMENT = re.compile(r"(.+)@(\d+)")


@dataclass
class _Piece:
    """A file of a capture: all of it, or the segment that begins at sample ``base``."""

    path: str
    form: str
    capture: str
    base: int
    n: int
    start_time: float
    complete: bool  # the capture has no further samples
    following: str  # the segment after it


@dataclass
class _Range(InputPartition):
    """Samples ``offset`` to ``offset + size`` of a file; ``total`` is the capture's length where it is known to end there for good."""

    piece: _Piece | None
    offset: int
    size: int
    total: int | None


class _Captures:
    """The captures under a path, cut into ranges of blocks."""

    def __init__(self, options):
        self.path, self.form = options["path"], options.get("sampleformat")
        self.rate, self.block = float(options["samplerate"]), int(options["blocksamples"])
        self.per_task = int(options.get("blockspertask", 16))
        self.halo = int(options.get("halosamples", 0))
        if self.form and self.form not in FORMATS:
            raise ValueError(f"unknown sample format {self.form}")

    def found(self) -> list[_Piece]:
        """The files in order. A capture is complete once its sidecar is there, unless that says ``"complete": false``."""
        where, files = _files(self.path)
        out: list[_Piece] = []
        for f in files:
            form = self.form or f.extension
            folder, _, name = f.path.rpartition("/")
            stem = name.rsplit(".", 1)[0]
            part = _SEGMENT.fullmatch(stem)
            capture, base = (part[1], int(part[2])) if part else (stem, 0)
            n = f.size // (2 * np.dtype(FORMATS[form][0]).itemsize)
            side = _sidecar(where, f"{folder}/{capture}.json")
            start = (side or {}).get("start_time")
            if start is None:  # no usable sidecar: the file's own time less its length
                start = (f.mtime.timestamp() if f.mtime else 0.0) - (base + n) / self.rate
            out.append(_Piece(f.path, form, capture, base, n, float(start), side is not None and side.get("complete", True) is not False, ""))
        out.sort(key=lambda p: (p.capture, p.form, p.base))
        for p, q in zip(out, out[1:]):
            if (p.capture, p.form, p.base + p.n) == (q.capture, q.form, q.base):
                p.following, p.complete = q.path, False
        return out

    def cut(self, piece: _Piece, begin: int, end: int, total: int | None) -> list[_Range]:
        """Ranges of whole blocks; blocks are counted from the capture's first sample."""
        first = (piece.base + begin) // self.block * self.block - piece.base
        step = self.block * self.per_task
        return [_Range(piece, max(at, begin), min(at + step, end) - max(at, begin), total) for at in range(first, end, step)]

    def read(self, p: _Range) -> Iterator[pa.RecordBatch]:
        if not p.size:
            return
        from pyarrow import fs

        where = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        piece = p.piece
        size = 2 * np.dtype(FORMATS[piece.form][0]).itemsize
        at = p.offset
        with where.open_input_file(piece.path) as f:
            while at < p.offset + p.size:
                place = piece.base + at
                n = min(self.block - place % self.block, p.offset + p.size - at)
                raw = f.read_at((n + self.halo) * size, at * size)
                if len(raw) < (n + self.halo) * size and piece.following:  # the samples that follow are in the next segment
                    with where.open_input_file(piece.following) as g:
                        raw += g.read_at((n + self.halo) * size - len(raw), 0)
                whole = decode(raw, piece.form)
                x, after = whole[: 2 * n], whole[2 * n :]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([piece.capture]), pa.array([place // self.block], pa.int64()), pa.array([place], pa.int64()), pa.array([len(x) // 2], pa.int32()), pa.array([piece.start_time]),
                        *(pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for v in (x, after)), pa.array([place + n == p.total]),
                    ],
                    names=["capture_id", "block_idx", "start_sample", "n", "start_time", "iq", "halo", "last"],
                )
                at += n


class _Reader(_Captures, DataSourceReader):
    """Ranges of captures; those that can't hold a wanted block aren't planned and so never opened."""

    low, high, names = 0, None, None

    def partitions(self):
        out = []
        for p in self.found():
            if self.names is not None and p.capture not in self.names:
                continue
            begin = max(-(-max(self.low, 0) // self.block) * self.block, p.base)  # blocks start at multiples of their size
            end = p.base + p.n if self.high is None else min(p.base + p.n, (self.high // self.block + 1) * self.block)
            if begin < end:
                out += self.cut(p, begin - p.base, end - p.base, None if p.following else p.base + p.n)
        return out or [_Range(None, 0, 0, None)]


class _PrunedReader(_Reader):
    """Takes bounds of ``start_sample`` and ``block_idx`` and names of captures from the query's filters. Spark applies them as well."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name == "capture_id" and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.names = own if self.names is None else self.names & own
            elif name in ("start_sample", "block_idx") and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                unit = 1 if name == "start_sample" else self.block
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.low = max(self.low, f.value * unit + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    high = f.value * unit - isinstance(f, LessThan)
                    self.high = high if self.high is None else min(self.high, high)
            yield f


class _StreamReader(_Captures, DataSourceStreamReader):
    """Captures that grow. The offset is how many samples of each file have been handed out.

    A block is handed out when its samples and those that follow it are there, the last one when the capture is complete.
    """

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        def ready(p: _Piece) -> int:
            if p.complete or p.following:
                return p.n
            return max(0, (p.base + p.n - self.halo) // self.block * self.block - p.base)

        return {p.path: ready(p) for p in self.found()}

    def partitions(self, start: dict, end: dict):
        out = []
        for p in self.found():
            a, b = start.get(p.path, 0), end.get(p.path, 0)
            if b > a:
                out += self.cut(p, a, b, p.base + p.n if p.complete and b == p.n else None)
        return out or [_Range(None, 0, 0, None)]


@dataclass
class _Written(WriterCommitMessage):
    """Segments of one task: temporary and final path, and the start time of each capture."""

    files: list[tuple[str, str]]
    captures: dict[str, float]


class _SegmentWriter(DataSourceArrowWriter):
    """Writes runs of consecutive blocks as segments, under temporary names until all tasks are done."""

    def __init__(self, options):
        self.path, self.form = options["path"].rstrip("/"), options.get("sampleformat", "cf32")
        if self.form not in FORMATS:
            raise ValueError(f"unknown sample format {self.form}")
        self.peak = float(options.get("peak", 0.0)) or None
        self.longest = int(options.get("segmentsamples", 1 << 28))
        self.side = json.loads(options.get("sidecar", "{}"))
        self.job = uuid.uuid4().hex

    def _place(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        where, folder = self._place()
        where.create_dir(folder)
        out, capture, upto, begun, sink = _Written([], {}), None, None, 0, None
        try:
            for batch in batches:
                for name, start, time, iq in zip(*(batch.column(c) for c in ("capture_id", "start_sample", "start_time", "iq")), strict=True):
                    x = np.asarray(iq.values, np.float32).view(np.complex64)
                    name, start = name.as_py(), start.as_py()
                    if name != capture or start != upto or start - begun >= self.longest:
                        if sink is not None:
                            sink.close()
                        final = f"{folder}/{name}@{start:015d}.{self.form}"
                        out.files.append((f"{final}.{self.job}.{uuid.uuid4().hex}", final))
                        sink, capture, begun = where.open_output_stream(out.files[-1][0]), name, start
                        out.captures.setdefault(name, time.as_py())
                    sink.write(encode(x, self.form, self.peak)[0])
                    upto = start + len(x)
        finally:
            if sink is not None:
                sink.close()
        return out

    def commit(self, messages: list[_Written | None]) -> None:
        where, folder = self._place()
        done = [m for m in messages if m is not None]
        for temporary, final in (f for m in done for f in m.files):
            where.move(temporary, final)
        for name, start in {k: v for m in done for k, v in m.captures.items()}.items():
            told = {"format": self.form, "scale_peak": self.peak or 1.0, "start_time": start, **self.side}
            with where.open_output_stream(f"{folder}/{name}.json") as side:
                side.write(json.dumps(told).encode())
        self._clear()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """Delete what tasks that failed or ran twice have left."""
        from pyarrow import fs

        where, folder = self._place()
        for f in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            if self.job in f.base_name:
                where.delete_file(f.path)


class IqSource(DataSource):
    """``spark.read.format("iq")`` and ``spark.readStream.format("iq")``: raw interleaved samples in blocks, split by byte range.

    Each block comes with the samples that follow it (``halo``), so that filters need no exchange between blocks, and with whether it
    ends its capture (``last``). With the option ``pushdown`` filters on place and name decide what is opened; Spark wants
    ``spark.sql.python.filterPushdown.enabled`` set for that.
    """

    @classmethod
    def name(cls) -> str:
        return "iq"

    def schema(self) -> T.StructType:
        samples = T.ArrayType(T.FloatType())
        place = T.StructField("start_sample", T.LongType(), True, {"block_samples": int(self.options.get("blocksamples", 0))})
        out = T.StructType().add("capture_id", T.StringType()).add("block_idx", T.LongType()).add(place).add("n", T.IntegerType()).add("start_time", T.DoubleType())
        return out.add("iq", samples).add("halo", samples).add("last", T.BooleanType())

    def reader(self, schema):
        return (_PrunedReader if self.options.get("pushdown", "false").lower() == "true" else _Reader)(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite: bool):
        return _SegmentWriter(self.options)


AVAILABLE_NOW = "spark.sql.streaming.triggerAvailableNowWrapper.enabled"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def _with_options(reader, settings: S.Settings, form: str | None):
    reader = reader.format("iq").option("samplerate", settings.sample_rate).option("blocksamples", block_samples(settings)).option("halosamples", settings.num_taps)
    return reader.option("sampleformat", form) if form else reader


def read_iq(spark: SparkSession, path: str, settings: S.Settings, form: str | None = None) -> DataFrame:
    """The blocks of one capture or of a folder of them; the format follows the file's extension unless given.

    Where the session allows filters to reach such sources, only the blocks that a query asks for are read.
    """
    _files(path)  # a missing file is an error at once
    spark.dataSource.register(IqSource)
    return _with_options(spark.read, settings, form).option("pushdown", spark.conf.get(PUSHDOWN, "false")).load(path)


def stream_iq(spark: SparkSession, path: str, settings: S.Settings, form: str | None = None) -> DataFrame:
    """The same blocks as a stream of captures that arrive and grow.

    Sets ``AVAILABLE_NOW`` for the session: without it, Spark runs one batch of such a source and ends, where ``availableNow`` should also
    run the batch that lets go what the last data has closed.
    """
    _files(path)
    spark.conf.set(AVAILABLE_NOW, "true")
    spark.dataSource.register(IqSource)
    return _with_options(spark.readStream, settings, form).load(path)


def write_blocks(blocks: DataFrame, folder: str, form: str, segment_samples: int = 1 << 28, **sidecar) -> float:
    """Write captures (``capture_id``, ``start_sample``, ``start_time``, ``iq``) as segments of raw samples with a sidecar each.

    Whole numbers are normalised by the highest component of all blocks, found in one aggregation first and returned. Blocks are dealt by
    place, so each task writes runs of samples; ``read_iq`` reads the segments of a folder as the captures they are of.
    """
    spark = blocks.sparkSession
    spark.dataSource.register(IqSource)
    own = blocks.select("capture_id", "start_sample", "start_time", "iq")
    peak = 1.0 if form == "cf32" else own.agg(F.max(F.greatest(F.array_max("iq"), -F.array_min("iq")))).first()[0] or 1.0
    dealt = own.repartitionByRange("capture_id", "start_sample").sortWithinPartitions("capture_id", "start_sample")
    out = dealt.write.format("iq").option("sampleformat", form).option("peak", float(peak)).option("segmentsamples", segment_samples).option("sidecar", json.dumps(sidecar))
    out.mode("append").save(folder)
    return float(peak)


def read_gaps(reads: DataFrame) -> DataFrame:
    """The reads after which samples are missing, from rows with ``delivered`` (samples, or an error code of at most zero) and ``overflowed``.

    A read that was flagged delivered real samples beside a gap; one that delivered none is a gap of unknown size, and is no
    overflow if it only timed out (zero). ``samples_lost_estimate`` counts overflows: their size isn't known.
    """
    some = F.col("delivered") > 0
    gaps = reads.where((some & F.col("overflowed")) | ~some)
    return gaps.withColumns({"samples_delivered": F.greatest(F.col("delivered"), F.lit(0)).cast("double"), "overflow": some | (F.col("delivered") != 0)}).drop("delivered", "overflowed")


def samples_lost_estimate(gaps: DataFrame, *keys: str) -> DataFrame:
    return gaps.groupBy(*keys).agg(F.count("*").alias("gaps"), F.count_if("overflow").alias("samples_lost_estimate"))


def extract(blocks: DataFrame, start_s: float, duration_s: float, rate: float) -> DataFrame:
    """The blocks that a span touches; an empty result means that the capture doesn't hold it."""
    a, b = int(start_s * rate), int((start_s + duration_s) * rate)
    touched = (blocks.start_sample < b) & (blocks.start_sample + blocks.n > a)
    size = blocks.schema["start_sample"].metadata.get("block_samples")
    # The same bound without the block's own length, which a reader can use.
    return blocks.where(touched & (blocks.start_sample > a - size) if size else touched)


def leading(blocks: DataFrame, samples: int) -> DataFrame:
    """The first ``samples`` samples of each capture; the block they end in is cut, and later blocks aren't read where filters reach the source."""
    part = blocks.where(blocks.start_sample < samples)
    n = F.least(F.col("n"), F.lit(samples) - F.col("start_sample")).cast("int")
    return part.withColumn("iq", F.slice("iq", F.lit(1), 2 * n)).withColumn("n", n).drop("halo", "last")


#: Half the length of the decimation filter, in output samples, and the shape of its Kaiser window.
HALF_TAPS, KAISER_BETA = 10, 9.0


def decimation_filter(factor: int) -> np.ndarray:
    half = HALF_TAPS * factor
    taps = np.sinc(np.arange(-half, half + 1) / factor) * np.kaiser(2 * half + 1, KAISER_BETA)
    return taps / taps.sum()


def extract_span(blocks: DataFrame, start_s: float, duration_s: float, rate: float, target_rate: float, offset_hz: float = 0.0, chunk: int = 16_384) -> DataFrame:
    """A span of one capture at a lower rate: its own mean taken out, shifted down by ``offset_hz``, filtered and decimated.

    Returns (``chunk_idx``, ``start_sample``, ``n``, ``iq`` as interleaved floats) with ``chunk`` output samples each. The mean is one
    aggregation; every block sends each chunk just the samples its filter reaches, so a task holds one chunk. The span starts and
    ends in silence (zeros). Raises if the factor isn't whole, the capture doesn't hold the span, or the blocks are of several captures.
    """
    factor = round(rate / target_rate)
    if factor < 1 or abs(rate / target_rate - factor) > 1e-9:
        raise ValueError(f"{rate} over {target_rate} is not a whole factor")
    first, count = int(start_s * rate), int(duration_s * rate)
    half = HALF_TAPS * factor
    chunks = -(-(-(-count // factor)) // chunk)

    def cut(start, x):
        """The part of a block inside the span, and its place in it."""
        z = np.asarray(x, np.float32).view(np.complex64)
        lo, hi = max(first - start, 0), min(first + count - start, len(z))
        return start + lo - first, z[lo:hi] if hi > lo else z[:0]

    def sums(batches):
        for batch in batches:
            parts = [cut(s, x)[1] for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            totals = [p.sum(dtype=np.complex128) for p in parts]
            yield pa.RecordBatch.from_arrays([pa.array([float(t.real) for t in totals]), pa.array([float(t.imag) for t in totals]), pa.array([len(p) for p in parts], pa.int64())], names=["re", "im", "k"])

    inside = extract(blocks, start_s, duration_s, rate).select("start_sample", "iq")
    total = inside.mapInArrow(sums, "re double, im double, k long").agg(F.sum("re"), F.sum("im"), F.sum("k")).first()
    if not count or total[2] != count:  # too few, or more than one capture
        raise ValueError(f"{duration_s} s from {start_s} s on: the blocks hold {total[2] or 0} samples, not {count} of one capture")
    mean = complex(total[0], total[1]) / total[2]

    def pieces(batches):
        for batch in batches:
            for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, z = cut(s, x)
                if not len(z):
                    continue
                z = ((z - mean) * np.exp(-2j * np.pi * offset_hz / rate * np.arange(at, at + len(z)))).astype(np.complex64)
                span = chunk * factor
                for c in range(max((at - half) // span, 0), min((at + len(z) + half) // span, chunks - 1) + 1):
                    lo, hi = max(c * span - half - at, 0), min((c + 1) * span + half - at, len(z))
                    if hi > lo:
                        part = np.ascontiguousarray(z[lo:hi]).view(np.float32)
                        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([at + lo], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), pa.array(part))], names=["chunk_idx", "at", "iq"])

    taps = decimation_filter(factor)

    def filtered(table: pa.Table) -> pa.Table:
        c = table.column("chunk_idx")[0].as_py()
        base = c * chunk * factor - half
        z = np.zeros(chunk * factor + 2 * half, np.complex64)
        for at, x in zip(table.column("at").to_pylist(), table.column("iq").to_pylist(), strict=True):
            part = np.asarray(x, np.float32).view(np.complex64)
            z[at - base : at - base + len(part)] = part
        n = min(chunk, -(-count // factor) - c * chunk)
        y = np.zeros(n, np.complex128)
        for k, tap in enumerate(taps):  # symmetric, so correlation is convolution
            y += tap * z[k : k + (n - 1) * factor + 1 : factor]
        out = y.astype(np.complex64).view(np.float32)
        return pa.table({"chunk_idx": pa.array([c], pa.int64()), "start_sample": pa.array([c * chunk], pa.int64()), "n": pa.array([n], pa.int32()), "iq": pa.ListArray.from_arrays(pa.array([0, len(out)], pa.int32()), pa.array(out))})

    dealt = inside.mapInArrow(pieces, "chunk_idx long, at long, iq array<float>")
    return dealt.groupBy("chunk_idx").applyInArrow(filtered, "chunk_idx long, start_sample long, n int, iq array<float>")


def write_capture(x: np.ndarray, path: str, form: str, **sidecar) -> dict:
    """Write one short capture and its sidecar from the driver."""
    raw, peak = encode(x, form)
    with open(f"{path}.{form}", "wb") as f:
        f.write(raw)
    told = {"format": form, "scale_peak": peak, **sidecar}
    with open(f"{path}.json", "w", encoding="utf-8") as f:
        json.dump(told, f)
    return told
