"""Packing of documents into training sequences by power-of-two decomposition.

Method. A document's ids, its end mark included, are cut into as many pieces of
``LIMIT`` ids as it holds and then into one piece for each binary digit of the
rest, longest first. Every piece is a sequence of its own whose length is a
power of two, so no sequence crosses documents and none needs padding. Pieces
of equal length form a bucket, from which a training job takes batches of
one shape (``write_buckets``).

The plan is one narrow map over the documents: no shuffle, no state between
rows, and a lost task is computed again alike. A sequence's number counts the
pieces of its input split, so it is the same whenever the same files are read
in the same splits.

Ids come from the public tokenizer library. Its vocabulary drops white space,
so a text is cut at ASCII blanks and each distinct blank-free part is encoded
once and remembered; special tokens and merges never cross a blank.

Defined edge cases: a null or empty text is the end mark alone; a null id stays;
repeated rows are packed once each; texts of any length are packed whole; an
empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_alphabet
from .common import BROADCAST_BYTES, held, slices, texts_of

#: Longest sequence, a power of two.
LIMIT = 4096
#: Id after the last token of a document.
END = 2
#: A text is split in stretches of about this many characters, so a long one never stands in memory as words.
STRETCH = 1 << 20
#: Parts that the library encodes in one call.
CALL = 500
#: Parts in one generation of a Python worker's memory, and the longest that is remembered.
MEMO_PARTS = 300_000
MEMO_PART_CHARS = 64
#: A word of Latin-1 letters before closing marks. The vocabulary lower-cases letters and always cuts between a letter and such a mark.
CLOSED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]*)")


def piece_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Lengths of the pieces of ``n`` ids: whole limits, then the binary digits of the rest from the highest."""
    full, rest = divmod(n, limit)
    return [limit] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut after a blank; a part without blanks is longer."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size) + 1
        if not cut:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class PartIds:
    """Ids of texts as the tokenizer library gives them, by a memory of blank-free parts."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merge = self.tokenizer.model.tokenize
        stand_in = {b: c for c, b in byte_alphabet().items()}
        #: What the model reads for each letter of ``CLOSED``: the stand-ins of its bytes.
        self.letters = {c: "".join(stand_in[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}
        self.memo: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def known(self, part: str) -> bool:
        """Is the part in the memory? If it is in the older generation, it moves on."""
        if part in self.memo:
            return True
        ids = self.older.get(part)
        if ids is None:
            return False
        self.memo[part] = ids
        return True

    def learn(self, parts: set[str]) -> None:
        """Put the ids of distinct parts in the memory.

        Words that differ in case or closing marks alone are encoded once. A word of lower-case letters needs none of the library's
        rules for splitting and goes to its model at once.
        """
        memo, known = self.memo, self.known
        whole, words, closed = set(), set(), []
        for part in parts:
            if known(part):
                continue
            shape = CLOSED.fullmatch(part) if len(part) <= MEMO_PART_CHARS else None
            if shape is None:
                whole.add(part)
                continue
            word, marks = shape[1].lower(), shape[2]
            if not known(word):
                words.add(word)
            if not known(marks):
                whole.add(marks)
            if word != part:
                closed.append((part, word, marks))
        new = list(whole)
        for i in range(0, len(new), CALL):
            some = new[i : i + CALL]
            for part, found in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)):
                memo[part] = array("I", found.ids).tobytes()
        for word in words:
            memo[word] = array("I", [t.id for t in self.merge(word.translate(self.letters))]).tobytes()
        for part, word, marks in closed:
            memo[part] = memo[word] + memo[marks]

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        out = []
        for stretch in stretches(text):
            if len(self.memo) > MEMO_PARTS:
                self.older, self.memo = self.memo, {"": b""}
            parts = stretch.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            new = set(parts).difference(self.memo)
            if new:
                self.learn(new)
            out.append(b"".join(map(self.memo.__getitem__, parts)))
            for part in new:
                if len(part) > MEMO_PART_CHARS:
                    del self.memo[part]
        return b"".join(out)


def _encoder(spec: str) -> PartIds:
    return held("packing", hash(spec), lambda: PartIds(spec))


def pack(docs: DataFrame, vocab_path: str, limit: int = LIMIT, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences of all documents, one row each.

    Returns ``id_col``, ``start`` (long, ids of the document before the piece),
    ``length`` (long, a power of two up to ``limit``), ``ids`` (binary,
    little-endian unsigned 32-bit integers), ``doc_tokens`` (long, the end mark
    included), ``sequence_id`` (long) and ``offset`` (long, always 0, as a piece
    is alone in its sequence). The vocabulary file is read on the driver and broadcast; its
    size is checked.
    """
    if limit < 1 or limit & limit - 1:
        raise ValueError("the limit must be a power of two")
    with open(vocab_path, encoding="utf-8") as f:
        spec = f.read()
    if len(spec) > BROADCAST_BYTES:
        raise ValueError("the vocabulary is too large to broadcast")
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    mark = end.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for part in slices(batches, 1):
            rows, start, length, ids, total = [], [], [], [], []
            for row, text in enumerate(texts_of(part, 1)):
                packed = encoder.encode(text) + mark
                n, at = len(packed) // 4, 0
                for size in piece_lengths(n, limit):
                    rows.append(row)
                    start.append(at)
                    length.append(size)
                    ids.append(packed[4 * at : 4 * (at + size)])
                    total.append(n)
                    at += size
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                names=[id_col, "start", "length", "ids", "doc_tokens"],
            )

    schema = T.StructType(
        [docs.schema[id_col], T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("doc_tokens", T.LongType())]
    )
    pieces = docs.select(id_col, F.col(text_col)).mapInArrow(run, schema)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences in one folder for each length, so that a training job reads batches of one shape."""
    packed.withColumn("bucket", F.col("length")).write.mode("overwrite").partitionBy("bucket").parquet(path)


def digests(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return packed.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
