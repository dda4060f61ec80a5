"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import delete, new_path

#: Text is handed to Python kernels in slices of about this many bytes, so a
#: worker's memory follows the slice (or one very long text), not the batch.
SLICE_BYTES = 4 << 20

#: Largest object that an operator broadcasts; each has another way beyond it.
BROADCAST_BYTES = 64 << 20

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: What kernels get at a time while a table is written. Rows hold whole texts; Spark's own bound is eight times this, beside the heap, once in
#: the executor and once in its worker, where it becomes strings.
BATCH_BYTES = 8 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: int | str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows whose text is about ``limit`` bytes."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        sizes = pc.binary_length(texts).fill_null(0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n + 64
        yield batch.slice(start)


_held: dict[tuple, object] = {}


def held(owner: str, key: object = None, make=None):
    """What a kernel keeps in its Python worker between tasks, made once for each key.

    Workers serve one operator after the other, so what another ``owner`` has left is let go first; without ``make`` that is all.
    """
    for other in [k for k in _held if k[0] != owner]:
        del _held[other]
    if make is None:
        return None
    if (owner, key) not in _held:
        _held[owner, key] = make()
    return _held[owner, key]


def texts_of(batch: pa.RecordBatch, column: int | str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that ``df`` does not use (case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def hash_share(df: DataFrame, rows: int, *columns: str) -> Column:
    """A condition that about ``rows`` rows of ``df`` fulfil, by a hash of ``columns``; all do if there are no more.

    It takes a count, but no sort, so no task sends more than its share.
    """
    total = df.count()
    if total <= rows:
        return F.lit(True)
    return F.xxhash64(*columns) < F.lit(-(1 << 63) + int(rows / total * (1 << 64)))


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n``; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def stored(df: DataFrame, *after: DataFrame) -> DataFrame:
    """Cut lineage: write the rows once to the shared folder and read them back. Then drop the tables ``after``."""
    spark = df.sparkSession
    path = new_path(spark)
    during = {CLEANUP: "true", BATCH: f"{BATCH_BYTES}b"}  # the plan's shuffle files go as soon as it has been written
    before = {k: spark.conf.get(k, None) for k in during}
    for k, v in during.items():
        spark.conf.set(k, v)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    drop_stored(*after)
    return out


def drop_stored(*tables: DataFrame) -> None:
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            delete(table.sparkSession, path)
