"""Near-duplicate groups by HyperMinHash.

A document is its set of distinct shingles of ``SIZE`` words. Shingle hashes
fall into ``BUCKETS`` buckets; a register keeps, for the least hash of its
bucket, the count of leading zeros and ``MANTISSA`` bits after the leading one.
An empty bucket copies another one, probed in an order that depends only on the
bucket, so equal sets have equal registers whatever their size. ``BANDS`` bands
of ``ROWS`` registers propose candidates; the share of equal registers, corrected for
accidental collisions, estimates Jaccard; links are confirmed on full sets.
At similarity 0.8 a pair shares no band with probability 5e-6.

Large groups, without all their pairs:

1. Documents with equal sets collapse into one class (partial aggregation).
2. In each band group only links to one leader, which differs from band to band,
   are candidates: as many as rows. Confirmed links give components.
3. Band groups that still hold several components are closed, so that no pair of
   different components that shares a band stays unchecked: by prefix filter. Of
   all rows of such groups, shingles are ordered from rare to common; to reach the
   threshold two sets must share one among the first of each (all but the
   least overlap, plus one), early enough in both for the rest to suffice. Heavily edited copies have a prefix of shingles of
   their own and so no candidates, where comparing them with the group would take all pairs.
   Rows already connected to each other are never compared.
4. Components of all links.

Intermediate tables go to the checkpoint folder; links, components and
signatures never come to the driver. Joins use plain keys, so that the adaptive
execution can split those that are hot.

Defined edge cases: null and empty texts and texts without words have no
shingles and link with nothing; fewer words than a shingle make one shingle;
rows that share an id are one node of the graph; a row without an id is alone
(component null, kept); repeated rows give repeated results, all with the
smallest id of their group.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, held, slices, stored

SIZE = 5
PERCENT = 80
ROWS, BANDS = 6, 40
BUCKETS = ROWS * BANDS
MANTISSA = 10
#: Candidates are verified from this far below the threshold: over four standard errors of the estimate.
SLACK = 0.12
MEMO_WORDS = 400_000
_PROBES = 512
#: Smaller sets have too few distinct registers for an estimate; they are verified at once.
SMALL = 24

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # the public splitmix64 constants
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_rng = np.random.default_rng(20)
_MIX = _rng.integers(1, 1 << 62, size=16, dtype=np.uint64) | np.uint64(1)
_PROBE = _rng.integers(0, BUCKETS, size=(_PROBES, BUCKETS))
_EDGES = np.array([-(-(k << 64) // BUCKETS) for k in range(BUCKETS)], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_LOWER).split() if text else []


def shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    w = words_of(text)
    if not w:
        return set()
    return set(zip(*(w[i:] for i in range(size)))) if len(w) >= size else {tuple(w)}


class Hasher:
    """Distinct shingle hashes of texts, with a bounded memory of word hashes."""

    def __init__(self, size: int):
        self.size = size
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        w = words_of(text)
        if not w:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for x in set(w).difference(memo):
            memo[x] = xxhash.xxh3_64_intdigest(x)
        h = np.fromiter(map(memo.__getitem__, w), np.uint64, len(w))
        n = min(self.size, len(h))
        total = np.full(len(h) - n + 1, n, dtype=np.uint64)
        for i in range(n):
            total = total * _MIX[i] + h[i : len(h) - n + 1 + i]
        return np.unique(mix(total))


def registers(hashes: np.ndarray) -> np.ndarray:
    """Compressed registers of a sorted, non-empty array of distinct hashes."""
    at = np.searchsorted(hashes, _EDGES)
    filled = at < np.append(at[1:], len(hashes))
    least = hashes[np.minimum(at, len(hashes) - 1)] * np.uint64(BUCKETS)  # position within the bucket
    part, power = np.frexp(least.astype(np.float64) + 1.0)
    reg = ((64 - np.minimum(power, 64)) << MANTISSA) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    source = np.arange(BUCKETS)
    empty = np.flatnonzero(~filled)
    for t in range(_PROBES):
        if not len(empty):
            break
        take = _PROBE[t, empty]
        good = filled[take]
        source[empty[good]] = take[good]
        empty = empty[~good]
    if len(empty):
        full = np.flatnonzero(filled)
        source[empty] = full[np.searchsorted(full, _PROBE[0, empty]) % len(full)]
    return reg[source].astype("<u2")


def estimate(equal: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard from counts of equal registers, less the expected accidental collisions (published approximation)."""
    ratio = 4 * n * m / (n + m) ** 2
    accidental = 0.169919487159739 * BUCKETS * 2.0**-MANTISSA * ratio
    return np.clip((equal - accidental) / (BUCKETS - accidental), 0, 1)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """For each row: id, n (set size), h1 and h2 (hashes of the set), regs."""

    def run(batches):
        held("neardup")
        hasher = Hasher(size)
        for part in slices(batches, 1):
            n, h1, h2, regs = [], [], [], []
            for text in part.column(1).to_pylist():
                h = hasher(text)
                n.append(len(h))
                h1.append(int(h.sum(dtype=np.uint64)) - (1 << 63))
                h2.append(int(mix(h * _MIX[9] + _MIX[10]).sum(dtype=np.uint64)) - (1 << 63))
                regs.append(registers(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(regs, pa.binary())], names=["id", "n", "h1", "h2", "regs"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T._parse_datatype_string("n long, h1 long, h2 long, regs binary").fields])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def band_rows(classes: DataFrame) -> DataFrame:
    """(key, id, n), one row for each band of each class."""
    kind = classes.schema["id"].dataType

    def run(batches):
        held("neardup")
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[11], regs.shape[:2]).copy()
            for i in range(ROWS):
                key = mix(key * _MIX[12] + regs[:, :, i] + np.uint64(1))
            times = np.repeat(np.arange(batch.num_rows), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), batch.column(0).take(times), batch.column(1).take(times)], names=["key", "id", "n"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", kind), T.StructField("n", T.LongType())])
    return classes.select("id", "n", "regs").mapInArrow(run, schema)


def _similar(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) whose estimate is near the threshold or above."""
    sig = classes.select("id", "n", "regs")
    both = pairs.join(sig.toDF("a", "na", "ra"), "a").join(sig.toDF("b", "nb", "rb"), "b")

    def run(batches):
        held("neardup")
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype="<u2").reshape(-1, BUCKETS) for i in (3, 5))
            n, m = (batch.column(i).to_numpy().astype(float) for i in (2, 4))
            good = estimate((left == right).sum(axis=1), n, m) >= percent / 100 - SLACK
            good |= np.minimum(n, m) < SMALL
            yield batch.select(["a", "b"]).filter(pa.array(good))

    long = T.StructType([T.StructField("a", pairs.schema["a"].dataType), T.StructField("b", pairs.schema["b"].dataType)])
    return both.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(run, long)


def _confirm(pairs: DataFrame, needed: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) that reach the threshold on their full sets."""
    both = pairs.join(needed.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(needed.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        held("neardup")
        name, own = None, None
        for batch in batches:
            good = []
            for a, ta, tb in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if name != (a, ta):
                    name, own = (a, ta), shingles(ta, size)
                other = shingles(tb, size)
                common = len(own & other)
                good.append(100 * common >= percent * (len(own) + len(other) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    schema = T.StructType([T.StructField(c, pairs.schema[c].dataType) for c in ("a", "b")])
    return both.select("a", "b", "ta", "tb").mapInArrow(run, schema).distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id reachable over links (a, b), for every id that has one.

    Alternating large and small stars: every step lets nodes point to the
    least neighbour they know; the number of steps grows with the logarithm of
    the size. Minima are aggregated before the shuffle, and each step is checkpointed.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = stored(edges)
    before = None
    while True:
        for large in (True, False):
            near = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
            least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            linked = near.join(least, "u")
            if large:
                linked = linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            else:
                linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
            edges = stored(linked.where("u <> v").distinct(), edges)
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.col("m").alias("comp")).union(edges.select(F.col("v").alias("id"), F.col("v").alias("comp"))).distinct().groupBy("id").agg(F.min("comp").alias("comp"))


def _across(grouped: DataFrame, comps: DataFrame, needed: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidates (a, b) in different components among the rows of band groups that hold several, by prefix filter."""
    placed = grouped.where("rows > 2").join(comps, "id", "left").select("key", "id", "n", F.coalesce("comp", "id").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count("*").alias("rows"))
    several = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("rows", "comp")).alias("top")).where("comps > 1").select("key", F.col("top.comp").alias("top"))
    # Rows outside a group's largest component are the ones to compare.
    rows = stored(placed.join(several, "key").groupBy("id", "comp").agg(F.max(F.col("comp") != F.col("top")).alias("minor"), F.max("n").alias("n")))

    def run(batches):
        held("neardup")
        hasher = Hasher(size)
        for part in slices(batches, 4):
            sets = [hasher(t).view(np.int64) for t in part.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(sets, pa.list_(pa.int64()))], names=["id", "comp", "minor", "n", "shingles"])

    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("comp", kind), *T._parse_datatype_string("minor boolean, n long, shingles array<long>").fields])
    sets = stored(rows.join(needed, "id").select("id", "comp", "minor", "n", "text").mapInArrow(run, schema))
    tokens = sets.select("id", "comp", "minor", "n", F.explode("shingles").alias("t"))
    # A shingle of one row can't be shared; such ones only take places at the front.
    shared = tokens.groupBy("t").agg(F.count("*").alias("c")).where("c > 1")
    ordered = tokens.join(shared, "t").groupBy("id", "comp", "minor", "n").agg(F.array_sort(F.collect_list(F.struct("c", "t"))).alias("ts"))
    least = F.ceil(F.col("n") * percent / 100)
    free = F.col("n") - least + 1 - (F.col("n") - F.size("ts"))
    front = ordered.where(free > 0).select("id", "comp", "minor", "n", (F.col("n") - F.size("ts")).alias("alone"), F.posexplode(F.slice("ts", F.lit(1), free.cast("int"))).alias("i", "x"))
    prefix = stored(front.select("id", "comp", "minor", "n", (F.col("alone") + F.col("i") + 1).alias("p"), F.col("x.t").alias("t")), sets)
    return (
        _meetings(prefix, percent)
        .where("comp <> cx and (not minor or x < id)")
        .select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b"))
        .distinct()
    )


def _meetings(prefix: DataFrame, percent: int) -> DataFrame:
    """Rows of ``prefix`` (id, comp, minor, n, p, t) with the minor ones (x, cx, nx, px) that share a shingle and may be similar.

    Whether two rows may be is told by their lengths and by where the shingle stands in both: the length bound, and the positional bound,
    by which what follows in both must suffice for the overlap. So that is decided for the pairs of (length, place) under each shingle, of
    which there are few however many rows share it, and only pairs that pass are expanded to rows. The pages of one template, alike
    but not alike enough, share shingles without ever being paired.
    """
    minor = prefix.where("minor").select("t", F.col("id").alias("x"), F.col("comp").alias("cx"), F.col("n").alias("nx"), F.col("p").alias("px"))
    bounds = f"100 * least(n, nx) >= {percent} * greatest(n, nx) and (1 + least(n - p, nx - px)) * {100 + percent} >= {percent} * (n + nx)"
    cells = minor.select("t", "nx", "px").distinct().join(prefix.select("t", "n", "p").distinct(), "t").where(bounds)
    return minor.join(cells, ["t", "nx", "px"]).join(prefix, ["t", "n", "p"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """Group all rows: (id, n_shingles, component_id, kept), one row for each row of ``docs``."""
    signed = stored(signatures(docs, id_col, text_col, size))
    classes = stored(signed.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("id"), F.first("regs").alias("regs")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")

    # Rows of band groups of two or more, and the links of each row to its groups' leaders.
    bands = band_rows(classes)
    leaders = bands.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.struct(F.xxhash64("key", "id").alias("order"), F.col("id"), F.col("n"))).alias("lead")).where("rows > 1")
    grouped = stored(bands.join(leaders.select("key", "rows", F.col("lead.id").alias("lead"), F.col("lead.n").alias("size")).hint("merge"), "key"))
    needed = stored(texts.join(grouped.select("id").distinct().hint("merge"), "id", "left_semi"))
    close = lambda left, right: f"100 * least({left}, {right}) >= {percent} * greatest({left}, {right})"
    pairs = stored(grouped.where("id <> lead").where(close("n", "size")).select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct())
    links = stored(_confirm(stored(_similar(pairs, classes, percent)), needed, size, percent))
    comps = stored(components(links))

    more = _across(grouped, comps, needed, size, percent).join(pairs, ["a", "b"], "left_anti")
    added = stored(_confirm(stored(_similar(more, classes, percent)), needed, size, percent), grouped, pairs, needed)
    own = signed.join(classes.select("h1", "h2", "n", F.col("id").alias("class")), ["h1", "h2", "n"], "left")
    # An id of several texts joins their classes.
    alike = own.where("class is not null and class <> id").select(F.col("id").alias("a"), F.col("class").alias("b"))
    same_id = alike.join(signed.groupBy("id").agg(F.count("*").alias("k")).where("k > 1"), F.col("a") == F.col("id"), "left_semi")
    final = components(links.union(added).union(same_id)).select(F.col("id").alias("class"), "comp")
    final = stored(final, links, added, comps)
    return own.join(final, "class", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("comp", "class", "id").alias("component_id"),
        F.coalesce(F.coalesce("comp", "class", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay: of each group the one of the smallest id, and all rows without an id.

    Where several rows share that id, the first by text stays.
    """
    judged = near_duplicates(docs, id_col, text_col, size, percent)
    key, place = fresh(docs, "key__", "place__")
    ids = stored(judged.where(F.col(id_col).isNotNull() & F.col("kept")).select(F.col(id_col).alias(key)).distinct())
    named = docs.where(F.col(id_col).isNotNull())
    # One exchange of the documents: the window works on the join's partitions.
    stay = named.join(ids.hint("merge"), named[id_col] == ids[key], "left_semi")
    first = Window.partitionBy(id_col).orderBy(F.col(text_col).asc_nulls_first())
    one = stay.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return docs.where(F.col(id_col).isNull()).unionByName(one).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, links.b FROM reach JOIN links ON links.a = reach.y),
comp AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(comp.c, d.doc_id) AS component_id, coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""
