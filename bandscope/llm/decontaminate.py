"""Benchmark decontamination by a prefix-filtered set join.

A *window* is a run of ``width`` consecutive words of a benchmark item (a
shorter item is one window). A window is a set of shingles of three words. To
occur in a document all its shingles must be there, so by the prefix-filter
principle at full containment a single shingle, the rarest, is a sufficient
prefix: only its occurrences are candidates. The parts:

1. count the benchmark's shingles over all documents, in one scan for the whole
   benchmark, into a table of ``RARITY_BITS`` bits that shingles share by a hash
   (partial counts per task, then one small aggregation). A shared count only
   makes a shingle seem more frequent; a window with a count of zero cannot occur;
2. order each window's shingles by rarity and index the window under the first;
3. scan the documents; at each prefix occurrence apply the positional bound
   (the window must start at or after the first word) and the length bound
   (it must end at or before the last), then verify all its words exactly.

The benchmark is split into blocks of about ``BLOCK_BYTES`` of text, and an item of over
``PART_BYTES`` into parts that overlap by a window less a word, so a long item lies in
many blocks and no window is lost. A block's words are
numbered, its windows are places in one array of numbers, and the documents pass
by it in a map without a shuffle; its pickled size is checked before it is
broadcast. With several blocks, ``scan_blocks`` of them share a scan, which writes the hits alone (a key, runs of
words and item numbers, for documents that have any); they are grouped by the
key, a 128-bit hash of id and text, and joined to the documents once. The
documents themselves are never rewritten, and copies share one row of hits, so
hot keys do not matter.

Defined edge cases: null or empty texts and texts without words have no words
and no hits; items without words have no windows; an item without an id makes
hits but is not listed; repeated items count once by id; repeated documents
give repeated rows; items of any length are searched whole. What can't be split is a word: one of
about 50 MB in the benchmark makes a block too large to broadcast, which raises.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, delete, fresh, held, new_path, slices, stored

WIDTH = 10
SHINGLE = 3
#: Benchmark text in one block, in bytes.
BLOCK_BYTES = 4 << 20
#: Longer items are dealt to blocks in parts of about so many bytes, so that blocks differ little in size.
PART_BYTES = 64 << 10
#: Blocks that documents pass by in one scan. Every worker holds them all, each of at most ``BROADCAST_BYTES``.
SCAN_BLOCKS = 1
RARITY_BITS = 22
#: Candidates verified at once.
VERIFY = 1 << 18
MEMO_WORDS = 400_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of digits, a-z and everything beyond ASCII."""
    return text.encode().translate(_FOLD).split() if text else []


class Hashes:
    """Word hashes with a bounded memory."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for x in set(words).difference(memo):
            memo[x] = xxhash.xxh3_64_intdigest(x)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def rarity_places(h: np.ndarray, size: int) -> np.ndarray:
    """The place in the rarity table of the shingle of ``size`` words that begins at each word."""
    n = max(0, len(h) - size + 1)
    code = np.full(n, size, np.uint64)
    for i in range(size):
        code = (code ^ h[i : i + n]) * _ODD
        code ^= code >> np.uint64(29)
    return ((code * _ODD) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def sizes_of(lengths: np.ndarray, width: int) -> list[int]:
    """The sizes of shingles that items of these lengths need: shorter ones for items of one or two words."""
    return sorted({int(min(SHINGLE, width, n)) for n in np.unique(lengths) if n})


class Block:
    """Some items: their words as numbers, end to end, and where items begin."""

    def __init__(self, items: list[tuple[str | None, str | None]], width: int):
        own = [(item, words_of(text)) for item, text in items]
        own = [(item, w) for item, w in own if w]
        self.width = width
        self.items = [item for item, _ in own]
        self.lengths = np.array([len(w) for _, w in own], np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.lengths)))[:-1].astype(np.int64)
        flat = [x for _, w in own for x in w]
        self.number: dict[bytes, int] = {}
        self.words = np.array([self.number.setdefault(x, len(self.number)) for x in flat], np.int32)
        self.flat = flat

    def places(self, hashes: Hashes) -> np.ndarray:
        """The places in the rarity table of all shingles; those over an item's end are harmless."""
        h = hashes.of(self.flat)
        return np.unique(np.concatenate([np.zeros(0, np.int64), *(rarity_places(h, k) for k in sizes_of(self.lengths, self.width))]))

    def index(self, hashes: Hashes, rarity: np.ndarray) -> PrefixIndex:
        return PrefixIndex(self, hashes.of(self.flat), rarity)


class PrefixIndex:
    """Windows under their rarest shingle, in arrays. Words are numbers and a shingle of numbers is one number, so nothing here is approximate."""

    def __init__(self, block: Block, h: np.ndarray, rarity: np.ndarray):
        self.number, self.items = block.number, block.items
        self.base = len(block.number) + 1
        if self.base >= 1 << 21:
            raise ValueError("too many words in one block")
        self.parts: list[tuple] = []  # for each length of windows: length, shingle size, prefix keys, their offsets, window starts, items of windows
        item_of = np.repeat(np.arange(len(block.lengths)), block.lengths)
        span = np.minimum(block.lengths, block.width)
        for length in np.unique(span):
            mine = span[item_of] == length
            start = np.flatnonzero(mine & (np.arange(len(item_of)) + length <= (block.begin + block.lengths)[item_of]))
            if not len(start):
                continue
            size = int(min(SHINGLE, length))
            count, keys = rarity[rarity_places(h, size)], self.keys(block.words, size)
            shingles = start[:, None] + np.arange(length - size + 1)
            rank = count[shingles]
            at = rank.argmin(axis=1)
            possible = np.flatnonzero(rank[np.arange(len(start)), at] > 0)
            start, at = start[possible], at[possible]
            # Windows of the same words are one, with several items.
            rows = np.ascontiguousarray(block.words[start[:, None] + np.arange(length)])
            one, which = _distinct(rows)
            pairs = np.unique(np.stack([which, item_of[start]]), axis=1) if len(start) else np.zeros((2, 0), np.int64)
            key = keys[start[one] + at[one]]
            order = np.argsort(key, kind="stable")
            place = np.empty(len(one), np.int64)
            place[order] = np.arange(len(one))
            pairs = pairs[:, np.argsort(place[pairs[0]], kind="stable")]
            owners = np.searchsorted(place[pairs[0]], np.arange(len(one) + 1)).astype(np.int32)
            self.parts.append((int(length), size, key[order], at[one][order].astype(np.int16), rows[one][order] if len(start) else rows, owners, pairs[1].astype(np.int32)))

    def keys(self, words: np.ndarray, size: int) -> np.ndarray:
        """The shingle that begins at each word as a number, -1 where it holds an unknown word."""
        n = max(0, len(words) - size + 1)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for i in range(size):
            w = words[i : i + n]
            out = out * self.base + w
            known &= w >= 0
        return np.where(known, out, -1)

    def scan(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, list[int]]]:
        """For each document the marks of hit words and the numbers of items with an occurring window."""
        lengths = np.array([len(w) for w in texts], np.int64)
        ends = np.cumsum(lengths)
        number = self.number
        words = np.fromiter((number.get(x, -1) for w in texts for x in w), np.int32, int(lengths.sum()))
        edge = np.zeros(len(words) + 1, np.int64)
        found: list[set[int]] = [set() for _ in texts]
        for length, size, key, at, rows, owners, items in self.parts:
            if len(words) < length or not len(key):
                continue
            own = self.keys(words, size)
            seen = np.flatnonzero(own >= 0)
            low = np.searchsorted(key, own[seen], side="left")
            high = np.searchsorted(key, own[seen], side="right")
            some = np.flatnonzero(high > low)
            seen, low, high = seen[some], low[some], high[some]
            total = np.concatenate(([0], np.cumsum(high - low)))
            for first, last in _cuts(total):
                n = (high - low)[first:last]
                window = np.repeat(low[first:last], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                begin = np.repeat(seen[first:last], n) - at[window]
                doc = np.searchsorted(ends, np.repeat(seen[first:last], n), side="right")
                fits = (begin >= (ends - lengths)[doc]) & (begin + length <= ends[doc])
                window, begin, doc = window[fits], begin[fits], doc[fits]
                same = (words[begin[:, None] + np.arange(length)] == rows[window]).all(axis=1)
                window, begin, doc = window[same], begin[same], doc[same]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + length, -1)
                for d, w in set(zip(doc.tolist(), window.tolist(), strict=True)):
                    found[d].update(items[owners[w] : owners[w + 1]].tolist())
        hit = np.cumsum(edge)[:-1] > 0
        return [(hit[e - n : e], sorted(f)) for e, n, f in zip(ends.tolist(), lengths.tolist(), found, strict=True)]


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal rows, and the set of each row: by a hash, compared in full."""
    code = np.zeros(len(rows), np.uint64)
    for c in rows.T:
        code = (code ^ c.astype(np.uint64)) * _ODD
        code ^= code >> np.uint64(29)
    _, one, which = np.unique(code, return_index=True, return_inverse=True)
    which = which.ravel()
    if not (rows == rows[one[which]]).all():  # different rows of one hash
        _, one, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return one, which.ravel()


def _cuts(total: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of prefix occurrences of about ``VERIFY`` candidates, from the candidates before each."""
    first, n = 0, len(total) - 1
    while first < n:
        last = int(max(first + 1, np.searchsorted(total, total[first] + VERIFY, side="right") - 1))
        yield first, last
        first = last


def parts_of(text: str | None, width: int, part_bytes: int) -> list[str | None]:
    """A long item's text in parts that together have its windows and no others: each begins with a window that no other part begins with."""
    if text is None or len(text.encode()) <= part_bytes:
        return [text]
    words = words_of(text)
    ends = np.cumsum([len(x) + 1 for x in words])
    out, start = [], 0
    while start <= len(words) - width:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + part_bytes)))  # windows that start before it are this part's
        out.append(b" ".join(words[start : stop + width - 1]).decode())
        start = stop
    return out or [b" ".join(words).decode()]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int, width: int, part_bytes: int) -> tuple[list[DataFrame], str | None]:
    """The benchmark as frames of about ``block_bytes`` of text each, and the folder they are in if there are several."""
    size = benchmark.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    if n == 1:
        return [items], None

    def run(batches):
        held("decontaminate")
        for batch in slices(batches, 1):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = parts_of(text, width, part_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array(parts, pa.string())], names=["item", "text"])

    path = new_path(benchmark.sparkSession)
    dealt = items.mapInArrow(run, "item string, text string").withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    dealt.write.mode("overwrite").partitionBy("block").parquet(path)
    every = benchmark.sparkSession.read.schema("item string, text string, block long").parquet(path)
    return [every.where(F.col("block") == b).select("item", "text") for b in range(n)], path


def _rarity(docs: DataFrame, text_col: str, places: np.ndarray, sizes: list[int]) -> np.ndarray:
    """The rarity table: how often shingles at each wanted place occur in all documents."""
    wanted = np.zeros(1 << RARITY_BITS, bool)
    wanted[places] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches):
        held("decontaminate")
        mine = np.unpackbits(shared.value).astype(bool)
        counts, hashes = np.zeros(1 << RARITY_BITS, np.int64), Hashes()
        for part in slices(batches, 0):
            words = [words_of(t) for t in part.column(0).to_pylist()]
            h = hashes.of([x for w in words for x in w])
            doc = np.repeat(np.arange(len(words)), [len(w) for w in words])
            for size in sizes:
                at = rarity_places(h, size)
                at = at[(doc[: len(at)] == doc[size - 1 :]) & mine[at]] if len(at) else at
                np.add.at(counts, at, 1)
        i = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(counts[i])], names=["i", "n"])

    out = np.zeros(1 << RARITY_BITS, np.int64)
    if len(places):
        table = docs.select(text_col).mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # at most the table's places
        out[table["i"].to_numpy()] = table["n"].to_numpy()
    return out


def _indexes(docs: DataFrame, text_col: str, frames: list[DataFrame], width: int) -> Iterator[PrefixIndex]:
    """The index of each block. The rarity of all blocks' shingles is counted in one scan of the documents."""
    hashes = Hashes()
    load = lambda frame: Block([(r.item, r.text) for r in frame.collect()], width)
    only = load(frames[0]) if len(frames) == 1 else None
    places, sizes = np.zeros(0, np.int64), set()
    for frame in frames:
        block = only or load(frame)
        places = np.union1d(places, block.places(hashes))
        sizes.update(sizes_of(block.lengths, width))
    rarity = _rarity(docs, text_col, places, sorted(sizes))
    for frame in frames:
        yield (only or load(frame)).index(hashes, rarity)


def find_overlaps(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
    only_clean: bool = False,
    scan_blocks: int = SCAN_BLOCKS,
) -> DataFrame:
    """Benchmark windows in every document.

    Returns the columns ``keep`` (the id by default) and ``n_words`` (long),
    ``n_hit`` (long, words inside any occurrence), ``items`` (sorted array of
    item ids as strings) and ``spans`` (maximal runs of hit words: start and
    exclusive end, counted in words). With ``only_clean`` the columns ``keep`` of
    the rows without a hit are returned and nothing else. ``scan_blocks`` saves scans
    of the documents where workers have the memory for so many blocks. The rarity scan and, with
    several blocks, all others run at once; the rest when the result is read.
    """
    keep = [id_col] if keep is None else keep
    context = docs.sparkSession.sparkContext

    def shared(index: PrefixIndex):
        if len(pickle.dumps(index, protocol=pickle.HIGHEST_PROTOCOL)) > BROADCAST_BYTES:
            raise ValueError("a block is too large to broadcast; lower block_bytes")
        return context.broadcast(index)

    frames, path = _blocks(benchmark, item_id_col, item_text_col, block_bytes, width, min(PART_BYTES, block_bytes))
    indexes = map(shared, _indexes(docs, text_col, frames, width))
    if path is None:
        return _pass(docs, next(indexes), text_col, keep, only_clean)
    names = fresh(docs, "k1__", "k2__", "runs__", "items__", "n__")
    k1, k2, runs, items, n = names
    key = [F.xxhash64(id_col, text_col).alias(k1), F.xxhash64(F.lit(7), text_col, id_col).alias(k2)]
    keyed = docs.select(*key, F.col(text_col).alias("text"))
    parts = []
    while some := list(islice(indexes, scan_blocks)):
        parts.append(stored(_hits(keyed, some, k1, k2)))
        for index in some:
            index.unpersist()
    delete(docs.sparkSession, path)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # A document's copies have equal hits: one row a block and key, whatever their number.
    hits = stored(every.groupBy(k1, k2).agg(F.flatten(F.collect_set("runs")).alias(runs), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias(items)), *parts)
    told = docs.select(*dict.fromkeys([*keep]), *key, *([] if only_clean else [_word_count(F.col(text_col)).alias(n)]))
    if only_clean:
        return told.join(hits, [k1, k2], "left_anti").select(*keep)
    return told.join(hits, [k1, k2], "left").select(*keep, F.col(n).alias("n_words"), *_united(F.coalesce(runs, F.array().cast("array<struct<start: bigint, end: bigint>>")), F.coalesce(items, F.array().cast("array<string>"))))


def _word_count(text):
    """The same words as ``words_of``, counted."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")).cast("long")


def _united(runs, items) -> list:
    """Hit words, items and spans of runs of several blocks: overlapping and touching runs become one."""
    struct = "array<struct<start: bigint, end: bigint>>"

    def step(acc, r):
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["end"] >= r["start"]), joined).otherwise(F.array_append(acc, r))

    spans = F.aggregate(F.sort_array(runs), F.array().cast(struct), step)
    n_hit = F.aggregate(spans, F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["start"])
    return [n_hit.alias("n_hit"), items.alias("items"), spans.alias("spans")]


RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _runs(hit: np.ndarray) -> list[dict[str, int]]:
    turns = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])))).reshape(-1, 2)
    return [{"start": a, "end": b} for a, b in turns.tolist()]


def _told(index: PrefixIndex, words: list[list[bytes]]) -> list[tuple[int, np.ndarray, list[str]]]:
    """Number of words, marks and item ids of each text."""
    return [(len(w), hit, sorted({index.items[i] for i in found} - {None})) for w, (hit, found) in zip(words, index.scan(words), strict=True)]


def _hits(keyed: DataFrame, indexes: list, k1: str, k2: str) -> DataFrame:
    """Key, runs and items of the documents that some blocks hit, a row for each block."""

    def run(batches):
        held("decontaminate")
        for part in slices(batches, 2):
            words = [words_of(t) for t in part.column(2).to_pylist()]
            for index in indexes:
                rows = _told(index.value, words)
                some = [i for i, r in enumerate(rows) if r[1].any()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(some, pa.int32())), part.column(1).take(pa.array(some, pa.int32())), pa.array([_runs(rows[i][1]) for i in some], _SPANS), pa.array([rows[i][2] for i in some], pa.list_(pa.string()))],
                    names=[k1, k2, "runs", "items"],
                )

    return keyed.mapInArrow(run, f"`{k1}` long, `{k2}` long, runs array<struct<start: long, end: long>>, items array<string>")


def _pass(docs: DataFrame, index, text_col: str, keep: list[str], only_clean: bool) -> DataFrame:
    """Scan the documents past the only block."""
    out = T.StructType([*(docs.schema[c] for c in keep), *(() if only_clean else T._parse_datatype_string(RESULT).fields)])
    wanted = list(dict.fromkeys([*keep, text_col]))
    where, kept = wanted.index(text_col), [wanted.index(c) for c in keep]

    def run(batches):
        held("decontaminate")
        for part in slices(batches, where):
            rows = _told(index.value, [words_of(t) for t in part.column(where).to_pylist()])
            columns = [part.column(i) for i in kept]
            if not only_clean:
                columns += [pa.array([r[0] for r in rows], pa.int64()), pa.array([int(r[1].sum()) for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.string())), pa.array([_runs(r[1]) for r in rows], _SPANS)]
            told = pa.RecordBatch.from_arrays(columns, names=out.names)
            yield told.filter(pa.array([not r[1].any() for r in rows], pa.bool_())) if only_clean else told

    return docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(wanted))).mapInArrow(run, out)


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT item, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM b WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
cand AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM pos, lens WHERE i + n - 1 <= len(w)),
found AS (SELECT c.doc_id, c.i, c.n, win.item FROM cand c JOIN win ON c.n = win.n AND c.s = win.s),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hits.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items, coalesce(its.h, sha256('')) AS items_sha256, coalesce(hits.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
