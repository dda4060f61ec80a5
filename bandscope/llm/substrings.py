"""Exact substring deduplication: words in windows that occur again anywhere.

Suffix automata of reference shards give matching statistics: how long a match
ends at each word, and how often it occurs. Streaming every document past the
automata of the whole corpus would cost documents times shards, so shards are
cut where matches can be:

1. Every window of ``window`` words is owned by its *anchor*, the ``GRAM``-word
   gram of least hash in it, the leftmost of equals. Two equal windows have the
   same anchor at the same offset, so equal windows only need comparing within
   an anchor's group. The windows that one anchor position owns form a run; the
   run's words are a *segment*, in which every window is owned.
2. Segments are counted by hash (partial aggregation, so copies collapse before
   the shuffle). A segment alone in its group has no repeated window and a
   segment that occurs twice has only repeated windows. Different segments of
   one anchor are undecided.
3. The words of undecided segments are dealt to shards by anchor; each shard
   builds its automaton and streams its segments past it. A window is repeated
   where the matching statistic reaches ``window`` and the state of that length
   has two occurrences.
4. Anchors with over ``HOT`` different segments (the edges of a passage that very many
   documents share) would make one shard as large as their group. Their
   undecided windows are counted by a 128-bit hash instead, which spreads them.

Then maximal spans of covered words are removed from each document.

Defined edge cases: null and empty texts have no words; texts shorter than a
window lose none; repeated rows are documents of their own, so all their
windows are repeated; a row without an id is treated like others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_stored, slices, stored

WINDOW = 35
GRAM = 8
HOT = 2_000
#: Words in one shard's automaton, beyond which the next anchor opens another.
SHARD_WORDS = 60_000
MEMO_WORDS = 400_000

_rng = np.random.default_rng(35)
_P = int(_rng.integers(1 << 40, 1 << 62)) | 1
_Q = int(_rng.integers(1 << 40, 1 << 62)) | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # the public splitmix64 constants


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2**64, and their inverses."""
    up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Hashes:
    """Word hashes with a bounded memory, and hashes of runs of words."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def words(self, words: list[bytes]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for x in set(words).difference(memo):
            memo[x] = xxhash.xxh3_64_intdigest(x)
        return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def runs(h: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = _P) -> np.ndarray:
        """A hash of the words from ``start`` to ``end`` for each pair."""
        up, down = powers(base, len(h) + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1], dtype=np.uint64)))
        return mix((sums[end] - sums[start]) * down[start])


def owned_runs(h: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, segment hash, document number, first window and count of windows of each run, for joined documents."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    n = len(h)
    none = np.zeros(0, np.int64)
    if n < window:
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    gram = np.zeros(n - GRAM + 1, np.uint64)
    for i in range(GRAM):
        gram = gram * np.uint64(_Q) + h[i : n - GRAM + 1 + i]
    gram = mix(gram)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    valid = np.flatnonzero(np.arange(n - window + 1) + window <= ends[doc[: n - window + 1]])
    if not len(valid):
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    anchor = valid + sliding_window_view(gram, window - GRAM + 1)[valid].argmin(axis=1)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (np.diff(valid) != 1))))
    lo, at = valid[first], anchor[first]
    count = np.diff(np.append(first, len(valid)))
    segment = Hashes.runs(h, lo, lo + count + window - 1) + mix(((at - lo) * 64 + count).astype(np.uint64))
    return gram[at], segment, doc[lo], lo - begins[doc[lo]], count


class SuffixAutomaton:
    """Suffix automaton of several word sequences, with the number of occurrences of each state."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.times = [-1], [0], [0]
        for s in sequences:
            last = 0
            for w in s:
                last = self._extend(last, w)
                self.times[last] += 1
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.times[self.link[v]] += self.times[v]

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        self.times.append(0)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w: bytes) -> int:
        """The state for the longest of q's strings that p reaches by ``w``."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, p: int, w: bytes) -> int:
        q = self.next[p].get(w)
        if q is not None:  # another sequence has come this way
            return self._split(p, q, w)
        new = self._state(self.length[p] + 1, 0, {})
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, self.next[p][w], w)
        return new

    def repeated(self, s: list[bytes], window: int) -> list[bool]:
        """For each window of ``s``, by its start: does it occur twice or more?"""
        out = []
        v = matched = 0
        for i, w in enumerate(s):
            while v and w not in self.next[v]:
                v = self.link[v]
                matched = self.length[v]
            v = self.next[v].get(w, 0)
            matched = matched + 1 if v else 0
            while v and self.length[self.link[v]] >= window:
                v = self.link[v]
                matched = self.length[v]
            if i + 1 >= window:
                out.append(matched >= window and self.times[v] > 1)
        return out


KEY = ["k1", "k2"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two 64-bit hashes of id and text name a document."""
    return docs.select(F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(7), text_col, id_col).alias("k2"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _anchor_rows(keyed: DataFrame, window: int) -> DataFrame:
    """A row for each document (``akey`` null: words, hash of all words) and for each run of owned windows."""

    def run(batches):
        hashes = Hashes()
        for part in slices(batches, 3, 1 << 20):
            words = [words_of(t) for t in part.column(3).to_pylist()]
            lengths = np.array([len(w) for w in words], dtype=np.int64)
            h = hashes.words([x for w in words for x in w])
            a, s, doc, lo, n = owned_runs(h, lengths, window)
            docs = pa.array(np.concatenate((np.arange(len(words)), doc)))
            k, m = len(words), len(doc)
            null = pa.nulls
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(docs),
                    part.column(1).take(docs),
                    pa.concat_arrays([null(k, pa.int64()), pa.array(a.view(np.int64))]),
                    pa.concat_arrays([null(k, pa.int64()), pa.array(s.view(np.int64))]),
                    pa.concat_arrays([null(k, pa.int32()), pa.array(lo.astype(np.int32))]),
                    pa.array(np.concatenate((lengths, n)), pa.int64()),
                    pa.concat_arrays([part.column(2), null(m, part.column(2).type)]),
                    pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in words] + [None] * m, pa.string()),
                ],
                names=[*KEY, "akey", "skey", "lo", "n", "id", "sha"],
            )

    schema = T.StructType([*T._parse_datatype_string("k1 long, k2 long, akey long, skey long, lo int, n long").fields, T.StructField("id", keyed.schema["id"].dataType), T.StructField("sha", T.StringType())])
    return keyed.mapInArrow(run, schema)


def _segments(work: DataFrame, window: int, hot: bool) -> DataFrame:
    """From documents with their runs: the words of undecided segments, or the hashes of hot segments' windows."""

    def run(batches):
        hashes = Hashes()
        for part in slices(batches, 2, 1 << 20):
            rows: list[tuple] = []
            for k1, k2, text, runs in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                words = words_of(text)
                if not hot:
                    rows += [(r["akey"], k1, k2, r["lo"], r["repeated"], b" ".join(words[r["lo"] : r["lo"] + r["n"] + window - 1]).decode()) for r in runs]
                    continue
                h = hashes.words(words)
                lo = np.concatenate([np.arange(r["lo"], r["lo"] + r["n"]) for r in runs])
                x, y = Hashes.runs(h, lo, lo + window), Hashes.runs(h, lo, lo + window, _Q)
                rows += zip(x.view(np.int64).tolist(), y.view(np.int64).tolist(), [k1] * len(lo), [k2] * len(lo), lo.tolist(), strict=True)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    long, integer, text, flag = pa.int64(), pa.int32(), pa.string(), pa.bool_()
    names, types = (["x", "y", *KEY, "lo"], [long, long, long, long, integer]) if hot else (["akey", *KEY, "lo", "known", "words"], [long, long, long, integer, flag, text])
    schema = "x long, y long, k1 long, k2 long, lo int" if hot else "akey long, k1 long, k2 long, lo int, known boolean, words string"
    wanted = F.filter("runs", lambda r: r["undecided"] & (r["hot"] == hot))
    return work.select(*KEY, "text", wanted.alias("runs")).where(F.size("runs") > 0).mapInArrow(run, schema)


def _by_shard(segments: DataFrame, window: int) -> DataFrame:
    """Repeated windows (k1, k2, lo) of undecided segments, shard by shard."""

    def shards(batches) -> Iterator[list[tuple]]:
        held: list[tuple] = []
        size, anchor = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != anchor and size >= SHARD_WORDS:
                    yield held
                    held, size = [], 0
                anchor = row[0]
                held.append((row[1], row[2], row[3], row[4], row[5].encode().split()))
                size += len(held[-1][-1])
        if held:
            yield held

    def run(batches):
        for shard in shards(batches):
            automaton = SuffixAutomaton([r[-1] for r in shard])
            found = [(k1, k2, lo + i) for k1, k2, lo, known, words in shard if not known for i, again in enumerate(automaton.repeated(words, window)) if again]
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], names=[*KEY, "lo"])

    dealt = segments.repartition("akey").sortWithinPartitions("akey")
    return dealt.mapInArrow(run, "k1 long, k2 long, lo int")


def _removed(work: DataFrame, window: int) -> DataFrame:
    """(k1, k2, n_removed, sha, spans) of documents with repeated windows: ``runs`` wholly repeated and single ones in ``more``."""

    def run(batches):
        for part in slices(batches, 2):
            count, sha, spans = [], [], []
            for text, lo, n, more in zip(*(part.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
                words = words_of(text)
                edge = np.zeros(len(words) + 1, np.int64)
                start = np.array([*lo, *(more or ())], np.int64)
                own = np.array([*n, *([1] * len(more or ()))], np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + own + (window - 1), -1)
                covered = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])))).reshape(-1, 2)
                count.append(int(covered.sum()))
                sha.append(hashlib.sha256(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c])).hexdigest())
                spans.append([{"start": int(a), "end": int(b)} for a, b in turns])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, kind)], names=[*KEY, "n_removed", "kept", "spans"])

    whole = work.withColumn("runs", F.filter("runs", lambda r: r["repeated"])).where((F.size("runs") > 0) | F.col("more").isNotNull())
    return whole.select(*KEY, "text", F.col("runs.lo").alias("lo"), F.col("runs.n").alias("n"), "more").mapInArrow(run, "k1 long, k2 long, n_removed long, kept string, spans array<struct<start: long, end: long>>")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """For each row: id, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words, joined by one space) and ``spans``.

    ``spans`` are the maximal runs of removed words, counted in words. A window has at least ``GRAM`` words and at most 64.
    """
    if not GRAM <= window <= 64:
        raise ValueError("the window must have 8 to 64 words")
    keyed = _keyed(docs, id_col, text_col)
    rows = stored(_anchor_rows(keyed, window))
    runs = rows.where("akey is not null").select(*KEY, "akey", "skey", "lo", "n")

    segments = runs.groupBy("akey", "skey").agg(F.count("*").alias("times"))
    groups = segments.groupBy("akey").agg(F.sum("times").alias("total"), F.count("*").alias("kinds")).where("total > 1")
    groups = stored(groups)
    twice = stored(segments.where("times > 1").select("akey", "skey"))
    near = stored(
        runs.join(groups, "akey")
        .join(twice.select("akey", "skey", F.lit(True).alias("repeated")), ["akey", "skey"], "left")
        .select(*KEY, "akey", "skey", "lo", F.col("n").cast("int").alias("n"), F.coalesce("repeated", F.lit(False)).alias("repeated"), "kinds"),
        groups,
        twice,
    )
    # One copy of a repeated segment stands for all where the anchor has other segments too.
    copy = near.where("repeated and kinds > 1").groupBy("akey", "skey").agg(F.min(F.struct(*KEY, "lo")).alias("c")).select(F.col("c.k1").alias("k1"), F.col("c.k2").alias("k2"), F.col("c.lo").alias("lo"), F.lit(True).alias("stands"))
    told = near.join(copy, [*KEY, "lo"], "left").where("repeated or kinds > 1")
    by_doc = told.groupBy(*KEY).agg(
        F.collect_set(
            F.struct("akey", "lo", "n", "repeated", ((F.col("kinds") > 1) & (~F.col("repeated") | F.col("stands").isNotNull())).alias("undecided"), (F.col("kinds") > hot).alias("hot"))
        ).alias("runs")
    )
    work = stored(keyed.select(*KEY, "text").join(by_doc, KEY).dropDuplicates(KEY), near)

    found = _by_shard(_segments(work, window, False), window)
    windows = stored(_segments(work, window, True))
    again = windows.groupBy("x", "y").agg(F.count("*").alias("times")).where("times > 1").select("x", "y")
    found = found.union(windows.join(again, ["x", "y"], "left_semi").select(*KEY, "lo"))
    more = stored(found.groupBy(*KEY).agg(F.collect_set("lo").alias("more")), windows)
    cut = stored(_removed(work.join(more, KEY, "left"), window), work, more)
    return (
        rows.where("akey is null")
        .select(*KEY, "id", F.col("n").alias("n_words"), "sha")
        .join(cut, KEY, "left")
        .select(F.col("id").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>")).alias("spans"))
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), twice AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE s IN (SELECT s FROM twice)),
kept AS (
  SELECT t.doc_id, string_agg(t.x, ' ' ORDER BY t.p) AS k FROM (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d) t
  ANTI JOIN cut ON cut.doc_id = t.doc_id AND cut.p = t.p GROUP BY t.doc_id
), n AS (SELECT doc_id, count(*) AS c FROM cut GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.c, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.k, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
