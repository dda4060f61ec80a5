"""Packing against the tokenizer library, whitening against a brute-force version, and their edge cases."""

import math
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("bandscope.llm")
duckdb = pytest.importorskip("duckdb")
from pyspark.sql import functions as F  # noqa: E402

from bandscope.llm import packing, whitening  # noqa: E402
from bandscope.llm.registry import ORACLE_SQL, QUERIES, tokenizer_file  # noqa: E402

SF = "/root/testdata/sf0.001"
VOCABULARY = tokenizer_file("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_parts_give_the_ids_of_whole_texts(library):
    with open(VOCABULARY, encoding="utf-8") as f:
        encoder = packing.PartIds(f.read())
    rng = random.Random(2)
    alphabet = "abthe  \n\t\r\x0b\x0c\x1c\x85\xa0 'sréÉΣσİ012!?ñ日本語한글가🎉ẹ́ ZA  'll<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|startoftext|><|endoftext|> b", "<|endof text|>", " " * 700, "aaaa" * 500, "I'm you're ' s", "ΑΣ ΑΣΑ", "́ ́a", "x" * 5000]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_stretches_keep_the_text():
    rng = random.Random(3)
    for size in (1, 3, 10):
        text = "".join(rng.choice("ab ") for _ in range(200))
        parts = list(packing.stretches(text, size))
        assert "".join(parts) == text and all(p.endswith(" ") for p in parts[:-1])
    assert list(packing.stretches("x" * 50, 10)) == ["x" * 50]


def test_piece_lengths_are_the_binary_digits():
    for n in range(1, 300):
        lengths = packing.piece_lengths(n, 32)
        assert sum(lengths) == n and all(x <= 32 and x & (x - 1) == 0 for x in lengths)
        assert lengths == sorted(lengths, reverse=True)
        assert len([x for x in lengths if x < 32]) == len({x for x in lengths if x < 32})


def packed_by_hand(rows, library):
    """Every piece of every row: (id, start, length, crc of its ids, ids of the document)."""
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        while at < len(ids):
            size = min(4096, 1 << (len(ids) - at).bit_length() - 1)
            piece = np.array(ids[at : at + size], "<u4").tobytes()
            out.append((doc_id, at, size, zlib.crc32(piece), len(ids)))
            at += size
    return sorted(out, key=str)


EDGES = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "x" * 30_000), (6, "wort und satz " * 40_000), (7, "same text"), (7, "same text"), (None, "no id"), (9, "日本語 🎉 \u0001")]


def test_packing_equals_brute_force(spark, library):
    docs = spark.createDataFrame([(i, t, None, "c", 5) for i, t in EDGES], "doc_id long, text string, ids string, bucket string, length int")
    rows = packing.digests(packing.pack(docs, VOCABULARY)).collect()
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=str) == packed_by_hand(EDGES, library)
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    whole = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = QUERIES["op11_packing"](spark, SF).collect()
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows), key=str) == packed_by_hand(whole, library)
    assert len({r.sequence_id for r in rows}) == len(rows)


def test_packing_of_an_empty_table_and_plan(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = packing.digests(packing.pack(docs, VOCABULARY))
    assert out.collect() == []
    assert "Exchange" not in QUERIES["op11_packing"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        packing.pack(docs, VOCABULARY, limit=100)


def test_buckets_hold_equal_lengths(spark, tmp_path):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string")
    packed = packing.pack(docs, VOCABULARY)
    packing.write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.where("bucket <> length or octet_length(ids) <> 4 * length").count() == 0
    assert back.count() == packed.count()


# whitening


def whitened_by_hand(rows, components=16):
    """(id, component, n, deviation, whitened up to sign, explained) by whole Python numbers and one decomposition."""
    good = [(i, v) for i, v in rows if v is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in good]
    fit = sorted({v for _, v in x})
    n, d = len(fit), len(fit[0])
    sums = [sum(v[k] for v in fit) for k in range(d)]
    centred = np.array([[v[k] - sums[k] / n for k in range(d)] for v in fit])
    cov = centred.T @ centred / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, v in x:
        p = np.array([v[k] - sums[k] / n for k in range(d)]) @ u
        for k in range(min(components, d)):
            out.append((i, k + 1, n, sum((n * v[c] - sums[c]) ** 2 for c in range(d)), abs(p[k]) / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def same(rows, want):
    def key(r):
        return (str(r[0]), r[1], r[3])

    rows, want = sorted(rows, key=key), sorted(want, key=key)
    assert [r[:4] for r in rows] == [w[:4] for w in want]
    assert np.allclose([abs(r[4]) for r in rows], [w[4] for w in want], rtol=1e-6, atol=1e-7)
    assert np.allclose([r[5] for r in rows], [w[5] for w in want], rtol=1e-9)


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    mix = rng.normal(size=(6, 6))
    vectors = [(int(i), [float(np.float32(c)) for c in rng.normal(size=6) @ mix + 40]) for i in range(300)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(100)]  # copies weigh once
    vectors += [(None, vectors[1][1]), (2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] + [0.0] * 5), (2004, [0.0] * 5 + [float("-inf")]), (2005, [])]
    table = spark.createDataFrame([(i, v, 1, 2.0) for i, v in vectors], "vec_id long, embedding array<float>, component int, x double")
    rows = whitening.digests(whitening.whiten(table, components=4)).collect()
    same([(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in rows], whitened_by_hand(vectors, 4))
    assert {type(r.n) for r in rows} == {int} and max(r.identity_error for r in rows) < 1e-9
    short = spark.createDataFrame(vectors[:50] + [(7, [1.0]), (8, [2.0, 3.0])], "vec_id long, embedding array<float>")
    assert whitening.whiten(short).where("vec_id in (7, 8)").count() == 2 * 6  # the two of this id with six entries


def test_whitening_of_the_table(spark):
    vectors = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    rows = QUERIES["op12_whitening"](spark, SF).collect()
    same([(r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in rows], whitened_by_hand(vectors))
    assert {r.identity_error < 1e-8 for r in rows} == {True} and len({r.identity_error for r in rows}) == 1
    assert len(rows) == 16 * len(vectors)
    mine = sorted(map(tuple, QUERIES["whitening_base"](spark, SF).collect()))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert mine == sorted(con.sql(ORACLE_SQL["whitening_base"]).fetchall())


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)] * 2
    flat = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], schema)).where("vec_id = 1").collect()
    assert [(abs(r.whitened) if r.component == 1 else r.whitened, r.explained) for r in sorted(flat, key=lambda r: r.component)] == [(1.0, 1.0), (None, 0.0)]
    huge = whitening.digests(whitening.whiten(spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], schema))).collect()
    assert {r.deviation for r in huge} == {None}


def test_exact_deviations_beyond_64_bits():
    x = np.array([[3 << 40, 5], [1 << 40, 7]], dtype=np.int64)
    sums = (4 << 40, 12)
    assert whitening.deviations(x, 2, sums).to_pylist() == [2 * (1 << 40) * 2 * (1 << 40) // 1 + 4, (2 << 40) ** 2 + 4]


def test_every_pair_is_summed_in_one_aggregation(spark):
    x = spark.createDataFrame([([int(i * k % 7) for k in range(20)],) for i in range(50)], "x array<long>")
    rows = np.array([r.x for r in x.collect()], float)
    centred = rows - rows.mean(axis=0)
    assert np.allclose(whitening.triangle(x, list(rows.mean(axis=0))), centred.T @ centred)
    few, whitening.PAIRS = whitening.PAIRS, 50
    try:
        assert np.allclose(whitening.triangle(x, list(rows.mean(axis=0))), centred.T @ centred)
    finally:
        whitening.PAIRS = few
