"""Long benchmark items, and the logistic map of the toxicity score at its minimum."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

pytest.importorskip("bandscope.llm")

from bandscope.llm import decontaminate, toxicity  # noqa: E402


def test_parts_hold_each_window_once():
    rng = random.Random(3)
    for width in (1, 3, 10):
        for _ in range(300):
            words = [rng.choice(["a", "bb", "cccc", "é"]) + str(i) for i in range(rng.randint(1, 40))]
            parts = decontaminate.parts_of(" ".join(words), width, rng.randint(1, 60))
            cut = [tuple(w[i : i + width]) for p in parts for w in [decontaminate.words_of(p)] for i in range(max(1, len(w) - width + 1))]
            whole = decontaminate.words_of(" ".join(words))
            assert cut == [tuple(whole[i : i + width]) for i in range(max(1, len(whole) - width + 1))]
    assert decontaminate.parts_of(None, 10, 5) == [None] and decontaminate.parts_of("x" * 99, 10, 5) == ["x" * 99]


@pytest.fixture(scope="module")
def long_item(spark, tmp_path_factory):
    """An item of over 20 MB, a short one and one without text."""
    rng = np.random.default_rng(6)
    text = " ".join(f"w{x}" for x in rng.integers(0, 300_000, 3_100_000).tolist())
    assert len(text) > 20_000_000
    path = tmp_path_factory.mktemp("items") / "items.parquet"
    pq.write_table(pa.table({"item_id": [1, 2, 3], "text": [text, "a short item", None]}), path)
    return spark.read.parquet(str(path)), text.split()


def test_an_item_of_20_mb(spark, long_item):
    items, words = long_item
    places = [0, 1_000_000, 2_222_222, len(words) - 15]
    docs = spark.createDataFrame([(i, "x " + " ".join(words[p : p + 15]) + " y") for i, p in enumerate(places)] + [(9, "this is a short item too"), (10, None)], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.find_overlaps(docs, items, scan_blocks=3).collect()}
    assert got == {i: (15, ["1"]) for i in range(4)} | {9: (3, ["2"]), 10: (0, [])}


def test_blocks_share_scans(spark, monkeypatch):
    scans = []
    real = decontaminate._hits
    monkeypatch.setattr(decontaminate, "_hits", lambda keyed, indexes, *names: scans.append(len(indexes)) or real(keyed, indexes, *names))
    docs, items = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    one = decontaminate.digests(decontaminate.find_overlaps(docs, items)).collect()
    many = decontaminate.digests(decontaminate.find_overlaps(docs, items, block_bytes=2_000, scan_blocks=2)).collect()
    assert sorted(one) == sorted(many)
    assert len(scans) > 1 and set(scans[:-1]) == {2} and 1 <= scans[-1] <= 2


def worst(rng, n, share, noise):
    """Summaries that overlap, with labels of which ``share`` are toxic."""
    y = (rng.random(n) < share).astype(float)
    x = rng.normal(size=(n, 3)) * [1.0, 2.0, 0.3] + noise * y[:, None]
    return x, y


@pytest.mark.parametrize("share", [0.05, 0.5, 0.95])
@pytest.mark.parametrize("noise", [0.0, 0.5, 50.0])
def test_the_map_is_at_its_minimum(share, noise):
    rng = np.random.default_rng(8)
    for n in (30, 600):
        x, y = worst(rng, n, share, noise)
        slope, shift = toxicity._logistic(x, y)
        v, a = np.append(slope, shift), np.hstack([x, np.ones((n, 1))])
        least = toxicity.map_loss(v, a, y)
        for _ in range(300):
            assert toxicity.map_loss(v + rng.normal(size=4) * 10 ** rng.uniform(-6, 1), a, y) >= least - 1e-9
        gradient = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) + toxicity.MAP_RIDGE * v
        assert np.abs(gradient).max() < 1e-3


def test_a_steep_map_does_not_diverge():
    """Summaries far apart in scale, with labels that hardly follow them: full steps run away here."""
    rng = np.random.default_rng(9)
    x = np.column_stack([np.full(600, -1.49) + 1e-3 * rng.normal(size=600), rng.exponential(0.01, 600), rng.exponential(0.001, 600)])
    y = np.repeat([1.0, 0.0], 300)
    x[:300, 1] += 0.02
    slope, shift = toxicity._logistic(x, y)
    p = 1 / (1 + np.exp(-(x @ slope + shift)))
    assert -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)) <= np.log(2) + 1e-9


def test_common_words_do_not_make_everything_toxic():
    """Each word of the toxic sentence is in clean texts as well."""
    rng = random.Random(1)
    insult = "go jump in the lake you all".split()
    filler = [a + b for a in ("ber", "kon", "tal", "mir", "sol") for b in ("den", "gar", "lim", "nop", "rus", "tek")]

    def some(extra=()):
        w = [rng.choice(filler) for _ in range(40)] + list(extra)
        return " ".join(w) + "."

    clean = [some([rng.choice(insult) for _ in range(2)]) for _ in range(300)]
    bad = [some(insult) for _ in range(300)]
    model = toxicity.train(clean + bad, [0] * 300 + [1] * 300)
    p = model.probability(np.array([toxicity.summary(np.array(model.margins(toxicity.words_of(t)))) for t in clean]))
    assert (p >= toxicity.THRESHOLD).mean() < 0.5
