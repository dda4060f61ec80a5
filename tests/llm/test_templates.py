"""Pages of one template, alike but not alike enough: they share shingles and are never paired."""

import random

import pytest

pytest.importorskip("bandscope.llm")

from bandscope.llm import neardup  # noqa: E402

PREFIX = "id long, comp long, minor boolean, n long, p long, t long"


def fits(n, p, nx, px, percent):
    return 100 * min(n, nx) >= percent * max(n, nx) and (1 + min(n - p, nx - px)) * (100 + percent) >= percent * (n + nx)


def test_meetings_equal_all_pairs_under_the_bounds(spark):
    rng = random.Random(2)
    rows = [(i, i % 7, rng.random() < 0.5, n := rng.randint(1, 30), rng.randint(1, n), rng.randint(0, 5)) for i in range(150)]
    rows += rows[:10]
    got = sorted((r.t, r.x, r.id) for r in neardup._meetings(spark.createDataFrame(rows, PREFIX), 80).collect())
    want = sorted((a[5], b[0], a[0]) for a in rows for b in rows if b[2] and a[5] == b[5] and fits(a[3], a[4], b[3], b[4], 80))
    assert got == want and want


def test_two_thousand_pages_of_one_template_make_no_pairs(spark):
    """Each shares its shingles at places from which 80 % can't be reached any more."""
    rows = [(i, i, True, 100 + i % 9, 15 + k, k) for i in range(2_000) for k in range(5)]
    prefix = spark.createDataFrame(rows, PREFIX)
    meetings = neardup._meetings(prefix, 80)
    assert meetings.count() == 0
    assert prefix.select("t", "n", "p").distinct().count() <= 9 * 5
    plan = meetings._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_a_template_is_no_group_and_its_copies_are(spark):
    """Half of each page is the template, so pages are at a similarity under 0.8; near copies of some are found."""
    rng = random.Random(4)
    shared = [f"t{i}" for i in range(70)]
    pages = [" ".join(shared[:35] + [f"w{rng.randrange(10**6)}" for _ in range(14)] + shared[35:]) for _ in range(300)]
    docs = [(i, p) for i, p in enumerate(pages)] + [(1_000 + i, pages[i] + " end") for i in range(0, 300, 10)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(300)} | {1_000 + i: i for i in range(0, 300, 10)}
