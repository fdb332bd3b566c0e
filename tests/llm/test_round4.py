"""What the findings of round 4 named."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import collocations, jaccard_join

from .test_operators import components_by_hand, frame


def shared_passages(rnd, docs: int, groups: int) -> list[tuple[int, str]]:
    """Texts that hold a passage of their group, which is two fifths of each, and are else their own."""
    passages = [[f"p{g}x{i}" for i in range(24)] for g in range(groups)]
    return [(k, " ".join(passages[k % groups] + [f"u{rnd.randrange(10**9)}" for _ in range(36)])) for k in range(docs)]


def test_op8_sends_no_text_for_a_shared_passage(spark, monkeypatch):
    """Nodes that meet in lists but cannot link were sent to every home of the others' with their texts."""
    sent, stash = {}, jaccard_join.stash

    def counted(df, what, *by):
        out = stash(df, what, *by)
        sent[what] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "stash", counted)
    rows = shared_passages(random.Random(4), 150, 6)
    got = jaccard_join.op8(spark, frame(spark, rows)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, k) for k, _ in rows}
    assert sent["met-nodes"] > 100 and sent["visits"] + sent.get("pairs", 0) == 0


@pytest.mark.parametrize("percent, words, small", [(85, 4, 64), (60, 1, 3)])
def test_left_links_alone_find_what_all_pairs_have(spark, monkeypatch, percent, words, small):
    """Without rounds every link is left to the last search, by pairs and (many nodes a label) by homes."""
    monkeypatch.setattr(jaccard_join, "SMALL_NODES", small)
    monkeypatch.setattr(jaccard_join, "SLICE", 5)
    rnd, rows = random.Random(percent + small), []
    for base in range(12):
        text = [f"w{rnd.randrange(60 if base % 3 else 10**6)}" for _ in range(rnd.choice([3, 9, 40, 120]))]
        for _ in range(8):
            near = [w if rnd.random() > rnd.choice([0, 0.005, 0.02, 0.04]) else f"n{rnd.randrange(10**6)}" for w in text]
            rows.append((len(rows), " ".join(near[rnd.randrange(3) :] + text[: rnd.randrange(4)])))
    rounds = 0 if small == 64 else 1
    got = jaccard_join.jaccard_components(frame(spark, rows), words=words, percent=percent, rounds=rounds).collect()
    assert sorted((tuple(r) for r in got), key=repr) == components_by_hand(rows, words, percent)


def test_bounds_keep_every_pair_that_links(spark):
    """Both bounds hold for random sets of any overlap."""
    rnd, rows = np.random.default_rng(8), []
    for k in range(400):
        n, both = int(rnd.integers(1, 300)), 0
        m = int(min(n / 0.85, n + rnd.integers(0, 40)))
        both = int(rnd.integers(int(0.8 * n), n + 1))
        pool = rnd.choice(1 << 62, n + m - both, replace=False).astype(np.uint64)
        x, y = np.sort(pool[:n]), np.sort(pool[n - both :])
        hot = np.sort(rnd.choice(pool, len(pool) // 4, replace=False))
        shared = len(np.intersect1d(*(jaccard_join.prefix(s, hot, 85) for s in (x, y))))
        links = 100 * both >= 85 * (n + m - both)
        assert not links or jaccard_join.may_link(jaccard_join.bitmap(x), jaccard_join.bitmap(y), n, m, 85)
        rows.append((n, m, shared, links))
    kept = spark.createDataFrame(rows, "n long, m long, shared long, links boolean")
    kept = kept.withColumn("least", jaccard_join.least_shared(kept.n, kept.m, 85)).collect()
    assert sum(r.links for r in kept) > 50 and all(r.least >= 1 and (r.shared >= r.least or not r.links) for r in kept)


def test_bitmaps_tell_unlike_sets_apart():
    rnd = np.random.default_rng(3)
    for n, m in ((60, 64), (64, 70), (300, 340), (5000, 5400)):
        x, y = (rnd.choice(1 << 62, k, replace=False).astype(np.uint64) for k in (n, m))
        assert not jaccard_join.may_link(jaccard_join.bitmap(x), jaccard_join.bitmap(y), n, m, 85)


def _spans_of(rnd, spans: int, size: int, most: int) -> list[np.ndarray]:
    return [np.r_[np.where(rnd.random(size) < 0.1, 0, rnd.integers(1, most, size)), 0].astype(np.int64) for _ in range(spans)]


def _pair_counts(spans: list[np.ndarray]) -> dict:
    """(a, b): how often, as the query's task and its sums have it."""
    batches = [collocations._span_rows([k], [x]) for k, x in enumerate(spans)]
    got = Counter()
    for batch in collocations._count_pairs(iter(batches)):
        for a, b, f in zip(*(c.to_pylist() for c in batch.columns)):
            got[a, b] += f
    return got


@pytest.mark.parametrize("most", [40, 1 << 40])
def test_op12_counts_pairs_of_any_ids(monkeypatch, most):
    monkeypatch.setattr(collocations, "HELD_PLACES", 64)
    monkeypatch.setattr(collocations, "PLACES", 16, raising=False)
    spans = _spans_of(np.random.default_rng(6), 9, 70, most)
    assert _pair_counts(spans) == Counter((a, b) for x in spans for a, b in zip(x[:-1].tolist(), x[1:].tolist()) if a and b)


def test_op12_counts_pairs_in_little_memory():
    """A worker held seven arrays of all places at once, beside Arrow batches of millions of pairs."""
    batches = [collocations._span_rows([k], [x]) for k, x in enumerate(_spans_of(np.random.default_rng(7), 20, 1 << 18, 1 << 20))]
    tracemalloc.start()
    largest = max(batch.num_rows for batch in collocations._count_pairs(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120 << 20 and largest <= 1 << 16
