"""The language model's rows, values, logits and gradient for many tokens at once, against plain loops."""

import math

import numpy as np
import pytest

from tickloom.llm import lm_score
from tickloom.llm.shingles import WordHasher, words_of

from .test_operators import plain_features

ROWS, LEVELS = 64, 2


@pytest.fixture(scope="module")
def case():
    rnd = np.random.default_rng(5)
    texts = [" ".join(rnd.choice(list("abcdefghijklmnop"), n)) for n in (0, 1, 2, 5, 40, 150)]
    t = lm_score.tokens_of(texts, WordHasher())
    near = np.unique(t.hashes)[::2]
    table = rnd.integers(1, 60, (ROWS, 17)).astype(np.uint8)
    table[:, :16][rnd.random((ROWS, 16)) < 0.4] = 0
    table[::7] = 0
    shares = lm_score.node_shares(t.path, np.ones(len(t.path)), LEVELS)
    weights = rnd.normal(0.3, 0.2, (LEVELS, len(lm_score.KINDS), lm_score.BUCKETS))
    logits = lm_score.Logits(table, shares)
    h = lm_score.histories(t, lm_score.Places(near))
    mode = logits.modes(t, h, 0, ROWS)
    return t, near, table, shares, weights, logits, h, mode, *logits.found(h, t.path, mode, 0, ROWS)


def plain(case, level, weights):
    """Each token's logits, and its (place, values) of every kind, number by number."""
    t, near, table, shares, _, _, _, mode, at, _ = case
    for k in range(len(t.path)):
        share = shares[level][t.path[k] >> 4 * (lm_score.MOST_LEVELS - level)].tolist()
        z, parts = list(share), []
        for kind in range(len(lm_score.KINDS)):
            *codes, total = table[at[level, kind, k]].tolist()
            bucket = 0 if total == 0 else min(7, 1 + (total + 1) // 8)
            v = [(c - 1) * math.log(2) / 8 - share[d] if c else 0.0 for d, c in enumerate(codes)]
            parts.append((kind * lm_score.BUCKETS + int(mode[k]) * lm_score.TIMES + bucket, v))
            z = [a + weights[level, kind, int(mode[k]) * lm_score.TIMES + bucket] * b for a, b in zip(z, v)]
        yield z, parts


def test_rows_of_all_levels_and_kinds_at_once(case):
    t, near, _, _, _, _, _, _, at, _ = case
    bounds = np.cumsum(np.r_[0, t.sizes])
    for a, b in zip(bounds, bounds[1:]):
        h, path = t.hashes[a:b].tolist(), t.path[a:b].tolist()
        for k in range(b - a):
            for level in range(LEVELS):
                assert at[level, :, a + k].tolist() == [f % ROWS for f in plain_features(h, set(near.tolist()), path, k, level)]


def test_logits_and_gradient(case):
    """The gradient is that of the likelihood by small changes of each weight."""
    t, _, _, _, weights, logits, _, _, at, place = case
    wide = lm_score.spread(weights)
    for level in range(LEVELS):
        want = list(plain(case, level, weights))
        value, z = logits.of(level, at[level], place[level], t.path, wide[level])
        assert np.allclose(z, [w for w, _ in want], atol=1e-4)
        assert np.allclose(lm_score.STEP * value, np.transpose([[v for _, v in parts] for _, parts in want], (1, 0, 2)), atol=1e-4)
        assert [[p for p, _ in parts] for _, parts in want] == place[level].T.tolist()
        digit = lm_score.digit_of(t.path, level).tolist()
        gain = lambda w: sum(z[d] - math.log(sum(map(math.exp, z))) for (z, _), d in zip(plain(case, level, w), digit))
        slope = lm_score.slopes(logits, level, at[level], place[level], t.path, wide[level])
        used = np.unique(place[level])
        assert len(used) > 8 and not slope[np.setdiff1d(np.arange(len(slope)), used)].any()
        for p in used[::3]:
            up, down = weights.copy(), weights.copy()
            up[level].ravel()[p] += 1e-4
            down[level].ravel()[p] -= 1e-4
            assert slope[p] == pytest.approx((gain(up) - gain(down)) / 2e-4, rel=2e-3, abs=2e-2)


def test_blocks_change_nothing(case, monkeypatch):
    """Scores of a text do not depend on how many tokens are looked for or computed together."""
    t, near, table, shares, weights, *_ = case
    model = lm_score.Model(LEVELS, shares, near, table, weights, np.zeros(16**LEVELS), near[:0], near[:0], 1, 1)
    shape = lambda: lm_score.shape_of(model, lm_score.Logits(table, shares), lm_score.Places(near), t)
    want = shape()
    monkeypatch.setattr(lm_score, "SOUGHT", 50)
    monkeypatch.setattr(lm_score, "cuts", lambda a, b, size=7: [slice(x, min(x + size, b)) for x in range(a, b, size)])
    assert np.allclose(shape(), want, atol=1e-6)


def test_places_of_words():
    """Also where many words share a slot, and of none."""
    rnd = np.random.default_rng(3)
    words = np.unique(np.r_[rnd.integers(0, 2**64, 3000, np.uint64), np.arange(500, dtype=np.uint64), np.uint64(2**64 - 1)])
    asked = np.r_[words, words + np.uint64(1), rnd.integers(0, 2**64, 3000, np.uint64)]
    where = {w: i for i, w in enumerate(words.tolist())}
    assert lm_score.Places(words).of(asked).tolist() == [where.get(w, -1) for w in asked.tolist()]
    assert lm_score.Places(words[:0]).of(asked[:2]).tolist() == [-1, -1]


def test_words_of_every_byte():
    """Blanks and capitals are the same for hashes as for words."""
    text = "".join(f"x{chr(c)}Y{chr(c).upper()}z " for c in range(256))
    h, count = WordHasher().of([text, "É A"])
    plain = words_of(text) + words_of("É A")
    assert count.sum() == len(plain) == len(h) and len(set(h.tolist())) == len(set(plain))
    assert all((a == b) == (x == y) for a, x in zip(plain[:40], h[:40]) for b, y in zip(plain, h))
