"""The recurrent model against finite differences, sums to one, and the contract's counts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from jobtrail.llm import gru, language, language_model, queries
from tests.llm.odd import SMALL, empty_frame, odd_frame

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tiny(seed=0, words=9, hidden=4):
    rng = np.random.default_rng(seed)
    model = gru.Gru.untrained(np.sort(rng.integers(1, 50, words))[::-1].astype(float), 7, hidden)
    for name in ("class_out", "word_out"):
        setattr(model, name, rng.normal(0, 0.5, getattr(model, name).shape).astype(np.float32))
    return model


def test_probabilities_of_the_next_word_sum_to_one():
    model = tiny()
    for before in ([], [3], [4, 9, 1]):
        total = 0.0
        for word in range(model.words + 1):
            whole = gru.score_texts(model, [np.array([*before, word])])[0]
            total += math.exp(whole - (gru.score_texts(model, [np.array(before)])[0] if before else 0.0))
        assert abs(total - 1) < 1e-5


def test_untrained_is_the_unigram_model():
    counts = np.array([50.0, 30.0, 15.0, 5.0])
    model = gru.Gru.untrained(counts, 100)
    assert np.allclose(np.exp(gru.score_texts(model, [np.array([i]) for i in range(5)])),
                       [0.25, 0.15, 0.075, 0.025, 0.5], atol=1e-6)


def test_state_is_carried_however_texts_are_grouped():
    model, rng = tiny(), np.random.default_rng(1)
    texts = [rng.integers(0, 10, n) for n in (1, 300, 7, 64, 65, 2, 300, 150)] + [np.empty(0, dtype=int)]
    one = gru.score_texts(model, texts, together=700, rows=3, flush=5)
    assert np.allclose(one, gru.score_texts(model, texts), rtol=1e-4)
    assert np.allclose(one[:2], [gru.score_texts(model, [t])[0] for t in texts[:2]], rtol=1e-4)


@pytest.mark.parametrize("name", gru.Gru.LEARNED)
def test_gradients(name, monkeypatch):
    """Truncated backpropagation over one window against finite differences."""
    monkeypatch.setattr(gru, "STREAMS", 1)
    rng = np.random.default_rng(2)
    text = np.array([3, 9, 1, 0, 5, 5, 2, 0, 7])
    streams = [text[:4], text[4:8], text[8:]]
    base = tiny(4)
    for n in gru.Gru.LEARNED:
        setattr(base, n, getattr(base, n).astype(np.float64))

    def loss(model):
        return -gru.score_texts(model, streams).sum()

    moved = {}
    trainer = gru.Trainer(base)
    monkeypatch.setattr(trainer, "_move", lambda n, g, rows=slice(None): moved.setdefault(n, []).append((rows, g)))
    trainer.learn(text, streams=1, window=9)
    want = np.zeros_like(getattr(base, name))
    for rows, g in moved[name]:
        want[rows] += g
    for at in rng.permutation(want.size)[:25]:
        at = np.unravel_index(at, want.shape)
        values = getattr(base, name)
        keep = values[at]
        values[at] = keep + 1e-2
        up = loss(base)
        values[at] = keep - 1e-2
        down = loss(base)
        values[at] = keep
        assert abs((up - down) / 2e-2 - want[at]) < 5e-3 + 2e-2 * abs(want[at])


def test_learns_what_follows_what():
    rng = np.random.default_rng(3)
    words = np.concatenate([np.append(np.tile([1, 2, 3], rng.integers(2, 9)), 0) for _ in range(4000)])
    counts = np.bincount(words, minlength=4).astype(float)
    trainer = gru.Trainer(gru.Gru.untrained(counts, 0))
    before = gru.score_texts(trainer.model, [words])[0]
    trainer.learn(words, streams=32)
    trainer.learn(words, streams=32)
    assert gru.score_texts(trainer.model, [words])[0] > before * 0.4


def expected(rows):
    lists = {i: WORD.findall((t or "").translate(LOWER)) for i, t in rows}
    train = {i: zlib.crc32(str(i).encode()) % 7 != 2 for i in lists}
    counts = Counter(w for i in lists if train[i] for w in lists[i])
    ends = sum(train.values())
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    out = {}
    for i, words in lists.items():
        c = [counts[w] for w in words] + [ends]
        out[i] = (not train[i], len(c), sum(x > 0 for x in c), n, sum(math.log10((x + 1) / (n + v + 1)) for x in c))
    return out


def same(rows, want):
    for r in rows:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert math.isclose(r.base_score, want[r.doc_id][4], rel_tol=1e-9, abs_tol=1e-9)
        assert math.isfinite(r.score) and r.score <= 0


def test_query(spark):
    docs = [(d.doc_id, d.text) for d in queries.table(spark, SMALL, "documents").collect()]
    rows = queries.op8_language_model(spark, SMALL).collect()
    assert len(rows) == len(docs)
    same(rows, expected(docs))
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_rows(spark):
    df = odd_frame(spark).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    rows = language_model.score_documents(df, language.id_remainder(7) == 2).collect()
    same(rows, expected([(r.doc_id, r.text) for r in df.collect()]))
    held = language.id_remainder(7) == 2
    assert language_model.score_documents(odd_frame(spark), held).count() == odd_frame(spark).count()
    assert language_model.score_documents(empty_frame(spark), held).count() == 0


def test_no_training_documents(spark):
    from pyspark.sql import functions as F
    rows = language_model.score_documents(odd_frame(spark), F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)


def test_small_class_numbers():
    """Classes are numbered by small integers, which are sorted by radix, and gates lie side by side in memory."""
    model = gru.Gru.untrained(np.arange(50, 0, -1).astype(float), 7)
    assert model.class_of.dtype.itemsize == 1
    state, keep, reset, new, _ = gru._step(model, np.array([1, 2, 3]), np.zeros((gru.HIDDEN, 3), np.float32))
    assert all(x.shape == (gru.HIDDEN, 3) and x.flags.c_contiguous for x in (state, keep, reset, new))
