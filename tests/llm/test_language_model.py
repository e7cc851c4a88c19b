"""The language model: counts and base scores by plain Python, the network by differences, and gain on texts held out."""

import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline.llm import language_model as lm
from tallyline.llm import recurrent as rnn

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_gradients_equal_differences(monkeypatch):
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in rnn.start(np.full(rnn.SYMBOLS, 1 / rnn.SYMBOLS)).items()}
    symbols, ends = rng.integers(0, 300, 200), np.array([0, 37, 80, 81, 200])
    place, x, fresh = rnn.grid(symbols, ends, 3)
    spot, h = place[:12], rng.normal(0, 0.3, (3, rnn.HIDDEN))
    monkeypatch.setattr(rnn.np, "float32", np.float64)
    run = lambda w: rnn.gradients(w, x[:12], symbols[spot], spot >= 0, fresh[:12], h)
    g = run(w)[1]
    for k in w:
        for i in np.argsort(-np.abs(g[k]).ravel())[[0, 5]]:
            up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
            up[k].ravel()[i] += 1e-5
            down[k].ravel()[i] -= 1e-5
            assert g[k].ravel()[i] == pytest.approx((run(up)[0] - run(down)[0]) / 2e-5, rel=1e-3, abs=1e-7)


def test_state_is_carried_and_lanes_do_not_show():
    rng = np.random.default_rng(1)
    w = rnn.start(rng.random(rnn.SYMBOLS) / rnn.SYMBOLS)
    w["wc"] += rng.normal(0, 1, w["wc"].shape).astype(np.float32)
    lengths = [1, 200, 3, 90, 0, 33, 32]
    symbols, ends = [], [0]
    for n in lengths:
        symbols += [*rng.integers(2, rnn.SYMBOLS, n).tolist(), rnn.END]
        ends.append(len(symbols))
    symbols, ends = np.array(symbols), np.array(ends)
    together = rnn.score(w, symbols, ends, 3)
    for i in range(len(lengths)):
        own = symbols[ends[i]: ends[i + 1]]
        assert together[i] == pytest.approx(rnn.score(w, own, np.array([0, len(own)]), 1)[0], rel=1e-4)
        h, total = np.zeros((1, rnn.HIDDEN), np.float32), 0.0
        for before, s in zip([rnn.END, *own[:-1]], own, strict=True):
            states, h, _ = rnn.forward(w, np.array([[before]]), np.array([[False]]), h)
            total += float(rnn.log_probabilities(w, states[0], np.array([s]))[0])
        assert together[i] == pytest.approx(total, rel=1e-3)
    states = rng.normal(0, 1, (1, rnn.HIDDEN)).astype(np.float32)
    every = np.exp(rnn.log_probabilities(w, np.repeat(states, rnn.SYMBOLS, 0), np.arange(rnn.SYMBOLS)))
    assert every.sum() == pytest.approx(1, abs=1e-4)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    tongues = [[f"{t}{i}" for i in range(60)] for t in "ABC"]
    rows = []
    for i in range(400):
        words = [rng.choice(tongues[i % 3]) for _ in range(rng.randrange(20, 90))]
        rows.append((i, " ".join(words) + rng.choice(["", "\n", f" rare{i}", f" Ünique{i} twice{i} twice{i}"])))
    rows += [(5000, None), (5001, ""), (None, "no id"), (3, rows[3][1]), (3, "A1 other text"), (5002, "unseen " * 30)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "bucket": F.lit("x")})


def plain(rows):
    tokens = [WORD.findall((t or "").translate(LOWER)) for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows]
    c, ends = Counter(), 0
    for w, h in zip(tokens, held, strict=True):
        if not h:
            c.update(w)
            ends += 1
    total = sum(c.values()) + ends
    room = math.log10(total + 0.1 * (len(c) + 2))
    return sorted((d if d is not None else -1, h, len(w) + 1, sum(x in c for x in w) + 1, total,
                   round(sum(math.log10(c[x] + 0.1) for x in w) + math.log10(ends + 0.1) - (len(w) + 1) * room, 6))
                  for (d, _), w, h in zip(rows, tokens, held, strict=True))


@pytest.mark.parametrize("head", [lm.HEAD, 100])
def test_base_scores_and_gain(docs, monkeypatch, head):
    rows, df = docs
    monkeypatch.setattr(lm, "HEAD", head)
    monkeypatch.setattr(lm, "TRAIN_SHARE", 1.0)
    got = lm.scored(df).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                   round(r.base_score, 6)) for r in got) == plain(rows)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 5000]
    assert len(held) > 20 and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_without_training_texts(spark):
    df = spark.createDataFrame([(d, "a b") for d in range(100) if zlib.crc32(str(d).encode()) % 10 == 0], "doc_id long, text string")
    got = lm.scored(df).collect()
    assert len(got) == df.count() and {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}
    assert lm.scored(df.limit(0)).count() == 0


def test_every_training_text_trains(spark, monkeypatch):
    """Each training text reaches a weight: here text i marks weight i."""
    def marks(known, weights, turn):
        def run(batches):
            for batch in batches:
                for text in batch.column("text").to_pylist():
                    mark = np.zeros(len(weights), "<f4")
                    mark[int(text)] = 1
                    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([1.0]), pa.array(
                        [mark.tobytes()], pa.binary())], ["group", "tokens", "weights"])
        return run

    monkeypatch.setattr(lm, "_train", marks)
    texts = spark.createDataFrame([(i, str(i)) for i in range(60)], "doc_id long, text string")
    known = lm.Known(np.arange(60, dtype=np.uint64), np.ones(60, np.int64), 60, 60, 60)
    assert np.flatnonzero(lm.trained(texts, known)).tolist() == list(range(60))


def test_gain_as_it_is_run(docs):
    got = [r for r in lm.scored(docs[1]).collect() if r.held_out and r.doc_id < 5000]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_lanes_are_filled_from_many_texts(monkeypatch):
    """Texts of several batches and of more than one small block train side by side, so that lanes do not run empty."""
    calls = []
    monkeypatch.setattr(rnn, "train", lambda w, opt, symbols, ends: calls.append((len(ends) - 1, len(symbols))))
    monkeypatch.setattr(lm.TaskContext, "get", staticmethod(lambda: SimpleNamespace(partitionId=lambda: 0)))
    known = lm.Known(np.arange(9, dtype=np.uint64), np.ones(9, np.int64), 9, 9, 9)
    batch = pa.RecordBatch.from_arrays([pa.array(["one two " * 500] * 200 + [None])], ["text"])
    made = list(lm._train(known, rnn.flat(rnn.start(known.share)), 0)(iter([batch, batch])))
    assert calls == [(402, 2 * (200 * 1001 + 1))] and made[0].column("tokens").to_pylist() == [400402.0]


def test_softmax_of_large_numbers():
    x = np.array([[0, 500, -500], [-700, -701, -702], [1, 2, 3]], np.float32)
    want = np.array([-500 + 0, -np.log(1 + np.exp(-1) + np.exp(-2)), 2 - 3 - np.log(1 + np.exp(-1) + np.exp(-2))])
    assert rnn._log_softmax_at(x.copy(), np.array([0, 0, 1])) == pytest.approx(want, rel=1e-5)
    loss, back = rnn._step_back(x.copy(), np.array([0, 0, 1]))
    assert loss == pytest.approx(-want.sum(), rel=1e-5) and np.isfinite(back).all()
    assert back.sum(1) == pytest.approx(np.zeros(3), abs=1e-6)
