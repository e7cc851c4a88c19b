"""Toxicity scores: features by plain Python, the fit by itself, and accuracy on labels held out."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyline.llm import toxicity as tx
from tallyline.llm.words import utf8

WORD = re.compile("[^\x20\x09-\x0d]+")


def block_features(texts, lexicon=None):
    return tx.features(tx.Forms(*utf8(pa.array(texts))), lexicon or {})


def test_features_by_hand():
    x = block_features(["You are an IDIOT!! really", "", None, "1d10t, i.d.i.o.t (idiot)", "plain words of no harm",
                        "sooo bad ###", "idiot one two three four five you"])
    f = dict(zip(tx.FEATURES, x.T.tolist(), strict=True))
    assert f["insults"] == pytest.approx([1 / 5, 0, 0, 1, 0, 0, 1 / 7])
    assert f["hidden"] == pytest.approx([0, 0, 0, 2 / 3, 0, 0, 0])
    assert f["near_person"] == pytest.approx([1 / 5, 0, 0, 0, 0, 0, 0]) and f["near_share"][6] == 0
    assert f["shouted"][0] == pytest.approx(1 / 5) and f["double_marks"][0] == pytest.approx(1 / 5)
    assert f["drawn_out"][5] == pytest.approx(1 / 3) and f["signs"][5] == pytest.approx(3 / 12)
    assert not x[1].any() and not x[2].any()


def test_word_forms():
    forms = tx.Forms(*utf8(pa.array(["(Größe!) größer ... größ"])))
    same = tx.Forms(*utf8(pa.array(["größe größer - größ"])))
    assert forms.plain().tolist()[0] != forms.plain().tolist()[1]
    four = forms.plain(4).tolist()  # "größ" itself is not longer than four characters
    assert four[0] == four[1] != 0 and four[2] == four[3] == 0
    assert forms.plain(4).tolist() == same.plain(4).tolist()


def test_trees_and_calibration():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 1)).astype(float)
    edges, trees = tx.fit_trees(x[:2000], y[:2000])
    model = tx.Model(0.5, {}, edges, trees)
    raw = model.raw(x[2000:])
    assert ((raw > 0) == y[2000:]).mean() > 0.95
    model.knots = tx.isotonic(raw, y[2000:])
    assert (np.diff(model.knots[0]) > 0).all() and (np.diff(model.knots[1]) >= 0).all()
    s = model.score(x)
    assert ((s >= 0) & (s <= 1)).all() and (np.diff(s[np.argsort(model.raw(x))]) >= -1e-12).all()
    knots = tx.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]))
    assert len(knots[0]) == 3 and knots[1][1] == pytest.approx(0.5)


@pytest.fixture(scope="module")
def made(spark):
    """Documents with invented hostile words that only labels can teach, and clean ones."""
    rng = random.Random(8)
    syllables = ["ba", "ko", "mi", "ten", "ral", "su", "vi", "dor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 5 == 0
        words = [word() for _ in range(rng.randrange(20, 80))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = "zurgl" + word()
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(9000, None), (9001, ""), (None, "no id"), (3, docs[3][1])]
    labels += [(None, 1), (9000, None), (77_777, 1), (3, 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumns({"_score": F.lit(1), "lang": F.lit("x")}),
            spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("text", F.lit("clash")))


def test_held_out_accuracy(made):
    documents, labels = made
    got = tx.scored(documents, labels).collect()
    assert len(got) == documents.count()
    for r in got:
        want = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2
        assert r.held_out == want and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in got if r.held_out and r.doc_id < 9000]
    wrong = sum(r.predicted != (r.doc_id % 5 == 0) for r in held)
    assert len(held) > 200 and wrong <= 0.03 * len(held)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    kept = tx.drop_toxic(documents, labels)
    assert kept.columns == documents.columns and kept.count() == sum(not r.predicted for r in got)


def test_without_labels(spark, made):
    documents, labels = made
    assert {r.score for r in tx.scored(documents, labels.limit(0)).collect()} == {0.0}
    assert tx.scored(documents.limit(0), labels).count() == 0


def test_labels_held_out_are_never_read(spark, made):
    documents, labels = made
    twisted = labels.withColumn("toxic", F.when(tx.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = {(r.doc_id, r.score) for r in tx.scored(documents, labels).collect()}
    assert a == {(r.doc_id, r.score) for r in tx.scored(documents, twisted).collect()}
