"""Held-out accuracy of both classifiers, their parts, and edge cases."""

import zlib

import numpy as np
import pytest

from talkloom.llm import quality_classifier as qc
from talkloom.llm import toxicity as tox
from talkloom.llm.common import table

DOCS = "doc_id bigint, text string, score string, source string"
SF = "/root/testdata/sf0.1"


def auc(score, y):
    order = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    ones, zeros = int(y.sum()), int((1 - y).sum())
    return (order[y == 1].sum() - ones * (ones + 1) / 2) / (ones * zeros)


def held_out(spark, scored, column):
    rows = scored.where("held_out").join(table(spark, SF, "labels"), "doc_id").select("doc_id", "score", "predicted", column).collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    return tuple(np.array([r[c] for r in rows], float) for c in ("score", "predicted", column))


def test_quality_on_held_out_rows(spark):
    score, predicted, y = held_out(spark, qc.quality_scores(table(spark, SF, "documents"), table(spark, SF, "labels")), "quality")
    assert auc(score, y) > 0.97 and (predicted[y == 1] == 1).mean() > 0.99 and (predicted[y == 0] == 0).mean() > 0.8


def test_toxicity_on_held_out_rows(spark):
    score, predicted, y = held_out(spark, tox.toxicity_scores(table(spark, SF, "documents"), table(spark, SF, "labels")), "toxic")
    # nearly half of the toxic labels here mark texts without any toxic word: finding every such word gives an AUC of 0.773
    assert auc(score, y) > 0.773 and (predicted == y).mean() > 0.92 and (predicted[y == 0] == 0).mean() > 0.98


def test_prior_and_risk_on_known_mixture():
    rng = np.random.default_rng(2)
    good = rng.random(40_000) < 0.7
    rows = np.zeros((len(good), 1 + len(qc.MEASURES)), np.int64)
    start = 1
    for k, edges in enumerate(qc.MEASURES.values(), 1):
        n = len(edges) + 1
        rows[:, k] = start + np.where(good, rng.integers(0, max(1, n - 2), len(good)), rng.integers(n // 2, n, len(good)))
        start += n
    chosen = good & (rng.random(len(good)) < 0.3)
    x = np.zeros((len(good), qc.WIDTH))
    np.put_along_axis(x, rows, 1.0, axis=1)
    sums = {"u": x.T @ x, "p": x[chosen].T @ x[chosen]}
    prior = qc.class_prior(sums)
    assert abs(prior - 0.7) < 0.06
    g = qc.weigh(rows, qc.fit(sums, prior))
    assert auc(g, good.astype(int)) > 0.95
    steps = qc._step(g)
    curve = qc.calibrate(np.bincount(steps, minlength=qc.STEPS).astype(float), np.bincount(steps[chosen], minlength=qc.STEPS).astype(float), prior)
    assert (np.diff(curve) >= 0).all() and abs(curve[steps].mean() - prior) < 0.05


@pytest.mark.parametrize("text", ["", " \n", "word", "é" * 50, "A" * 100_000, "a b " * 50_000])
def test_measures_of_any_text(text):
    assert len(qc.measures(text.encode())) == len(qc.MEASURES) and max(qc.bins(qc.measures(text.encode()))) < qc.WIDTH


def test_backed_off_counts_are_distributions():
    counts = np.array([5, 1, 0, 2, 1, 1], np.int64)
    shared = np.array([0.1, 0.2, 0.3, 0.1, 0.2, 0.1])
    assert tox._backed(counts, shared).sum() == pytest.approx(1) and (tox._backed(np.zeros(6, np.int64), shared) == shared).all()
    square = np.array([[3, 1], [0, 0]], np.int64)
    assert tox._backed(counts, shared, 3.0).sum() == pytest.approx(1)
    assert tox._backed(square, np.array([[0.5, 0.5]])).sum(axis=1) == pytest.approx([1, 1])


@pytest.mark.parametrize("score,label", [(qc.quality_scores, "quality"), (tox.toxicity_scores, "toxic")])
def test_edges(spark, score, label):
    rows = [(1, "a b c", "x", "s"), (1, "a b c", "x", "s"), (None, None, None, None), (4, "", "y", ""), (5, "long " * 60_000, "", ""), (6, "%%% ###", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1), (1, 1), (4, 0), (5, None), (None, 1), (6, 0), (6, 1), (99, 1), (2, 0)], f"doc_id bigint, {label} int")
    for told in (labels, labels.limit(0), labels.where(f"{label} = 1")):
        got = score(docs, told).collect()
        assert len(got) == len(rows)
        for r in got:
            assert 0 <= r["score"] <= 1 and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
            assert r["predicted"] == int(r["score"] >= (0.3 if label == "quality" else 0.5))
        assert len({r["score"] for r in got if r["doc_id"] == 1}) == 1
    assert score(docs.limit(0), labels).count() == 0


def test_scores_do_not_see_labels_of_their_fold(spark):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    one = {r["doc_id"]: r["score"] for r in qc.quality_scores(docs, labels).collect()}
    assert one == {r["doc_id"]: r["score"] for r in qc.quality_scores(docs, flipped).collect()}


@pytest.mark.parametrize("curve_only", [False, True])
def test_all_labels_of_the_curve_fold_fit_the_curve(spark, monkeypatch, curve_only):
    docs, labels = table(spark, "/root/testdata/sf0.001", "documents"), table(spark, "/root/testdata/sf0.001", "labels")
    held = lambda i: zlib.crc32(str(i).encode()) % 5
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] is not None and held(r["doc_id"])}
    if curve_only:  # a class without rows in the curve's fold is still fitted
        labels = labels.where(f"doc_id in ({','.join(str(i) for i, t in toxic.items() if t == 0 or held(i) != tox.CURVE_FOLD)})")
        want = {i: t for i, t in toxic.items() if t == 0 or held(i) != tox.CURVE_FOLD}
    else:
        want = {i: t for i, t in toxic.items() if held(i) == tox.CURVE_FOLD}
    assert set(want.values()) == {0, 1}
    seen, fit = [], tox.fit_curve
    monkeypatch.setattr(tox, "fit_curve", lambda n_words, ratio, y, n: seen.append((int(n.sum()), int(n[y == 1].sum()))) or fit(n_words, ratio, y, n))
    scores = {r["score"] for r in tox.toxicity_scores(docs, labels).collect()}
    assert seen == [(len(want), sum(want.values()))] and len(scores) > 1


def test_packing_sees_every_byte():
    packing = list(qc.MEASURES).index("packing")
    lead = np.random.default_rng(5).integers(33, 127, 4096, dtype=np.uint8).tobytes()
    packed = lambda raw: qc.measures(raw)[packing]
    assert packed(lead) > 0.8
    assert packed(lead + b"buy now " * 4096) < 0.2  # a clean lead, and 32 KB of repetition
    assert packed(lead * 16 + b"a" * (1 << 16) * 16) < 0.1 and packed(lead + b"a" * 40) == pytest.approx(packed(lead), abs=0.02)
    raw = lead[:1000] + b"ab " * 5000
    pieces = [raw[k : k + 4096] for k in range(0, len(raw), 4096)]
    assert packed(raw) == pytest.approx(np.average([len(zlib.compress(p, 1)) / len(p) for p in pieces], weights=[len(p) for p in pieces]))
