"""Quality by positive-unlabelled learning with the non-negative risk.

Only trusted positives are labelled; all other web text is unlabelled. The scorer is linear in bounded features of a
text's shape, and its loss is the squared one, so every term of the risk

    prior * E_p[loss(g)] + max(0, E_u[loss(-g)] - prior * E_p[loss(-g)])

is a quadratic form in sums over rows that one distributed pass gathers: every text counts, and what reaches the driver
has a fixed size. The class prior is estimated from the same sums: unlabelled text holds at least prior times the
positives' share of any set, so it is the least ratio of the two shares over well-filled sets of rows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import fold

#: Trusted positives taken at most for the fit, chosen by hash; they are broadcast to the texts (16 bytes each).
MOST_POSITIVES = 1 << 18
#: Bytes that are compressed together.
PIECE = 4096

_KIND = np.zeros(256, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[48:58] = 4
_KIND[128:] = 5
_KIND[[46, 44, 39, 34, 59, 58, 40, 41, 45]] = 6  # usual marks of prose
_KIND[33], _KIND[63] = 7, 7
_KIND[[c for c in range(33, 127) if _KIND[c] == 0]] = 8  # other signs

#: Shape measures, and the edges of the bins in which each is counted.
MEASURES = {
    "capitals": (0.02, 0.06, 0.12, 0.25, 0.5, 0.75),
    "signs": (0.002, 0.01, 0.03, 0.08, 0.2),
    "marks": (0.005, 0.015, 0.03, 0.06, 0.12),
    "calls": (0.002, 0.01, 0.03, 0.08),
    "digits": (0.005, 0.02, 0.06, 0.15),
    "repeats": (0.002, 0.02, 0.1, 0.3, 0.6),
    "distinct": (0.05, 0.15, 0.3, 0.5, 0.7, 0.9),
    "lines": (0.02, 0.1, 0.25, 0.5),
    "word_length": (2.5, 3.5, 4.5, 5.5, 7.0, 9.0, 14.0),
    "words": (1.0, 4.0, 10.0, 30.0, 100.0, 400.0, 2000.0),
    "packing": (0.05, 0.15, 0.3, 0.4, 0.5, 0.6),
}
#: One place for each bin of each measure, and a constant.
WIDTH = 1 + sum(len(edges) + 1 for edges in MEASURES.values())


def measures(raw: bytes) -> list[float]:
    """The shape of a text, in the order of MEASURES; an empty text has zeros."""
    if not raw:
        return [0.0] * len(MEASURES)
    counts = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=9)
    n = max(1, len(raw) - int(counts[1]))
    words = raw.lower().split()
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    w = max(1, len(words))
    # compressed size of all pieces, each alone, so that long texts compare with short ones
    packed = sum(len(zlib.compress(raw[k : k + PIECE], 1)) for k in range(0, len(raw), PIECE)) / len(raw)
    return [
        counts[2] / n,
        counts[8] / n,
        counts[6] / n,
        counts[7] / n,
        counts[4] / n,
        repeats / w,
        len(set(words)) / w,
        1 - len(set(lines)) / max(1, len(lines)),
        n / w,
        float(len(words)),
        float(packed),
    ]


def bins(values: list[float]) -> list[int]:
    """Places of a text in the feature row that are 1; the first is the constant."""
    places, start = [0], 1
    for value, edges in zip(values, MEASURES.values(), strict=True):
        places.append(start + int(np.searchsorted(edges, value, "right")))
        start += len(edges) + 1
    return places


def _places(texts: pa.Array) -> np.ndarray:
    """The bins of each text, one row each."""
    return np.array([bins(measures((t.as_py() or "").encode())) for t in texts], np.int32).reshape(len(texts), 1 + len(MEASURES))


def trusted_positives(labels: DataFrame, most: int = MOST_POSITIVES) -> DataFrame:
    """doc_id of rows outside fold 0 that are labelled 1 and never 0; beyond `most`, a part chosen by hash."""
    known = labels.where("doc_id is not null and quality is not null").where(fold(F.col("doc_id")) != 0)
    sure = known.groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")
    n = sure.count()
    share = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, most / max(1, n)))
    return sure.where(share)


def _marked(docs: DataFrame, positives: DataFrame) -> DataFrame:
    """text, chosen. At most MOST_POSITIVES ids, so the broadcast has a bound, and texts are not shuffled."""
    marked = docs.select("doc_id", "text").join(F.broadcast(positives.select("doc_id", F.lit(True).alias("chosen"))), "doc_id", "left")
    return marked.select("text", F.coalesce("chosen", F.lit(False)).alias("chosen"))


def gather(docs: DataFrame, positives: DataFrame) -> dict[str, np.ndarray]:
    """Sums of feature products over all texts (u) and over the positives (p): two WIDTH x WIDTH counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, WIDTH * WIDTH), np.int64)
        for batch in batches:
            rows = _places(batch.column("text"))
            chosen = batch.column("chosen").to_numpy(zero_copy_only=False).astype(bool)
            pairs = (rows[:, :, None] * WIDTH + rows[:, None, :]).reshape(len(rows), -1)
            sums[0] += np.bincount(pairs.ravel(), minlength=WIDTH * WIDTH)
            sums[1] += np.bincount(pairs[chosen].ravel(), minlength=WIDTH * WIDTH)
        cell = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(sums[0][cell]), pa.array(sums[1][cell])], ["cell", "u", "p"])

    counted = _marked(docs, positives).mapInArrow(run, "cell bigint, u bigint, p bigint")
    found = {"u": np.zeros(WIDTH * WIDTH), "p": np.zeros(WIDTH * WIDTH)}
    for row in counted.groupBy("cell").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).collect():  # WIDTH^2 rows at most
        found["u"][row["cell"]], found["p"][row["cell"]] = row["u"], row["p"]
    return {name: values.reshape(WIDTH, WIDTH) for name, values in found.items()}


def class_prior(sums: dict[str, np.ndarray], least_share: float = 0.2) -> float:
    """The least ratio of unlabelled to positive share over single bins and pairs of bins that hold at least
    `least_share` of the positives, each ratio raised by two standard errors."""
    n_u, n_p = sums["u"][0, 0], sums["p"][0, 0]
    if not n_u or not n_p:
        return 0.5
    share_u, share_p = sums["u"] / n_u, sums["p"] / n_p
    full = share_p >= least_share
    ratio = share_u[full] / share_p[full]
    error = ratio * np.sqrt(1 / np.maximum(1, sums["u"][full]) + (1 - share_p[full]) / np.maximum(1, sums["p"][full]))
    return float(np.clip((ratio + 2 * error).min(), 0.05, 0.98))


def fit(sums: dict[str, np.ndarray], prior: float, steps: int = 4000, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights that minimise the non-negative risk under the loss (1 - z)^2 / 4, by full gradient steps.

    Where the unlabelled part of the risk turns negative, the step goes up along it instead, as the method has it."""
    n_u, n_p = max(1.0, sums["u"][0, 0]), max(1.0, sums["p"][0, 0])
    mean_u, mean_p = sums["u"][0] / n_u, sums["p"][0] / n_p
    square_u, square_p = sums["u"] / n_u, sums["p"] / n_p
    w = np.zeros(WIDTH)
    scale = rate / (1 + len(MEASURES)) * 4
    for step in range(steps):
        up, uu = square_p @ w, square_u @ w
        negative = (1 + 2 * w @ mean_u + w @ uu) / 4 - prior * (1 + 2 * w @ mean_p + w @ up) / 4
        slope_negative = (mean_u + uu) / 2 - prior * (mean_p + up) / 2
        slope = prior * (up - mean_p) / 2 + slope_negative if negative >= 0 else -slope_negative
        w -= scale * (slope + decay * w) / (1 + 3 * step / steps)
    return w


def weigh(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The linear score of each row of places, within -2 and 2."""
    return np.clip(w[rows].sum(axis=1), -2.0, 2.0)


#: Steps of the linear score for which positives and all texts are counted.
STEPS = 400


def calibrate(counts_u: np.ndarray, counts_p: np.ndarray, prior: float) -> np.ndarray:
    """The probability of label 1 for each step of the linear score: prior times the ratio of the shares of positives and
    of all texts, made monotone by pooling adjacent violators (weighted by all texts)."""
    blocks: list[list[float]] = []  # positives, all texts, steps
    scale = prior * counts_u.sum() / max(1.0, counts_p.sum())
    for u, p in zip(counts_u.tolist(), (counts_p * scale).tolist(), strict=True):
        blocks.append([p, u, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.concatenate([np.full(int(n), min(1.0, p / u) if u else 0.0) for p, u, n in blocks])


def _step(scores: np.ndarray) -> np.ndarray:
    return np.minimum(((scores + 2.0) / 4.0 * STEPS).astype(np.int64), STEPS - 1)


class Scorer:
    """A fitted classifier: weights, and the calibrated probability of each step of the linear score. A few kilobytes."""

    def __init__(self, weights: np.ndarray, curve: np.ndarray):
        self.weights, self.curve = weights, curve

    def __call__(self, texts: pa.Array) -> np.ndarray:
        scores = weigh(_places(texts), self.weights)
        # the linear score breaks ties inside a step, by less than a step of the curve can
        return np.clip(self.curve[_step(scores)] * 0.999 + (scores + 2.0) / 4000.0, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on the trusted positives of `labels` and all texts of `docs`; without positives every score is about 0.5."""
    positives = trusted_positives(labels)
    sums = gather(docs, positives)
    if not sums["p"][0, 0]:
        return Scorer(np.zeros(WIDTH), np.full(STEPS, 0.5))
    prior = class_prior(sums)
    w = fit(sums, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, STEPS), np.int64)
        for batch in batches:
            steps = _step(weigh(_places(batch.column("text")), w))
            chosen = batch.column("chosen").to_numpy(zero_copy_only=False).astype(bool)
            counts[0] += np.bincount(steps, minlength=STEPS)
            counts[1] += np.bincount(steps[chosen], minlength=STEPS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS)), pa.array(counts[0]), pa.array(counts[1])], ["step", "u", "p"])

    counted = _marked(docs, positives).mapInArrow(run, "step bigint, u bigint, p bigint")
    found = {r["step"]: (r["u"], r["p"]) for r in counted.groupBy("step").agg(F.sum("u").alias("u"), F.sum("p").alias("p")).collect()}
    u, p = (np.array([found.get(k, (0, 0))[side] for k in range(STEPS)], float) for side in (0, 1))
    return Scorer(w, calibrate(u, p, prior))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs` (doc_id, text), learnt from `labels` (doc_id, quality).

    Rows of fold 0 never lend their labels. Score is the calibrated probability of label 1. Null and empty texts have the features of no text, and a score like any other; a null id is
    held out of nothing (held_out false) and is unlabelled; repeated rows are each scored and each count; without
    positives all scores are about 0.5. An empty table gives an empty result; other columns are ignored."""
    score = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score(batch.column("text")))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    scored = held.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of `docs`, with all columns, that the classifier accepts; scored where they lie, without a shuffle."""
    score = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column("text")) >= threshold))

    return docs.mapInArrow(run, docs.schema)
