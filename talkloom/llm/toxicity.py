"""Toxicity by two Kneser-Ney models, one of toxic text and one of ordinary text.

Both are interpolated: pairs of word classes back off to words, words to the counts of the whole corpus, labelled or
not, which both models share, and those to continuation counts (in how many contexts a word occurs). Most of the weight
lies on the shared counts, so an expression that is rare in one class is smoothed by what all text knows of it, and
only what a class has far too often tells. A text is scored by the difference of the two mean log likelihoods per word,
and a logistic curve fitted on labelled rows that no count has seen turns it into a probability.

Words are hashed into WORDS places and, for pairs, into CLASSES classes, so a model has a fixed size whatever the
corpus. Counting is one pass whose partial tables are summed by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom.llm.common import SIGNS, fold, word_hashes

WORDS = 1 << 20
CLASSES = 1 << 9
#: Contexts are told apart by a hash of this many values; their number is found by linear counting.
CONTEXTS = 32
#: Weight of the shared counts against a class's own, for words and for pairs.
SHARED_WORDS, SHARED_PAIRS = 0.99, 0.9995
#: Taken off each count of a word in a class and left to the shared counts: so few occurrences tell nothing of a class.
CLASS_DISCOUNT = 3.0
#: Labelled rows taken at most, chosen by hash; they are broadcast to the texts (12 bytes each).
MOST_LABELS = 1 << 18
#: Labelled rows of this fold fit the curve, those of the others but 0 the counts.
CURVE_FOLD = 4


def _tokens(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of each word, its pair of classes, and the hash of what stands before it (0 at a text's start)."""
    before = np.zeros_like(hashes)
    before[1:] = hashes[:-1]
    before[offsets[:-1][offsets[:-1] < len(hashes)]] = 0
    pair = (before >> np.uint64(55)) * np.uint64(CLASSES) + ((hashes >> np.uint64(20)) & np.uint64(CLASSES - 1))
    return (hashes >> np.uint64(44)).astype(np.int64), pair.astype(np.int64), before


def known_labels(labels: DataFrame, most: int = MOST_LABELS) -> DataFrame:
    """doc_id, toxic, curve of rows outside fold 0 that are labelled, and always alike; beyond `most` a part chosen by hash."""
    told = labels.where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id")) != 0)
    sure = told.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    share = F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(1 << 40)) < int((1 << 40) * min(1.0, most / max(1, sure.count())))
    return sure.where(share).select("doc_id", F.col("toxic").cast("int").alias("toxic"), (fold(F.col("doc_id")) == CURVE_FOLD).alias("curve"))


def count_words(marked: DataFrame) -> pa.Table:
    """key, ordinary, toxic, whole, contexts: counts by word (key below WORDS) and by pair of classes (above), over all rows.

    `marked`: text, and toxic (0, 1, or -1 for texts that count for the whole only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(WORDS, np.int64) for _ in range(3)]
        pairs = [np.zeros(CLASSES * CLASSES, np.int64) for _ in range(3)]
        seen = np.zeros(WORDS * CONTEXTS, bool)
        for batch in batches:
            marks = batch.column("toxic").to_numpy()
            for first, hashes, offsets in word_hashes(batch.column("text"), SIGNS):
                word, pair, before = _tokens(hashes, offsets)
                seen[word * CONTEXTS + (before & np.uint64(CONTEXTS - 1)).astype(np.int64)] = True
                mark = np.repeat(marks[first : first + len(offsets) - 1], np.diff(offsets))
                for c in (0, 1):
                    if (mark == c).any():
                        counts[c] += np.bincount(word[mark == c], minlength=WORDS)
                        pairs[c] += np.bincount(pair[mark == c], minlength=CLASSES * CLASSES)
                counts[2] += np.bincount(word, minlength=WORDS)
                pairs[2] += np.bincount(pair, minlength=CLASSES * CLASSES)
        bits = seen.reshape(WORDS, CONTEXTS) @ (1 << np.arange(CONTEXTS, dtype=np.int64)) if seen.any() else np.zeros(WORDS, np.int64)
        used, met = np.flatnonzero(counts[2]), np.flatnonzero(pairs[2])
        columns = [np.concatenate([used, WORDS + met]), *(np.concatenate([counts[c][used], pairs[c][met]]) for c in range(3))]
        columns.append(np.concatenate([bits[used], np.zeros(len(met), np.int64)]))
        for start in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[start : start + (1 << 16)]) for c in columns], ["key", *names])

    names = ["ordinary", "toxic", "whole", "contexts"]
    parts = marked.select("text", "toxic").mapInArrow(run, "key bigint, " + ", ".join(f"{name} bigint" for name in names))
    summed = parts.groupBy("key").agg(*[F.sum(name).alias(name) for name in names[:3]], F.bit_or("contexts").alias("contexts"))
    return summed.toArrow()  # WORDS + CLASSES^2 rows at most


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


def _backed(counts: np.ndarray, shared: np.ndarray, discount: float | None = None) -> np.ndarray:
    """Kneser-Ney probabilities: discounted counts, and what was taken off spread by the shared distribution."""
    d, total = discount or _discount(counts), counts.sum(axis=-1, keepdims=True)
    taken = np.minimum(counts, d).sum(axis=-1, keepdims=True)
    found = (np.maximum(counts - d, 0) + taken * shared) / np.maximum(total, 1)
    return np.where(total > 0, found, shared)


def log_ratios(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """What each word, and each pair of classes, adds to the difference of the log likelihoods, toxic less ordinary."""
    key = table["key"].to_numpy()
    columns = {}
    for name in ("ordinary", "toxic", "whole", "contexts"):
        full = np.zeros(WORDS + CLASSES * CLASSES, np.int64)
        full[key] = table[name].to_numpy()
        columns[name] = full
    bits = columns["contexts"][:WORDS]
    filled = np.zeros(WORDS, np.int64)
    for k in range(CONTEXTS):
        filled += (bits >> k) & 1
    contexts = 0.05 - CONTEXTS * np.log1p(-np.minimum(filled, CONTEXTS - 0.5) / CONTEXTS)
    shared = _backed(columns["whole"][:WORDS], contexts / contexts.sum())
    ordinary, toxic = (_mixed(columns[c][:WORDS], shared, SHARED_WORDS, CLASS_DISCOUNT) for c in ("ordinary", "toxic"))
    pairs = {c: columns[c][WORDS:].reshape(CLASSES, CLASSES) for c in ("ordinary", "toxic", "whole")}
    follows = (pairs["whole"] > 0).sum(axis=0) + 0.05
    classes = _backed(pairs["whole"].sum(axis=0), follows / follows.sum())
    after = _backed(pairs["whole"], classes[None, :])
    lift = {}
    for c in ("ordinary", "toxic"):  # how much likelier a class of words is after a context than by itself
        lift[c] = np.log(_mixed(pairs[c], after, SHARED_PAIRS) / _mixed(pairs[c].sum(axis=0), classes, SHARED_PAIRS)[None, :])
    return np.log(toxic / ordinary).astype(np.float32), (lift["toxic"] - lift["ordinary"]).ravel().astype(np.float32)


def _mixed(counts: np.ndarray, shared: np.ndarray, weight: float, discount: float | None = None) -> np.ndarray:
    return (1 - weight) * _backed(counts, shared, discount) + weight * shared


def text_ratios(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], others: list[str]) -> DataFrame:
    """others, n_words, ratio: the mean over a text's words of the log likelihood ratio (0 without words)."""
    by_word, by_pair = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, means = [], []
            for _, hashes, offsets in word_hashes(batch.column("text"), SIGNS):
                word, pair, _ = _tokens(hashes, offsets)
                sums = np.concatenate([[0.0], np.cumsum(by_word[word] + by_pair[pair], dtype=np.float64)])
                n = np.diff(offsets)
                sizes.append(n)
                means.append((sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1))
            n, mean = (np.concatenate(x) if x else np.zeros(0) for x in (sizes, means))
            kept = [batch.column(name) for name in others]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n.astype(np.int64)), pa.array(mean.astype(np.float64))], [*others, "n_words", "ratio"])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*others).schema)
    return docs.select(*others, "text").mapInArrow(run, schema + "n_words bigint, ratio double")


def _inputs(n_words: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """What the curve sees: the mean ratio, the same by the root of the length, and the length."""
    return np.stack([ratio, ratio * np.sqrt(n_words), np.log1p(n_words)], axis=1)


def fit_curve(n_words: np.ndarray, ratio: np.ndarray, toxic: np.ndarray, n: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Constant and weights of a logistic curve, by Newton steps on a ridged likelihood of standardised inputs; n counts equal rows."""
    x = _inputs(n_words, ratio)
    middle = np.average(x, axis=0, weights=n)
    spread = np.sqrt(np.average((x - middle) ** 2, axis=0, weights=n)) + 1e-12
    x, w = np.column_stack([np.ones(len(x)), (x - middle) / spread]), np.zeros(4)
    held = ridge * np.array([0.0, 1.0, 1.0, 1.0]) + 1e-9
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.clip(np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (n * (toxic - p)) - held * w), -3, 3)
    if min(w[1], w[2]) < 0:  # too few rows: a likelier toxic text never scores less
        w[1:3] = max(w[1] + w[2], 0.0), 0.0
    return np.concatenate([[w[0] - (w[1:] * middle / spread).sum()], w[1:] / spread])


def curve_rows(docs: DataFrame, known: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> pa.Table:
    """toxic, n_words, ratio, n: all labelled texts of the curve's fold, equal rows counted; where it lacks a class, all
    labelled texts, those whose words were counted too. Of MOST_LABELS ids at most."""

    def measured(told: DataFrame) -> pa.Table:
        found = text_ratios(docs.select("doc_id", "text").join(F.broadcast(told), "doc_id"), model, ["toxic"])
        return found.groupBy("toxic", "n_words", "ratio").agg(F.count("*").alias("n")).toArrow()

    rows = measured(known.where("curve"))
    return rows if len(set(rows["toxic"].to_pylist())) == 2 else measured(known)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, ratio for every row of `docs` (doc_id, text), learnt from `labels` (doc_id, toxic).

    Rows of fold 0 never lend their labels. Null and empty texts have ratio 0 and the score of that; a null id is held
    out of nothing (held_out false) and unlabelled; repeated rows are each scored and each count; where one class has no
    labelled rows outside fold 0 all scores are 0. An empty table gives an empty result; other columns are ignored."""
    known = known_labels(labels)
    # at most MOST_LABELS rows, so the broadcast has a bound, and texts are not shuffled
    marked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left")
    model = log_ratios(count_words(marked.select("text", F.when(F.col("curve"), -1).otherwise(F.coalesce("toxic", F.lit(-1))).alias("toxic"))))
    curve = curve_rows(docs, known, model)
    toxic = curve["toxic"].to_numpy()
    learnt = bool((toxic == 1).any() and (toxic == 0).any())
    w = fit_curve(*(curve[c].to_numpy() for c in ("n_words", "ratio", "toxic", "n"))) if learnt else np.zeros(4)
    held = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    found = text_ratios(held, model, ["doc_id", "held_out"])
    n, ratio = F.col("n_words"), F.col("ratio")
    z = F.lit(float(w[0])) + float(w[1]) * ratio + float(w[2]) * ratio * F.sqrt(n) + float(w[3]) * F.log1p(n)
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))) if learnt else F.lit(0.0)
    return found.withColumn("score", score).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "ratio")
