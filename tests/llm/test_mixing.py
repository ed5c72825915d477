"""Targets, apportionment and the mix against brute force."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest

from talkloom.llm import mixing as mx

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, taken string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_targets(sizes, weights):
    """Share the excess again by weight until nothing is above twice its size."""
    full, total = set(), Fraction(3, 2) * sum(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        left, weight = total - sum(2 * sizes[i] for i in full), sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > 2 * sizes[i]]
        if not over:
            return [2 * sizes[i] if i in full else float(left * weights[i] / weight) for i in range(len(sizes))]
        full.update(over)


def slow_seats(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (Fraction(votes[i]) / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize("seed", range(20))
def test_targets_and_seats(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 100, 10_000]) * rng.randrange(1, 9) for _ in range(rng.randrange(1, 12))]
    weights = [mx.WEIGHTS[i % 3] for i in range(len(sizes))]
    assert mx.targets(sizes, weights) == pytest.approx(slow_targets(sizes, weights))
    votes = [rng.randrange(0, 50) for _ in sizes]
    if sum(votes):
        for seats in (0, 1, 7, 60):
            assert mx.sainte_lague(votes, seats) == slow_seats(votes, seats)
        quotas = mx.shard_quotas(votes, 60, 8)
        assert all(a <= b for x, y in zip(quotas, quotas[1:], strict=False) for a, b in zip(x, y, strict=True))


def corpus():
    rng = random.Random(3)
    rows = []
    for i in range(400):
        source = rng.choice(["hot"] * 5 + ["a", "é", "Z", None])
        text = rng.choice(["", None, "  \n"]) if i % 40 == 0 else "".join(f"w{rng.randrange(99)}" + rng.choice([" ", "\n", "  "]) for _ in range(rng.randrange(1, 300)))
        rows.append((i, text, "en", source, len(text or ""), "clash"))
    return [*rows, rows[5], rows[5], (None, "no id here", None, "a", None, None)]


def test_the_mix_comes_near_its_targets(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mx.mixed_documents(frame).collect()
    assert sorted(map(str, got)) == sorted(map(str, mx.mixed_documents(frame.repartition(7)).collect()))
    size = lambda t: len(WORD.findall(t or ""))
    totals = Counter()
    for _, t, _, s, _, _ in rows:
        totals[s] += size(t)
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    aims = dict(zip(names, slow_targets([totals[s] for s in names], [mx.WEIGHTS[i % 3] for i in range(len(names))]), strict=True))
    quotas = mx.shard_quotas(list(aims.values()), round(sum(aims.values())), 8)
    assert Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == Counter(
        (i, size(t), totals[s], round(aims[s], 6)) for i, t, _, s, _, _ in rows
    )
    taken, source = Counter(), {i: s for i, _, _, s, _, _ in rows}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
    for s in names:
        assert abs(taken[s] - aims[s]) <= 1, (s, taken[s], aims[s])
    by_shard = Counter()
    for r in got:
        assert sum(r["shard_words"]) == r["taken"]
        for k, words in enumerate(r["shard_words"]):
            by_shard[r["source"], k] += words
    for n, s in enumerate(names):  # quotas of every shard, exactly
        won = [min(q[n], 2 * totals[s]) for q in quotas]
        assert [by_shard[s, k] for k in range(8)] == [b - a for a, b in zip([0, *won], won, strict=False)]


def test_small_sources_meet_their_targets(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(10)), "en", f"s{i:03}", 0, "") for i in range(200)]
    rows += [(1000 + i, f"one{i}", "en", f"t{i:03}", 0, "") for i in range(50)]
    got = mx.mixed_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in got) and abs(sum(r["taken"] for r in got) - 1.5 * 2050) <= 2


def test_blocks_of_several_words_and_shards_of_uses(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mx.mixed_documents(frame, block=16).collect()
    totals, taken, aim = Counter(), Counter(), {}
    for r in got:
        totals[r["source"]], aim[r["source"]] = r["source_size"], r["target"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - aim[s]) <= 32 for s in totals)
    shards = mx.mix(frame, shard="part")
    assert shards.columns == [*frame.columns, "part"] and {r["part"] for r in shards.select("part").collect()} == set(range(8))


def test_a_row_that_is_repeated_very_often(spark):
    rows = [(1, "a b c", "en", "hot", 5, "")] * 300 + [(k, "d e", "en", "hot", 3, "") for k in range(2, 80)]
    got = mx.mixed_documents(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == 378 and sum(r["taken"] for r in got) == round(1.5 * (900 + 156)) and all(r["taken"] <= 2 * r["size"] for r in got)


def test_mixed_texts_hold_what_was_taken(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, SCHEMA)
    want = Counter()
    for r in mx.mixed_documents(frame).collect():
        want[r["doc_id"]] += r["taken"]
    out = mx.mix(frame)
    assert out.columns == frame.columns
    got, whole = Counter(), {i: t for i, t, *_ in rows}
    for r in out.collect():
        words = WORD.findall(r["text"])
        got[r["doc_id"]] += len(words)
        assert words and r["n_chars"] == len(r["text"]) and r["taken"] == ("clash" if r["doc_id"] is not None else None)
        left = iter(WORD.findall(whole[r["doc_id"]]))
        assert all(w in left for w in words)  # in order
    assert got == +want


def test_documents_are_taken_whole_but_for_one_of_a_source(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 5]
    rng = random.Random(4)
    rows += [(1000 + i, " ".join(f"w{rng.randrange(99)}" for _ in range(512)), "en", source, 0, "") for i, source in enumerate(["hot", "a", "Z", None] * 20)]
    whole, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    frame = spark.createDataFrame(rows, SCHEMA)
    cut, used = Counter(), Counter()
    for r in mx.mix(frame).collect():
        used[source[r["doc_id"]]] += 1
        if r["text"] != whole[r["doc_id"]]:
            assert whole[r["doc_id"]].lstrip().startswith(r["text"].lstrip())  # no holes
            cut[source[r["doc_id"]]] += 1
    assert len(used) == 5 and max(cut.values()) == 1
    other = lambda seed: Counter(r["doc_id"] for r in mx.mix(frame, seed=seed).select("doc_id").collect())
    assert other(7) != other(8)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mx.mixed_documents(empty).count() == 0 and mx.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, None, None), (2, " ", "x", "y", 1, "")], SCHEMA)
    assert sorted((r["doc_id"], r["size"], r["target"], r["taken"]) for r in mx.mixed_documents(blank).collect()) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mx.mix(blank).count() == 0
    sizes = defaultdict(int, {None: 10})
    assert mx.source_plan(sizes)[0][1] is None
