"""Block-wise sequence operators against plain Python, with blocks small enough to be crossed often."""

import random

import pytest
from pyspark.sql import functions as F

from talkloom.config import ChunkLimits, SegmentLimits
from talkloom.operators import chunks as ch
from talkloom.operators import sequence as seq
from talkloom.operators import transcript as tr


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = [("hot", i, rng.randint(0, 9)) for i in range(500)] + [("small", i, rng.randint(0, 9)) for i in range(3)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, pos long, v long")


def _by_key(df, *cols):
    out = {}
    for r in df.collect():
        out.setdefault(r["k"], []).append(tuple(r[c] for c in ("pos", *cols)))
    return {k: sorted(v) for k, v in out.items()}


def test_running_crosses_blocks(rows):
    got = _by_key(seq.running(rows, ["k"], "pos", {"s": F.col("v")}, {"m": F.when(F.col("v") == 9, F.col("pos"))}, block=16), "v", "s", "m")
    for seqn in got.values():
        total, latest = 0, None
        for pos, v, s, m in seqn:
            total += v
            latest = pos if v == 9 else latest
            assert (s, m) == (total, latest)


def test_neighbours_cross_blocks(rows):
    got = _by_key(
        seq.neighbour_window(rows, ["k"], "pos", lambda w: {"p": F.lag("v", 2).over(w), "n": F.lead("v", 3).over(w)}, back=2, ahead=3, block=16), "v", "p", "n"
    )
    assert sum(len(v) for v in got.values()) == 503
    for seqn in got.values():
        vs = [x[1] for x in seqn]
        for i, (_, _, p, n) in enumerate(seqn):
            assert p == (vs[i - 2] if i >= 2 else None)
            assert n == (vs[i + 3] if i + 3 < len(vs) else None)


def test_neighbours_with_holes(spark):
    data = [("a", p, p) for p in (0, 15, 16, 17, 40, 200, 201)]
    got = seq.neighbour_window(spark.createDataFrame(data, "k string, pos long, v long"), ["k"], "pos", lambda w: {"p": F.lag("v").over(w), "n": F.lead("v").over(w)}, block=4, dense=False)
    rows = sorted((r["pos"], r["p"], r["n"]) for r in got.collect())
    values = [d[2] for d in data]
    assert rows == list(zip(values, [None, *values], [*values[1:], None]))


def test_positions_along_any_columns(spark):
    rng = random.Random(1)
    data = [("hot", 5, f"t{rng.randrange(10**6)}") for _ in range(2000)] + [("small", i, "x") for i in range(5)]
    frame = spark.createDataFrame(data, "k string, at long, text string").repartition(7)
    for k in ("hot", "small"):
        rows = sorted((r["position"], r["at"], r["text"]) for r in seq.ranked_position(frame, ["k"], ["at", "text"], "position").where(F.col("k") == k).collect())
        assert [r[0] for r in rows] == list(range(len(rows))) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


def _sum_limit(limit, longest):
    def next_start(cols, i, n):
        total, j = 0, i
        while j < n and j - i < longest and (j == i or total + cols["v"][j] <= limit):
            total += cols["v"][j]
            j += 1
        return -1 if j >= n else j

    return next_start


@pytest.mark.parametrize("block", [16, 64, 1 << 17])
def test_greedy_is_the_same_for_every_block_size(rows, block):
    got = _by_key(seq.bounded_greedy(rows, ["k"], "pos", ["v"], _sum_limit(12, 6), reach=8, block=block), "group")
    values = _by_key(rows, "v")
    for k, seqn in values.items():
        vs, i, g, want = [v for _, v in seqn], 0, 0, []
        while i < len(vs):
            j = _sum_limit(12, 6)({"v": vs}, i, len(vs))
            j = len(vs) if j < 0 else j
            want += [(p, g) for p in range(i, j)]
            i, g = j, g + 1
        assert got[k] == want


@pytest.mark.parametrize("block,reach,limit", [(64, 4, 400), (128, 300, 40), (128, 2, 10**6), (1 << 17, 4, 400)])
def test_greedy_carries_long_groups_over_blocks(rows, block, reach, limit):
    rule = _sum_limit(limit, 10**6)
    got = _by_key(seq.bounded_greedy(rows, ["k"], "pos", ["v"], rule, reach=reach, block=block), "group")
    for k, seqn in _by_key(rows, "v").items():
        vs, i, g, want = [v for _, v in seqn], 0, 0, []
        while i < len(vs):
            j = rule({"v": vs}, i, len(vs))
            j = len(vs) if j < 0 else j
            want += [(p, g) for p in range(i, j)]
            i, g = j, g + 1
        assert got[k] == want


def test_first_n_per_hot_key(rows):
    got = seq.first_n(rows, ["k"], ["pos"], 5, spread="pos", parts=4).groupBy("k").agg(F.sort_array(F.collect_list("pos")).alias("p")).collect()
    assert {r["k"]: r["p"] for r in got} == {"hot": [0, 1, 2, 3, 4], "small": [0, 1, 2]}


def _segments(spark, n=300, seed=3):
    rng = random.Random(seed)
    data, t = [], 0
    for i in range(n):
        ms = rng.choice([800, 2000, 4900, 9000, 20000])
        role = rng.choice(["offscreen_questioner", "host", "host"])
        data.append(("v", i, f"s{i}", t, t + ms, i * 10, i * 10 + 9, rng.randint(1, 60), role, role, f"text {i}"))
        t += ms + rng.choice([0, 300, 13000])
    return spark.createDataFrame(
        data, "video_id string, seg long, segment_id string, start_ms long, end_ms long, start_pos long, end_pos long, words long, speaker string, speaker_role string, text string"
    )


def test_planner_windows_and_plan_in_blocks(spark):
    segs = _segments(spark)
    limits = ChunkLimits(window_segments=7, max_segments=4, max_words=90)
    flat = [tuple(r) for r in ch.planner_windows(segs, limits).orderBy("window_index").collect()]
    assert flat == [tuple(r) for r in ch.planner_windows(segs, limits, block=16).orderBy("window_index").collect()]
    marked = {r["seg"]: r["asks_next"] for r in ch.mark_questions(segs, limits).collect()}
    assert all(not marked[w[3]] for w in flat[:-1] if w[3] - w[2] > 0)
    plan = ch.propose_plan(segs, limits, block=16).orderBy("chunk_index").collect()
    assert [r["speech_segment_ids"] for r in plan] == [r["speech_segment_ids"] for r in ch.propose_plan(segs, limits).orderBy("chunk_index").collect()]
    assert [x for r in plan for x in r["speech_segment_ids"]] == [f"s{i}" for i in range(300)]
    assert ch.plan_errors(ch.propose_plan(segs, limits), segs, limits).where("error_class NOT IN ('question_answer_split')").count() == 0


def test_short_segments_merge_like_a_left_fold(spark):
    segs = _segments(spark, 200, 5)
    data = [r.asDict() for r in segs.orderBy("seg").collect()]
    merged, cur = [], dict(data[0])
    for nxt in data[1:]:
        same = cur["speaker"] == nxt["speaker"] and cur["end_pos"] + 1 == nxt["start_pos"]
        short = cur["end_ms"] - cur["start_ms"] < 5000 or nxt["end_ms"] - nxt["start_ms"] < 5000
        fits = nxt["end_ms"] - cur["start_ms"] <= 60250 and cur["words"] + nxt["words"] <= 150
        if same and short and fits:
            cur.update(end_ms=nxt["end_ms"], end_pos=nxt["end_pos"], words=cur["words"] + nxt["words"])
        else:
            merged.append(cur)
            cur = dict(nxt)
    merged.append(cur)
    for block in (160, 1 << 17):
        got = tr.merge_short_segments(segs, block=block).orderBy("seg").collect()
        assert [(r["start_ms"], r["end_ms"], r["words"]) for r in got] == [(m["start_ms"], m["end_ms"], m["words"]) for m in merged]


def _units_by_hand(tokens, limits):
    """Reference fold over content tokens without blanks, as a plain loop."""
    units, start, words = [], 0, 0
    for i, (text, s, e, who) in enumerate(tokens):
        words += 1 if i == start or text[:1].isspace() else 0
        nxt = tokens[i + 1] if i + 1 < len(tokens) else None
        ends = text.strip().rstrip("\"')»”]}").rstrip()[-1:]
        reason, ms = None, e - tokens[start][1]
        safe = nxt is None or ends in ".!?…" or (ends not in ",;:" and nxt[0][:1].isspace() and not nxt[0].strip()[:1].islower())
        if nxt is None:
            reason = "end"
        elif who and nxt[3] and who != nxt[3]:
            reason = "speaker_change"
        elif nxt[1] - e >= limits.pause_break_ms:
            reason = "pause"
        elif ends in ".!?…":
            reason = "sentence_end"
        elif ends in ";:" and (ms >= limits.unit_clause_min_ms or words >= limits.unit_clause_min_words):
            reason = "strong_clause"
        elif ms >= limits.unit_max_ms and safe:
            reason = "soft_max_seconds"
        elif words >= limits.unit_max_words and safe:
            reason = "soft_max_words"
        if reason:
            units.append((start, i, reason, words))
            start, words = i + 1, 0
    return units


@pytest.mark.parametrize("block", [96, 1 << 17])
def test_units_with_soft_limits(spark, block):
    rng = random.Random(11)
    limits = SegmentLimits(unit_max_ms=4000, unit_max_words=12, unit_clause_min_ms=2500, unit_clause_min_words=8)
    tokens, t = [], 0
    for _ in range(700):
        word = rng.choice([" word", " Word", " Name", "s", " clause;", " list,", ' end."', " name:"])
        length = rng.choice([150, 200, 300])
        tokens.append((word, t, t + length, rng.choice(["a"] * 60 + ["b", None])))
        t += length + rng.choice([20] * 80 + [899, 900])
    df = spark.createDataFrame([("v", i, *x) for i, x in enumerate(tokens)], "video_id string, pos long, text string, start_ms long, end_ms long, speaker string")
    got = tr.transcript_units(df, limits, block=block, reach=64).orderBy("unit_index").collect()
    assert [(r["start_pos"], r["end_pos"], r["boundary_reason"], r["word_count"]) for r in got] == _units_by_hand(tokens, limits)


def test_short_keys_are_walked_many_at_a_time(spark):
    rng = random.Random(3)
    keys = [None, *range(40)]
    rows = [(k, p, rng.randint(1, 9)) for k in keys for p in range(rng.choice([1, 2, 5, 30]))]
    frame = spark.createDataFrame(rows, "k long, pos long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        grouped = seq.bounded_greedy(frame, ["k"], "pos", ["v"], _sum_limit(12, 6), reach=8)
        got = {(r["k"], r["pos"]): r["group"] for r in grouped.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, rule = {}, _sum_limit(12, 6)
    for k in keys:
        values = [v for key, _, v in sorted(r for r in rows if r[0] == k)]
        i, g = 0, 0
        while i < len(values):
            j = rule({"v": values}, i, len(values))
            j = len(values) if j < 0 else j
            want.update({(k, p): g for p in range(i, j)})
            i, g = j, g + 1
    assert got == want
    assert "FlatMapGroupsInPandas" not in grouped._jdf.queryExecution().toString()


def test_atoms_of_short_and_long_videos(spark):
    rng = random.Random(3)
    words = [" Wir", " und", " gehen", ".", ",", " ", "-", " Да", "Neu", " but", "!\"", " x", "e", " ", " (A"]
    rows = []
    for video, n in ((1, 90), (2, 7), (None, 40), (3, 1), (4, 31)):
        at = 0
        for pos in range(n):
            at += rng.choice([300, 400, 2000])
            rows.append((video, pos, rng.choice(words), at, at + 250, rng.choice(["a", "a", "a", "b", None]), "host", "xx"))
    tokens = spark.createDataFrame(rows, "video_id long, pos long, text string, start_ms long, end_ms long, speaker string, speaker_role string, language string").repartition(3)
    short = tr.transcript_atoms(tokens)
    seen = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert seen(short.where("video_id IS NOT NULL")) == seen(tr.transcript_atoms(tokens.where("video_id IS NOT NULL"), block=30)) == seen(tr.transcript_atoms(tokens.where("video_id IS NOT NULL"), block=1))
    short.collect()
    assert short._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # one shuffle, in the first and the final plan
