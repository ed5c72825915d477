"""Streams whose state must outlive watermarks, restarts and repeated batches."""

import random

from pyspark.sql import functions as F

from talkloom.operators import overlay as ov
from talkloom.session import ensure_checkpoint_dir
from talkloom.streaming import live

CLAIM = "struct<claim_id:string,claim_type:string,subject:string,claim:string,rationale:string,conditions:array<string>,applies_to:array<string>,avoid:array<string>,prefer:array<string>,evidence:array<string>,topics:array<string>,confidence:string>"


def folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{random.randrange(10**12)}"


def arrivals(spark, name, batches, schema):
    """A file stream that gets one file at a time."""
    where = folder(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where)
    return live.file_stream(spark, where, "*.parquet", schema, max_files=1)


def test_copies_a_day_apart_are_dropped(spark):
    day = 24 * 3600
    batches = [[(1, 0, "a"), (1, 0, "a"), (2, 5, "b")], [(3, day, "c"), (1, day, "a")], [(None, 2 * day, "n"), (2, 3 * day, "b"), (4, 9 * day, "d")], [(None, 9 * day, "n")]]
    stream = arrivals(spark, "log", batches, "event_id long, at long, event string").withColumn("ts", F.timestamp_seconds("at"))
    got = sorted(((r["event_id"], r["at"], r["event"]) for r in live.unique_events(stream, parts=3).collect()), key=str)
    assert got == [(1, 0, "a"), (2, 5, "b"), (3, day, "c"), (4, 9 * day, "d"), (None, 2 * day, "n")]


def test_a_batch_run_again_lets_the_same_rows_through(spark):
    index = live.SeenIndex(spark, folder(spark, "seen"), "k", "long", parts=4)
    first = spark.createDataFrame([(1,), (2,), (2,)], "k long")
    second = spark.createDataFrame([(2,), (3,)], "k long")
    for number, batch in ((0, first), (1, second), (1, second), (0, first), (1, second)):
        found = sorted(r["k"] for r in index.fresh(batch, number).collect())
        index.add(spark.createDataFrame([(k,) for k in found], "k long").withColumn("part", F.pmod(F.xxhash64("k"), F.lit(4)).cast("int")), number)
        assert found == ([1, 2] if number == 0 else [3])
    assert index.entries().count() == 3


def claim(job, k, text="text"):
    return (f"c{job}_{k}", "rule", "s", text, "because", [], [], [], [], [], [], "high")


def test_overlay_after_each_batch_equals_the_fold_so_far(spark):
    rng = random.Random(4)
    claims = spark.createDataFrame([(f"j{j}", k, f"cj{j}_{k}", claim(f"j{j}", k)) for j in range(4) for k in range(5)], f"job_id string, claim_pos long, claim_id string, claim {CLAIM}")
    schema = f"job_id string, edit_seq long, claim_id string, action string, claim {CLAIM}, insert_after string"
    batches, seq = [], 0
    for b in range(4):
        rows = []
        for _ in range(6):
            j, seq = f"j{rng.choice([0, 0, 0, b % 3])}", seq + 1
            action = rng.choice(["update", "delete", "add", "update"])
            name = f"cj{j[1:]}_{rng.randrange(5)}" if action != "add" else f"new{seq}"
            body = (name, *claim(j, 0, f"edit {seq}")[1:])
            rows.append((j, seq, name, action, body, f"cj{j[1:]}_{rng.randrange(5)}" if action == "add" else None))
        batches.append(rows)
    overlay = live.live_overlay(claims, arrivals(spark, "edits", batches, schema))
    seen = lambda df: sorted((r["job_id"], r["order_key"], r["claim_id"], r["claim"]["claim"], r["edited"]) for r in df.collect())

    def check():
        for b in range(4):
            upto = spark.createDataFrame([r for rows in batches[: b + 1] for r in rows], schema)
            got, want = seen(overlay.current(b)), seen(ov.fold_edits(claims, upto))
            assert [r[0::2] for r in got] == [r[0::2] for r in want] and [r[2:] for r in got] == [r[2:] for r in want]

    check()
    before = seen(overlay.current())
    for b in (1, 3):
        overlay.apply(spark.createDataFrame(batches[b], schema), b)
    assert seen(overlay.current()) == before
    check()


def test_every_overdue_start_is_reported_once(spark):
    rng = random.Random(9)
    hour = 3600
    rows = []
    for n in range(300):
        at = rng.randrange(hour, 60 * hour)
        rows.append((rng.choice(["start", "start", "end"]), n, rng.randrange(3), rng.choice(["a", "b", None]), at))
    rows += [("start", 900, 7, "a", hour), ("end", 901, 7, "a", 3 * hour), ("start", 902, 8, "a", hour), ("end", 903, 8, "a", 3 * hour + 1), ("start", 904, 9, "a", 60 * hour)]
    late = lambda r: r[4] + rng.randrange(0, 500)  # noqa: E731  arrival, out of order within the lateness
    rows.sort(key=late)
    schema = "kind string, event_id long, job_id long, stage string, at long"
    stream = arrivals(spark, "cycle", [rows[k : k + 80] for k in range(0, len(rows), 80)], schema).withColumn("ts", F.timestamp_seconds("at"))
    tick = spark.createDataFrame([("tick", None, None, None, 100 * hour)], schema).withColumn("ts", F.timestamp_seconds("at"))
    got = live.unfinished_stages(stream, 2 * hour * 10**6, [tick])
    found = sorted((r["event_id"], r["job_id"], r["stage"], r["started_us"] // 10**6) for r in got.collect())
    ends = [r for r in rows if r[0] == "end"]
    want = [r for r in rows if r[0] == "start" and not any(e[2:4] == r[2:4] and r[4] <= e[4] <= r[4] + 2 * hour for e in ends)]
    assert found == sorted(((r[1], r[2], r[3], r[4]) for r in want), key=lambda x: x[0]) and 904 in [r[0] for r in found]


def test_a_table_of_part_files_is_a_stream_too(spark):
    where = folder(spark, "tables")
    rows = spark.range(6).selectExpr("id AS k")
    rows.repartition(3).write.parquet(f"{where}/log.parquet")
    rows.repartition(3).write.parquet(f"{where}/other.parquet")
    table = live.run_to_table(live.file_stream(spark, where, "log.parquet", "k long"), "append")
    assert sorted(r["k"] for r in table.collect()) == list(range(6))


def test_overdue_starts_of_a_batch_run_again(spark):
    schema = "kind string, event_id long, job_id long, stage string, at long"
    batches = [
        [("start", 1, 1, "a", 100), ("start", 2, 1, "a", 150), ("start", 3, 1, None, 150), ("end", 4, 1, "a", 120), ("tick", None, None, None, 155)],
        [("start", 1, 1, "a", 100), ("start", 2, 1, "a", 150), ("start", 5, 2, "b", 160), ("end", 6, 1, "a", 210), ("end", 7, 2, "b", 200), ("start", 8, 2, "b", 190), (None, 9, 2, "b", None)],
        [("tick", None, None, None, 400), ("start", 10, 3, "c", 405)],
        [("start", 11, 3, "c", 300), ("start", 12, 3, "c", 396)],
    ]
    frames = [spark.createDataFrame(rows, schema) for rows in batches]
    overdue = live.OverdueStarts(spark, frames[0].schema, folder(spark, "overdue"), 50, 10)
    found = lambda: sorted(tuple(r) for r in overdue.reported().collect())
    want = [[], [(2, 1, "a", 150)], [(2, 1, "a", 150), (3, 1, None, 150)], [(2, 1, "a", 150), (3, 1, None, 150)]]
    for number, frame in enumerate(frames):
        overdue.apply(frame, number)
        first = found()
        overdue.apply(frame, number)
        assert found() == first
    # start 2 ends 60 after, start 3 never, starts 1, 5 and 8 in time; 11 comes behind the clock, 10 and 12 still wait
    assert first == want[3]
    overdue.apply(spark.createDataFrame([("tick", None, None, None, 1000)], schema), 4)
    assert found() == sorted([*want[3], (10, 3, "c", 405), (12, 3, "c", 396)])
