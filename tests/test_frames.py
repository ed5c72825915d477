"""Near-duplicate frames against a comparison with all kept ones."""

import random

import pytest

from talkloom.operators import frames as fr

SCHEMA = "scene string, image_index long, ts_ms long, frame_role string, phash long, sharpness double"


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def corpus(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for scene, n in sizes.items():
        seeds = [rng.getrandbits(64) for _ in range(max(1, n // 12))]
        for k in range(n):
            h = rng.choice(seeds)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 9])):
                h ^= 1 << rng.randrange(64)
            rows.append((scene, k * 7 % n if n % 7 else k, rng.randrange(0, 2 * n), rng.choice(["sample"] * 9 + ["keyframe"]), None if rng.random() < 0.01 else signed(h), float(rng.randrange(50))))
    return rows


def distance(a, b):
    return ((a ^ b) & ((1 << 64) - 1)).bit_count()


def one_by_one(rows, most, floor):
    out = {}
    for scene in {r[0] for r in rows}:
        frames = sorted(((r[2], r[1], r[3], r[4], r[5]) for r in rows if r[0] == scene), key=lambda f: f[:2])
        keyed = [f for f in frames if f[2] == "keyframe"]
        protected = keyed[0][1] if keyed else min(f[1] for f in frames)
        kept, dropped = [], []
        for ts, index, _, h, sharp in frames:
            match = next(((i, distance(k, h)) for i, k in kept if h is not None and k is not None and distance(k, h) <= most), None)
            if index == protected or match is None:
                kept.append((index, h))
                out[scene, index] = (True, None, None)
            else:
                dropped.append((-sharp, ts, index))
                out[scene, index] = (False, *match)
        for _, _, index in sorted(dropped)[: max(0, floor - len(kept))]:
            out[scene, index] = (True, None, None)
    return out


@pytest.mark.parametrize("most, floor", [(0, 1), (3, 4), (6, 2), (9, 40), (20, 3)])
def test_kept_frames_equal_the_sequential_rule(spark, most, floor):
    rows = corpus(most, {"hot": 600 if most < 16 else 300, "a": 40, "b": 8, "c": 1, "d": 90})
    got = fr.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(5), ["scene"], max_distance=most, min_frames=floor).collect()
    found = {(r["scene"], r["image_index"]): (r["kept"], r["matched_index"], r["distance"]) for r in got}
    assert len(got) == len(rows) and found == one_by_one(rows, most, floor)


@pytest.mark.parametrize("most", [0, 2, 5, 8, 15, 22])
def test_pairs_equal_all_pairs(spark, most):
    rows = corpus(30 + most, {"hot": 400, "a": 60, "b": 2})
    got = sorted((r["scene"], r["left_index"], r["right_index"], r["distance"]) for r in fr.hamming_pairs(spark.createDataFrame(rows, SCHEMA), ["scene"], most).collect())
    hashed = [r for r in rows if r[4] is not None]
    want = sorted((a[0], a[1], b[1], d) for a in hashed for b in hashed if a[0] == b[0] and a[1] < b[1] and (d := distance(a[4], b[4])) <= most)
    assert got == want


def test_a_scene_of_very_many_frames(spark):
    """A hundred thousand frames of a still camera with some noise, and as many hashes that have nothing in common."""
    frames = spark.range(100_000).selectExpr(
        "'s' AS scene", "id AS image_index", "id * 40 AS ts_ms", "'sample' AS frame_role",
        "CASE WHEN id % 2 = 0 THEN shiftleft(1L, int(id div 2 % 3)) ELSE xxhash64(id) END AS phash", "double(id % 9) AS sharpness",
    )
    got = fr.drop_near_duplicates(frames, ["scene"], max_distance=3, min_frames=1)
    row = got.selectExpr("count(*) AS n", "count_if(kept AND image_index % 2 = 0) AS still", "count_if(kept AND image_index % 2 = 1) AS others", "max(distance) AS d").first()
    assert row["n"] == 100_000 and row["still"] == 1 and row["others"] > 49_900 and row["d"] <= 3
