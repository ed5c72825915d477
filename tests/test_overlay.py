"""List order of inserted claims against a sequential list."""

import random

from talkloom.operators import overlay as ov

SHAPE = "struct<claim_id:string,claim_type:string,subject:string,claim:string,rationale:string,confidence:string>"
EDITS = f"job_id string, edit_seq long, claim_id string, action string, claim {SHAPE}, insert_after string"
CLAIMS = f"job_id string, claim_pos long, claim_id string, claim {SHAPE}"


def claim(name):
    return (name, "rule", "s", "t", "r", "low")


def one_by_one(claims, edits):
    lists = {}
    for job, _, name, _ in claims:
        lists.setdefault(job, []).append(name)
    gone = set()
    for job, _, name, action, _, after in sorted(edits, key=lambda e: e[1]):
        order = lists.setdefault(job, [])
        if action == "delete":
            gone.add((job, name))
            if name in order:
                order.remove(name)
        elif (job, name) not in gone and name not in order:
            order.insert(order.index(after) + 1, name) if after in order else order.append(name)
    return lists


def folded(spark, claims, edits):
    got = ov.fold_edits(spark.createDataFrame(claims, CLAIMS), spark.createDataFrame(edits, EDITS)).select("job_id", "order_key", "claim_id").collect()
    lists = {}
    for job, _, name in sorted((r["job_id"], r["order_key"], r["claim_id"]) for r in got):
        lists.setdefault(job, []).append(name)
    return lists


def test_ten_thousand_chained_inserts_take_some_fifteen_rounds(spark, monkeypatch):
    written = []
    real = ov.materialise
    monkeypatch.setattr(ov, "materialise", lambda df: written.append(1) or real(df))
    claims = [("j", 0, "c0", claim("c0")), ("j", 1, "c1", claim("c1"))]
    edits = [("j", n, f"n{n}", "add", claim(f"n{n}"), f"n{n - 1}" if n else "c0") for n in range(10_000)]
    assert folded(spark, claims, edits) == one_by_one(claims, edits)
    assert len(written) < 24


def test_random_forests_with_a_hot_anchor(spark):
    rng = random.Random(7)
    claims = [(f"j{j}", k, f"c{k}", claim(f"c{k}")) for j in range(3) for k in range(6)]
    edits, names = [], {f"j{j}": [f"c{k}" for k in range(6)] for j in range(3)}
    for n in range(600):
        job = rng.choice(["j0", "j0", "j1", "j2"])
        if rng.random() < 0.12:
            edits.append((job, n, rng.choice(names[job]), "delete", None, None))
            continue
        after = "c2" if rng.random() < 0.4 else rng.choice([*names[job], "nowhere", None, f"n{n + 1}"])
        edits.append((job, n, f"n{n}", "add", claim(f"n{n}"), after))
        names[job].append(f"n{n}")
    want = one_by_one(claims, edits)
    assert folded(spark, claims, edits) == {j: order for j, order in want.items() if order}
