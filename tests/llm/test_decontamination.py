"""Planted passages, substitutions and clean texts."""

import itertools
import random

from talkloom.llm import decontamination as dc

DOCS = "doc_id bigint, text string, item_id string"
ITEMS = "item_id bigint, text string, doc_id string"


def slow_leaks(docs, items):
    """Every alignment of every text and item, without seeds."""
    split = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    found = set()
    for i, text in docs:
        w = split(text)
        for j, item in items:
            b = split(item)
            n = min(dc.STRETCH_WORDS, len(b))
            for offset in range(-len(b), len(w)) if b else ():
                same = [0 <= offset + k < len(w) and w[offset + k] == b[k] for k in range(len(b))]
                if any(5 * sum(same[s : s + n]) >= 4 * n and offset + s >= 0 and offset + s + n <= len(w) for s in range(len(b) - n + 1)):
                    found.add((i, j))
    return found


def test_leaks_equal_all_alignments(spark):
    rng = random.Random(6)
    word = lambda: f"v{rng.randrange(400)}"
    items = [(j, " ".join(word() for _ in range(rng.choice([1, 3, 5, 8, 9, 10, 11, 12, 13, 15, 40, 150])))) for j in range(30)]
    docs = [(100, None), (101, ""), (102, "short"), (None, items[4][1])]
    for i in range(150):
        body = [word() for _ in range(rng.randrange(0, 200))]
        if i % 2:
            planted = rng.choice(items)[1].split()
            planted = planted[rng.randrange(0, max(1, len(planted) - 15)) :] if rng.random() < 0.3 else planted
            for _ in range(rng.choice([0, 0, 1, 2])):
                planted[rng.randrange(len(planted))] = "other"
            at = rng.randrange(0, len(body) + 1)
            body[at:at] = planted
        docs.append((i, rng.choice([" ", "\n", " \t"]).join(body).upper() if i % 3 else " ".join(body)))
    got = dc.leaks(
        spark.createDataFrame([(*d, "clash") for d in docs], DOCS), spark.createDataFrame([(*x, "clash") for x in items], ITEMS)
    ).collect()
    want = slow_leaks(docs, items)
    assert sorted(((r["doc_id"], r["item_id"]) for r in got), key=str) == sorted(want, key=str)


def test_masks_meet_every_stretch_that_the_rule_accepts():
    for n in range(1, dc.STRETCH_WORDS + 1):
        masks = dc.short_masks(n) if n < dc.STRETCH_WORDS else dc.MASKS
        for bad in itertools.combinations(range(n), dc.substitutions(n)):
            places = range(1) if n < dc.STRETCH_WORDS else range(n)
            assert any(p + m[-1] < n and not {p + k for k in m} & {*bad} for p in places for m in masks), (n, bad)


def test_items_without_ids_or_under_one_id(spark):
    rng = random.Random(2)
    one, two, three, four = (" ".join(f"u{rng.randrange(10**6)}" for _ in range(n)) for n in (8, 20, 3, 9))
    items = spark.createDataFrame([(None, one, ""), (None, two, ""), (7, three, ""), (7, four, ""), (8, "", "")], ITEMS)
    changed = " ".join(["x", *four.split()[1:]])  # eight of nine words
    docs = [(1, f"a {one} b"), (2, two), (3, f"{three} c"), (4, f"{three} {changed}"), (5, three.replace(" ", "\n").upper()), (6, " ".join(three.split()[:2])), (None, one), (None, two)]
    got = dc.leaks(spark.createDataFrame([(*d, "") for d in docs], DOCS), items).collect()
    want = [(1, None, 8), (2, None, 20), (3, 7, 3), (4, 7, 3), (4, 7, 9), (5, 7, 3), (None, None, 8), (None, None, 20)]
    assert sorted(((r["doc_id"], r["item_id"], r["item_words"]) for r in got), key=str) == sorted(want, key=str)


def test_equal_items_equal_rows_and_empty_tables(spark):
    text = " ".join(f"t{k}" for k in range(20))
    docs = spark.createDataFrame([(1, f"x {text} y", ""), (1, f"x {text} y", ""), (2, "nothing here", "")], DOCS)
    items = spark.createDataFrame([(5, text, ""), (3, text.upper(), ""), (None, None, None), (8, "too short", "")], ITEMS)
    (row,) = dc.leaks(docs, items).collect()
    assert (row["doc_id"], row["item_id"], row["same_items"], row["position"], row["agreeing"]) == (1, 3, 2, 1, 20)
    assert [r["doc_id"] for r in dc.without_leaks(docs, items).collect()] == [2]
    assert dc.leaks(docs.limit(0), items).count() == 0 and dc.leaks(docs, items.limit(0)).count() == 0
    assert dc.without_leaks(docs, items.limit(0)).count() == 3
