"""Groups against a comparison of all pairs."""

import random
import re
from collections import Counter
from math import comb

import numpy as np

from talkloom.llm import near_dedup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, kept string, digest int"


def shingle_set(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def all_pairs(docs, percent):
    sets = [shingle_set(t) for _, t in docs]
    up = list(range(len(docs)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    out = []
    for k, (i, _) in enumerate(docs):
        component = least.get(root(k)) if sets[k] else i
        out.append((i, len(sets[k]), component, i == component))
    return sorted(out, key=str)


def edited(rng, words, share):
    words = list(words)
    for _ in range(int(len(words) * share)):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return words


def corpus(seed, families=12, size=14):
    rng = random.Random(seed)
    texts = [None, "", " \n\t", "one", "One", "one two three four", "ONE two three four", "a b c d e", "A B C D E f", "x " * 400, "x " * 500]
    for _ in range(families):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(30, 300))]
        for _ in range(rng.randrange(2, size)):
            base = edited(rng, base, 0.01) if rng.random() < 0.3 else base  # a chain away from the first
            texts.append(" ".join(edited(rng, base, rng.choice([0, 0.01, 0.02, 0.03, 0.05]))))
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    return [*docs, (None, texts[3]), (None, "nowhere else at all but here"), docs[7], docs[7]]


def run(spark, docs, percent):
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], SCHEMA)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in nd.near_duplicates(frame, percent).collect()), key=str)


def test_groups_equal_all_pairs(spark):
    for seed, percent in ((1, 85), (2, 80)):
        docs = corpus(seed)
        assert run(spark, docs, percent) == all_pairs(docs, percent)


def test_rows_without_an_id_carry_links(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    one, two = [*base[:185], *(f"x{k}" for k in range(13))], [*(f"y{k}" for k in range(13)), *base[13:]]
    docs = [(1, " ".join(one)), (None, " ".join(base)), (2, " ".join(two)), (None, "alone " * 9), (None, "ALONE " * 9), (9, "p q r s t u"), (9, "another text under that id")]
    got = run(spark, docs, 85)
    assert got == all_pairs(docs, 85) and {r[2] for r in got if r[1] > 150} == {1}


def test_links_grow_with_the_members(spark, monkeypatch):
    """Families that their first members don't hold together: what is handed on to the components is in proportion to them."""
    handed = []
    real = nd.connected_components

    def counted(edges, u="u", v="v"):
        handed[-1] += edges.count()
        return real(edges, u, v)

    monkeypatch.setattr(nd, "connected_components", counted)
    rng = random.Random(11)
    for members in (400, 1600):
        base = [f"w{rng.randrange(5000)}" for _ in range(60)]
        docs = [(k, " ".join([*base[: k % 60], f"n{k}", *base[k % 60 + 1 :]])) for k in range(members)]
        handed.append(0)
        assert {r[2] for r in run(spark, docs, 80)} == {0}
    assert handed[1] < 5 * handed[0] and handed[1] < 3 * 1600


def test_hot_buckets_are_split_without_losing_links(spark, monkeypatch):
    """One family over many blocks, whose members are often less alike to the first than to each other."""
    monkeypatch.setattr(nd, "BLOCK", 4)
    docs = corpus(3, families=2, size=90)
    assert run(spark, docs, 85) == all_pairs(docs, 85)


def test_empty_table_and_pipeline_form(spark):
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = corpus(4, families=3)
    frame = spark.createDataFrame([(*d, "clash", k) for k, d in enumerate(docs)], SCHEMA)
    kept = nd.without_near_duplicates(frame, 85)
    assert kept.columns == frame.columns
    groups = all_pairs(docs, 85)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _, _, stays in groups if stays}


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(8)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(5))
    rows = [(1, a), (1, a), (1, a)]  # repeated rows of one id
    rows += [(3, b), (5, b), (5, c), (5, c + " more")]  # an id whose texts are a copy, its own, and near its own
    rows += [(None, a), (None, b.upper()), (None, d), (None, d), (None, d + " more"), (None, e)]
    rows += [(7, ""), (7, ""), (8, None), (5, " "), (None, " "), (None, " "), (None, None)]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = [(r["doc_id"], r["text"], r["kept"], r["digest"]) for r in nd.without_near_duplicates(frame.repartition(3), 80).collect()]
    assert all(r[2:] == ("clash", 1) for r in got)
    near = lambda t: {c + " more": c, d + " more": d}.get(t, t)
    want = [(1, a), (3, b), (5, c), (None, d), (None, e), (7, ""), (8, None), (5, " "), (None, " "), (None, " "), (None, None)]
    assert Counter((i, near(t)) for i, t, *_ in got) == Counter(want)
    again = nd.without_near_duplicates(frame.repartition(7), 80).collect()
    assert Counter(map(str, again)) == Counter(map(str, nd.without_near_duplicates(frame, 80).collect()))


def test_bounds_follow_the_posterior():
    least = nd.least_matches(0.85, 1e-5)
    assert len(least) == nd.SIGNATURE // nd.BATCH and all(a < b for a, b in zip(least, least[1:], strict=False))
    t = 0.85 + 0.15 / 256
    missed = sum(comb(32, m) * t**m * (1 - t) ** (32 - m) for m in range(least[0]))
    assert missed < 1e-4
    assert least[-1] > 0.75 * nd.SIGNATURE


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    b = np.concatenate([a[:1800], rng.integers(0, 2**63, 200, dtype=np.uint64)])
    same = (nd.minima(a, nd._LONG_A, nd._LONG_B) == nd.minima(b, nd._LONG_A, nd._LONG_B)).mean()
    assert abs(same - 1800 / 2200) < 0.06
