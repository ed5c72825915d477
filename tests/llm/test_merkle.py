"""Manifests against trees built node by node."""

import hashlib
import random
import zlib

import pytest

from talkloom.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int, tree string, position string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(nodes, arity):
    found = [nodes]
    while len(found[-1]) > 1:
        last = found[-1]
        found.append([H("".join(last[k : k + arity])) for k in range(0, len(last), arity)])
    return found


def siblings(tree, place, arity):
    out = []
    for level in tree[:-1]:
        first = place - place % arity
        run = level[first : first + arity]
        out.append(("".join(run[: place - first]), "".join(run[place - first + 1 :])))
        place //= arity
    return out


def by_hand(rows, arity=2):
    """A list of (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), sorted."""
    leaf = lambda r, n: H("".join(map(framed, (r[0], r[1], r[2], n, r[4]))))
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[3]), r))
    order = sorted(langs, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([x[2] for x in sorted(langs[k], key=lambda x: x[:3])], arity) for k in order}
    top = levels([trees[k][-1][0] for k in order], arity)
    out = []
    for at, k in enumerate(order):
        for place, (_, _, own, r) in enumerate(sorted(langs[k], key=lambda x: x[:3])):
            proof = siblings(trees[k], place, arity) + siblings(top, at, arity)
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf(r, r[3] + 1) if tampered else own
            for left, right in proof:
                node = H(left + node + right)
            out.append((r[0], own, trees[k][-1][0], top[-1][0], H("".join(a + b for a, b in proof)), node, node == top[-1][0]))
    return sorted(out, key=str)


def report(spark, rows):
    frame = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA).repartition(5)
    got = merkle.tamper_report(frame)
    return sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(["en"] * 20 + ["de", "zz", None, "", "Éa", "\U0001f600", "￿"])
        text = rng.choice([None, "", "a", "ü" * rng.randrange(9), "long " * 9000])
        rows.append((k * 3 - 50, rng.choice([None, "s", "t:1"]), lang, rng.choice([None, 0, 12, -5]), text))
    return rows + rows[:3] * 2 + [(None, None, None, None, None), (None, "s", "en", 7, "no id"), (rows[5][0], "other", "en", 1, "a second text of an id")]


@pytest.mark.parametrize("n", [1, 3, 64, 65, 300])
def test_proofs_equal_trees_by_hand(spark, n):
    rows = corpus(n, n) if n > 9 else [(k, "s", "en", k, f"t{k}") for k in range(n)]
    assert report(spark, rows) == by_hand(rows)


def test_several_tiers_and_a_hot_repeated_row(spark, monkeypatch):
    """Blocks of four, so that one language has five tiers; a row that makes up a third of the table."""
    monkeypatch.setattr(merkle, "DEPTH", 2)
    monkeypatch.setattr(merkle, "BLOCK", 4)
    rows = corpus(8, 250) + [(7, "s", "en", 3, "again")] * 130
    assert report(spark, rows) == by_hand(rows)


def test_wider_runs(spark, monkeypatch):
    for name, value in {"ARITY": 3, "DEPTH": 2, "BLOCK": 9}.items():
        monkeypatch.setattr(merkle, name, value)
    rows = corpus(9, 120)
    assert report(spark, rows) == by_hand(rows, 3)


def test_empty_table(spark):
    assert report(spark, []) == []
