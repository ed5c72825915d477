"""Tries against nodes found by enumerating all prefixes."""

import hashlib
import random
import re
import zlib

from talkloom.llm import prefix_trie as pt

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id bigint, turn bigint, role string, text string, ids string, n int, head string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def by_hand(rows):
    own = {}
    digest = lambda r, t: hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()[:32]
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own.setdefault(c, []).append((turn is not None, turn or 0, digest(role, text), (role, text)))
    own = {c: [x[-1] for x in sorted(t)] for c, t in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = int(c / 20) * 20  # truncated towards zero, as % is
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children, leaves, saved = {p: 0 for p in members}, {p: 0 for p in members}, {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        own_saved = (len(m) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved
            leaves[p[:d]] += children[p] == 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(rebuilt[c]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), parent, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", 1, "clash") for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r[f] for f in FIELDS) for r in pt.conversation_trie(frame).collect()), key=str)


def corpus(seed, n, alphabet=3, most=7):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.randrange(-40, 400)
        if any(r[0] == c for r in rows):
            continue
        for turn in range(rng.randrange(0, most)):
            text = rng.choice(["a b", "c d e", "", None, " \t", "long " * 300][:alphabet])
            rows.append((c, rng.choice([turn, turn, None]), rng.choice(["user", None]), text))
    return rows + [(None, 0, "user", "no conversation"), (None, None, None, None), *rows[:4], *rows[:2]]


def test_small_trie_in_one_container(spark):
    rows = corpus(1, 60)
    assert trie(spark, rows) == by_hand(rows)


def test_bursts(spark, monkeypatch):
    """Containers of three suffixes: chains, bursts below bursts, conversations that end at a burst head."""
    monkeypatch.setattr(pt, "CONTAINER", 3)
    rows = corpus(2, 250, alphabet=2)
    shared = [(1000 + c, t, "user", f"t{t}") for c in range(0, 200, 20) for t in range(9)]  # bases with one long common start
    shared += [(c, 9 + c % 3, "user", f"end {c % 40}") for c in range(1000, 1200)]
    shared += [(c, t, "user", f"t{t}") for c in range(2000, 2200, 20) for t in range(c // 20 % 7 + 3)]  # each a start of the next
    assert trie(spark, rows + shared) == by_hand(rows + shared)


def test_hot_conversation_and_long_ones(spark, monkeypatch):
    """One sequence that a third of all conversations share, over many ranges of ids; containers bounded by turns."""
    monkeypatch.setattr(pt, "ID_RANGE", 8)
    monkeypatch.setattr(pt, "CONTAINER_TURNS", 50)
    rows = [(20 * c, t, "system", f"same {t}") for c in range(60) for t in range(4)]
    rows += [(20 * c, t, "user", f"own {c % 9} {t}") for c in range(60, 70) for t in range(120)]
    rows += corpus(3, 40)
    assert trie(spark, rows) == by_hand(rows)


def test_turnless_and_empty(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(None, 0, "user", "x")]) == []
    rows = [(c, None, None, None) for c in range(21, 40)] + [(60, 5, "r", "")]
    got = trie(spark, rows)
    assert got == by_hand(rows) and got[0][:2] == (21, 0) and any(r[0] == 21 and r[3] > 1 for r in got)
