"""Spans against patterns and entropies found anew for every place."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb

from talkloom.llm import oracles
from talkloom.llm import secret_scan as ss

SCHEMA = "doc_id bigint, text string, spans string, id int, kind int"
KINDS = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]
LOWER = "abcdefghijklmnopqrstuvwxyz"


def slow_spans(text):
    text = text or ""
    found = []
    word = "".join(c.lower() if c.lower() in LOWER and c.isascii() else "\0" if c.isupper() or c in "ſ" else c for c in text)
    at = 0
    while m := re.compile(r"(password|passwd|secret|token|api_?key)").search(word, at):
        end = m.end()
        end += text[end : end + 1] in ("'", '"')
        while text[end : end + 1] == " ":
            end += 1
        sign = text[end : end + 1]
        if sign and sign in ":=":
            end += 1
            while text[end : end + 1] == " ":
                end += 1
            end += text[end : end + 1] in ("'", '"')
            value = re.compile(r"[A-Za-z0-9+/_.=-]*").match(text, end)[0]
            if value:
                if len(value) >= 6:
                    found.append(("assign", m.start(), end + len(value)))
                at = end + len(value)
                continue
        at = m.start() + 1
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append(("access", *m.span()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append(("hex", *m.span()))
    base = list(found)
    for kind, alphabet, window, bits in ss.CLASSES:
        for m in re.finditer(f"[{alphabet}]+", text):
            if any(re.fullmatch(a, m[0]) for a in ss.ALLOWED) or any(p in m[0].lower() for p in ss.PLACEHOLDERS):
                continue
            marked = set()
            for k in range(len(m[0]) - window + 1):
                counts = Counter(m[0][k : k + window]).values()
                if -sum(c / window * math.log2(c / window) for c in counts) >= bits:
                    marked |= {(k + i, k + i + 1) for i in range(window)}
            edges = sorted(marked)
            while edges:
                start = end = edges[0][0]
                while edges and edges[0][0] == end:
                    end = edges.pop(0)[1]
                if not any(s <= m.start() + start and m.start() + end <= e for _, s, e in base):
                    found.append((kind, m.start() + start, m.start() + end))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def row(i, text):
    spans = slow_spans(text)
    joined = lambda kinds: ",".join(f"{k}:{s}:{e}" for k, s, e in spans if k in kinds)
    return (i, *[sum(k == x[0] for x in spans) for k in KINDS[:3]], hashlib.sha256(joined(KINDS[:3]).encode()).hexdigest(), joined(KINDS))


def texts(seed):
    rng = random.Random(seed)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    base64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    found = [None, "", " ", "token=abcde", "token = 'abcdef'", "token: token=abcdef", "PassWord\"  =  \"x.y/z_1", "paſſword=abcdefgh", "toKen=abcdef"]
    found += ["api_key:aaaaaa apikey=bbbbbb api-key=cccccc", "AKIA" + "A" * 15, "AKIA" + "Z" * 16 + "AKIA", "akia" + "A" * 30, "0123456789abcdef" * 3]
    found += ["d41d8cd98f00b204e9800998ecf8427e".upper(), "a" * 24, "1" * 60, "somePlainWordsInCamelCaseForALongWhile", "SOME_CONSTANT_NAME_OF_A_PROGRAM", "example" + pick(base64, 40)]
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 8)):
            parts.append(
                rng.choice(
                    [
                        lambda: pick("0123456789abcdef", rng.randrange(10, 60)),
                        lambda: pick("0123456789ABCDEF", rng.randrange(10, 60)),
                        lambda: pick(base64, rng.randrange(10, 80)),
                        lambda: pick("aab1", rng.randrange(10, 60)) + pick(base64, 30) + "A" * rng.randrange(0, 50) + pick(base64, 26),
                        lambda: "token" + rng.choice(["=", ' : "', "'= "]) + pick(base64, rng.randrange(2, 50)),
                        lambda: "AKIA" + pick("ABCDEFGH0123", rng.randrange(10, 22)),
                        lambda: pick(LOWER, rng.randrange(1, 30)),
                        lambda: pick("éü€\U0001f600", rng.randrange(1, 5)),
                    ]
                )()
            )
        found.append(rng.choice([" ", "\n", "", "é"]).join(parts))
    return [*found, "word " * 40_000 + "token=abcdefgh " + pick(base64, 3000)]


def report(spark, docs):
    frame = spark.createDataFrame([(*d, "clash", 1, 2) for d in docs], SCHEMA).repartition(4)
    return sorted(tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")) for r in ss.secret_report(frame).collect())


def test_spans_equal_those_found_anew(spark):
    docs = list(enumerate(texts(5)))
    docs += [docs[4], docs[4], (3, "another text of an id: token=abcdefgh")]
    want = sorted(row(*d) for d in docs)
    assert report(spark, docs) == want
    assert sum("entropy_hex" in r[5] for r in want) > 10 and sum("entropy_base64" in r[5] for r in want) > 10
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(d) for d in docs])
    assert sorted(con.execute(f"SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans FROM ({oracles.OP12})").fetchall()) == want


def test_missing_ids_and_empty_table(spark):
    assert report(spark, []) == []
    frame = spark.createDataFrame([(None, "token=abcdefgh", "", 0, 0)] * 2, SCHEMA)
    assert [(r["doc_id"], r["n_assign"], r["spans"]) for r in ss.secret_report(frame).collect()] == [(None, 1, "assign:0:14")] * 2


def test_allow_list_takes_linear_time():
    assert not ss.allowed("a" * 200_000 + "!") and ss.allowed("aB" * 2 + "c" * 9)
    assert ss.entropy_spans("ab" * 10, 20, 0.5) == [(0, 20)] and ss.entropy_spans("", 20, 0.5) == []
