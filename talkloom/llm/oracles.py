"""SQL (DuckDB) that states the registered queries of this subpackage anew over the same tables."""

from __future__ import annotations

from talkloom.llm import secret_scan


def crc32_sql(value: str) -> str:
    """crc32 of the decimal form of an integer, bit by bit."""
    step = "xor(c >> 1, 3988292384 * (c & 1))"  # the reversed polynomial 0xEDB88320
    eight = f"list_reduce([xor(acc, b)] || range(8), lambda c, _: {step})"
    codes = f"list_transform(string_split(({value})::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda acc, b: {eight}), 4294967295)"


def _framed(value: str) -> str:
    return f"coalesce(strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_framed(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


#: Levels by recursion (a node with the one after it), then the proofs by joins of positions, then the fold level by level.
OP11 = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS id, doc_id, lang, {_leaf("n_chars")} AS leaf,
         CASE WHEN {crc32_sql("doc_id")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS start
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(h || coalesce(after, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (PARTITION BY lang ORDER BY pos) AS after FROM nodes WHERE n > 1)
  WHERE pos % 2 = 0
), subroots AS (
  SELECT lang, h AS subroot, level AS height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(h || coalesce(after, '')), (n + 1) // 2
  FROM (SELECT *, lead(h) OVER (ORDER BY pos) AS after FROM tops WHERE n > 1)
  WHERE pos % 2 = 0
), steps AS (
  SELECT p.id, n.level AS step, (p.pos >> n.level) % 2 AS odd, coalesce(s.h, '') AS sibling
  FROM placed p JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) n ON p.lang IS NOT DISTINCT FROM n.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM p.lang AND s.level = n.level AND s.pos = xor(p.pos >> n.level, 1)
  UNION ALL
  SELECT p.id, r.height + t.level, (r.pos >> t.level) % 2, coalesce(s.h, '')
  FROM placed p JOIN subroots r ON p.lang IS NOT DISTINCT FROM r.lang
  CROSS JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) t
  LEFT JOIN tops s ON s.level = t.level AND s.pos = xor(r.pos >> t.level, 1)
), proofs AS (
  SELECT id, list(CASE WHEN odd = 1 THEN [sibling, ''] ELSE ['', sibling] END ORDER BY step) AS proof, string_agg(sibling, '' ORDER BY step) AS siblings
  FROM steps GROUP BY id
), answers AS (
  SELECT l.doc_id, l.leaf, r.subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(p.siblings, '')) AS proof_sha256,
         CASE WHEN p.proof IS NULL THEN l.start
              ELSE list_reduce([[l.start, '']] || p.proof, lambda node, x: [sha256(x[1] || node[1] || x[2]), ''])[1] END AS folded_root
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang LEFT JOIN proofs p ON l.id = p.id
)
SELECT *, folded_root = root AS verified FROM answers
"""

_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

#: Paths of all members at all depths; subtrees through the ancestors of each node's smallest member.
OP13 = f"""
WITH named AS (
  SELECT conv_id, turn, {_WORDS} AS words,
         left(sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS id
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT conv_id, id, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) - 1 AS r FROM named
), convs AS (
  SELECT conv_id AS c, conv_id - conv_id % 20 AS base, {crc32_sql("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.c, t.r AS k, t.id, t.words FROM convs c JOIN turns t ON t.conv_id = c.base AND t.r < c.h
  UNION ALL
  SELECT c.c, t.r - c.h + least(c.h, (SELECT count(*) FROM turns b WHERE b.conv_id = c.base)), t.id, t.words
  FROM convs c JOIN turns t ON t.conv_id = c.c AND t.r >= c.h
), paths AS (
  SELECT c, 0 AS depth, '' AS path, 0 AS words FROM convs
  UNION ALL
  SELECT c, k + 1, sha256(string_agg(id, '') OVER (PARTITION BY c ORDER BY k)), words FROM rebuilt
), ends AS (
  SELECT arg_max(path, depth) AS path, c FROM paths GROUP BY c
), ended AS (
  SELECT path, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM ends GROUP BY path
), nodes AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved FROM paths GROUP BY path, depth
), linked AS (
  SELECT n.*, p.path AS parent, m.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN paths p ON p.c = n.conv_id AND p.depth = n.depth - 1 LEFT JOIN nodes m ON m.path = p.path AND m.depth = p.depth
), families AS (
  SELECT parent AS path, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent
), subtrees AS (
  SELECT a.path, a.depth, sum(n.saved) AS saved_tokens, sum((f.path IS NULL)::INT) AS n_leaves
  FROM nodes n LEFT JOIN families f ON f.path = n.path JOIN paths a ON a.c = n.conv_id AND a.depth <= n.depth GROUP BY a.path, a.depth
)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs, coalesce(f.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM linked l JOIN subtrees s USING (path, depth) LEFT JOIN families f USING (path) LEFT JOIN ended e USING (path)
"""


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _runs(kind: str, pattern: str, group: int = 0) -> str:
    """Matches of a pattern (and a group of each) with their places: the lengths of all matches and gaps before, summed."""
    p = _literal(pattern)
    return f"""
  SELECT id, '{kind}' AS kind, matches[i] AS value, groups[i] AS part,
         (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(matches[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM (SELECT id, regexp_extract_all(t, {p}, 0) AS matches, regexp_extract_all(t, {p}, {group}) AS groups, string_split_regex(t, {p}) AS gaps FROM docs),
       unnest(range(1, len(matches) + 1)) AS u(i)"""


def _op12() -> str:
    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    assign = "(" + "|".join(either(w) for w in secret_scan.KEYWORDS) + ")" + secret_scan.ASSIGN_REST
    runs = [f"(SELECT *, {c.window} AS size, {c.bits} AS bits FROM ({_runs(c.kind, f'[{c.alphabet}]+')}) WHERE length(value) >= {c.window})" for c in secret_scan.CLASSES]
    kinds = [*secret_scan.BASE_KINDS, *(c.kind for c in secret_scan.CLASSES)]
    placed = "list_position([" + ", ".join(f"'{k}'" for k in kinds) + "], kind)"
    allowed = " OR ".join(f"regexp_full_match(value, {_literal(a)})" for a in secret_scan.ALLOWED)
    allowed += "".join(f" OR contains(lower(value), '{p}')" for p in secret_scan.PLACEHOLDERS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secret_scan.BASE_KINDS)
    joined = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place)"
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents
), base AS (
  SELECT id, kind, start, start + length(value) AS stop FROM ({_runs("assign", assign, 2)}) WHERE length(part) >= {secret_scan.ASSIGN_LEAST}
  UNION ALL
  SELECT id, kind, start, start + length(value) FROM ({_runs("access", "AKIA[A-Z0-9]+")}) WHERE length(value) >= {secret_scan.ACCESS_LEAST}
  UNION ALL
  SELECT id, kind, start, start + length(value) FROM ({_runs("hex", "[0-9a-f]+")}) WHERE length(value) >= {secret_scan.HEX_LEAST}
), candidates AS (
  SELECT * FROM ({" UNION ALL ".join(runs)}) WHERE NOT ({allowed})
), windows AS (
  SELECT id, kind, start AS run, size, start + w AS place
  FROM candidates, LATERAL unnest(range(0, length(value) - size + 1)) AS u(w)
  WHERE list_entropy(string_split(substr(value, w + 1, size), '')) >= bits
), islands AS (
  SELECT *, sum((before IS NULL OR place > before + size)::INT) OVER (PARTITION BY id, kind, run ORDER BY place) AS island
  FROM (SELECT *, lag(place) OVER (PARTITION BY id, kind, run ORDER BY place) AS before FROM windows)
), added AS (
  SELECT id, kind, min(place) AS start, max(place) + any_value(size) AS stop FROM islands GROUP BY id, kind, run, island
), spans AS (
  SELECT *, {placed} AS place FROM (
    SELECT * FROM base
    UNION ALL
    SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.id = a.id AND b.start <= a.start AND a.stop <= b.stop)
  )
), summed AS (
  SELECT id, {counts}, coalesce({joined.replace("place)", f"place) FILTER (place <= {len(secret_scan.BASE_KINDS)})")}, '') AS base, {joined} AS spans FROM spans GROUP BY id
)
SELECT d.doc_id, {", ".join(f"coalesce(s.n_{k}, 0) AS n_{k}" for k in secret_scan.BASE_KINDS)}, sha256(coalesce(s.base, '')) AS base_sha256, coalesce(s.spans, '') AS spans
FROM docs d LEFT JOIN summed s USING (id)
"""


#: Places from the lengths of matches and gaps; the entropy of every window anew.
OP12 = _op12()


#: All pairs of texts that share a shingle, then everything reachable over links.
OP4 = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS id, doc_id,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                    ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM texts
), sizes AS (
  SELECT id, count(*) AS n FROM shingles GROUP BY id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.id AS a, y.id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.id <> y.id GROUP BY ALL) p
  JOIN sizes m ON m.id = p.a JOIN sizes n ON n.id = p.b WHERE 100 * c >= 85 * (m.n + n.n - c)
), reached AS (
  SELECT id AS a, id AS b FROM texts
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
), answers AS (
  SELECT t.doc_id, coalesce(s.n, 0) AS n_shingles, (SELECT min(u.doc_id) FROM reached r JOIN texts u ON u.id = r.b WHERE r.a = t.id) AS component_id
  FROM texts t LEFT JOIN sizes s USING (id)
)
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM answers
"""
