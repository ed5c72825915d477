"""Hand-written edge cases of the operators."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from talkloom.config import SceneLimits
from talkloom.functions import fields as fl
from talkloom.functions import markers as mk
from talkloom.functions import redact as rd
from talkloom.functions import text as tx
from talkloom.functions import times as tm
from talkloom.operators import audit as au
from talkloom.operators import chunks as ch
from talkloom.operators import claims as cl
from talkloom.operators import frames as fr
from talkloom.operators import hashtree as ht
from talkloom.operators import intervals as iv
from talkloom.operators import overlay as ov
from talkloom.operators import palette as pal
from talkloom.operators import requests as rq
from talkloom.operators import timeline as tl
from talkloom.operators import transcript as tr


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://youtu.be/abc", "abc"), ("https://www.youtube.com/watch?v=abc&t=1", "abc"), ("https://youtube.com/shorts/x", "x"), ("https://m.youtube.com/embed/y?z=1", "y"),
        ("https://youtu.be/", None), ("https://www.youtube.com/watch?v=", None), ("https://example.com/watch?v=abc", None), ("nothing", None),
    ],
)
def test_video_ids(spark, url, want):
    assert one(spark, fl.video_id_of_url(F.lit(url))) == want


@pytest.mark.parametrize(
    "text,context,want",
    [
        ("слагсы", "", "слаксы"), ("Слагсы", "", "Слаксы"), ("СЛАГСЫ", "", "СЛАКСЫ"), ("тенсил", "", "тенсел"), ("Серсакер", "", "Seersucker"),
        ("слитки", "носки", "следки"), ("Слитков", "носки", "Следки"), ("слитки", "золото", "слитки"), ("слиткового", "носки", "слиткового"),
    ],
)
def test_domain_terms(spark, text, context, want):
    assert one(spark, tx.replace_domain_terms(F.lit(text), F.lit(context))) == want


def test_look_alike_letters(spark):
    assert one(spark, tx.repair_homoglyphs(F.lit("кopичнeвый coat Kот"))) == "коричневый coat Кот"


@pytest.mark.parametrize(
    "text,want",
    [
        ("Authorization: Bearer abc", "Authorization: Bearer [redacted]"), ("Cookie: a=b; c", "Cookie: [redacted]"), ('token = "abc"', 'token = [redacted]"'),
        ("key sk-abcdefghijklmnop12", "key [redacted]"), ("token_fingerprint: abc", "token_fingerprint: abc"),
    ],
)
def test_redaction(spark, text, want):
    assert one(spark, rd.redact_text(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("конец.»", "."), ('он сказал: "да"', "а"), ("  ", None), ("вопрос?) ", "?")])
def test_terminal_char(spark, text, want):
    assert one(spark, tx.terminal_char(F.lit(text))) == want


def test_whole_seconds_round_half_to_even(spark):
    assert [one(spark, tm.whole_seconds(F.lit(ms))) for ms in (499, 500, 1500, 2500, 2501)] == [0, 0, 2, 2, 3]


@pytest.mark.parametrize(
    "text,technical,presentation",
    [
        ("Крупный план", True, False), ("белый", True, False), ("белый пиджак", False, False), ("Появление героя справа", False, True), ("on-screen text", True, False),
        ("screenplay", False, False), ("фонарь", True, False), ("галстук на камеру", True, False), ("левая часть", False, True),
    ],
)
def test_markers(spark, text, technical, presentation):
    key = tx.label_key(F.lit(text))
    assert (one(spark, mk.technical_key(key)), one(spark, mk.presentation_key(key))) == (technical, presentation)


def tokens(spark, rows):
    return spark.createDataFrame([("v", i, *r) for i, r in enumerate(rows)], "video_id string, pos long, text string, start_ms long, end_ms long, speaker string")


def test_blank_tokens_pauses_and_missing_speakers(spark):
    rows = [(" ", 0, 10, None), ("Да", 10, 100, "a"), (" ", 100, 110, None), ("нет", 120, 200, "a"), ('."', 200, 210, None), ("Потом", 1109, 1200, None), ("Ещё", 2100, 2200, "b"), (" ", 2200, 2210, None)]
    units = tr.transcript_units(tokens(spark, rows)).orderBy("unit_index").collect()
    assert [(u["start_pos"], u["end_pos"], u["text"], u["word_count"], u["boundary_reason"]) for u in units] == [
        (1, 4, 'Да нет."', 2, "sentence_end"), (5, 5, "Потом", 1, "pause"), (6, 7, "Ещё", 1, "end")
    ]
    assert [u["speaker"] for u in units] == ["a", None, "b"]


def test_speaker_ties_and_words_across_tokens(spark):
    rows = [("при", 0, 100, "a"), ("вет", 100, 200, "a"), (" мир", 200, 400, "b"), (" ", 400, 500, "a"), ("да", 500, 500, "a")]
    got = {r["speaker"]: (r["words_count"], r["speech_ms"], r["role"]) for r in tr.speaker_profiles(tokens(spark, rows)).collect()}
    assert got == {"a": (2, 200, "host"), "b": (1, 200, "offscreen_questioner")}


def test_range_errors_at_the_limits(spark):
    cols = "video_id string, unit_index long, start_pos long, end_pos long, start_ms long, end_ms long, text string, word_count long, speaker string, speaker_role string, speakers_seen long, first_starts_word boolean, boundary_reason string, can_end boolean, must_end boolean"
    unit = lambda i, s, e, w, who, can=True, must=False: ("v", i, i * 10, i * 10 + 9, s, e, "Слово.", w, who, who, 1 if who else 0, True, "sentence_end", can, must)
    units = spark.createDataFrame([unit(1, 0, 60250, 150, "a"), unit(2, 60300, 120551, 151, "a", can=False), unit(3, 130000, 134000, 5, None, must=True), unit(4, 140000, 150000, 5, "b")], cols)
    ranges = spark.createDataFrame([("v", 1, 1, 1), ("v", 2, 2, 2), ("v", 3, 3, 3)], "video_id string, segment_index long, unit_start_index long, unit_end_index long")
    got = sorted((r["segment_index"], r["code"]) for r in tr.segment_range_errors(ranges, units).collect())
    assert got == [(0, "incomplete_coverage"), (2, "duration_exceeded"), (2, "unsafe_unit_boundary"), (2, "words_exceeded"), (3, "duration_too_short")]


def test_overlap_join_against_all_pairs(spark):
    rng = random.Random(1)
    left = [("v", i, s, s + rng.choice([0, 1, 50, 400])) for i, s in enumerate(rng.choices(range(2000), k=120))]
    right = [("v", i, s, s + rng.choice([1, 30, 900])) for i, s in enumerate(rng.choices(range(2000), k=60))]
    got = iv.overlap_join(
        spark.createDataFrame(left, "k string, a long, ls long, le long"), spark.createDataFrame(right, "k string, b long, rs long, re long"), ["k"], ("ls", "le"), ("rs", "re"), width=100
    ).select("a", "b").collect()
    want = sorted((x[1], y[1]) for x in left for y in right if x[3] > y[2] and x[2] < y[3])
    assert sorted(map(tuple, got)) == want


def test_midpoint_on_a_scene_bound(spark):
    scenes = spark.createDataFrame([("v", 0, "a", 0, 1000), ("v", 1, "b", 1000, 2000)], "video_id string, scene_index long, scene_id string, start_ms long, end_ms long")
    toks = spark.createDataFrame([("v", 0, 900, 1100), ("v", 1, 1900, 2100), ("v", 2, 1950, 2100)], "video_id string, pos long, start_ms long, end_ms long")
    assert {r["pos"]: r["scene_id"] for r in tl.tokens_in_scenes(toks, scenes).collect()} == {0: "b", 1: "b"}


def test_chunk_attaches_near_events_only_up_to_the_limit(spark):
    spans = spark.createDataFrame([("v", 1, 10_000, 20_000), ("v", 2, 100_000, 110_000), ("v", 3, 200_000, 210_000)], "video_id string, chunk_index long, start_ms long, end_ms long")
    events = spark.createDataFrame([("v", "in", 15_000, 16_000), ("v", "near", 20_500, 21_000), ("v", "five", 115_000, 116_000), ("v", "far", 215_001, 216_000)], "video_id string, event_id string, start_ms long, end_ms long")
    got = sorted((r["chunk_index"], r["event_id"], r["distance_ms"]) for r in ch.attach_events(spans, events).collect())
    assert got == [(1, "in", 0), (2, "five", 5000)]
    assert [r["chunk_index"] for r in ch.missing_evidence(spans, ch.attach_events(spans, events)).collect()] == [3]


def test_question_gap_limit(spark):
    segs = spark.createDataFrame(
        [("v", 0, "offscreen_questioner", 0, 1000), ("v", 1, "host", 13_000, 14_000), ("v", 2, "offscreen_questioner", 15_000, 16_000), ("v", 3, "host", 28_001, 29_000)],
        "video_id string, seg long, speaker_role string, start_ms long, end_ms long",
    )
    assert [r["asks_next"] for r in ch.mark_questions(segs).orderBy("seg").collect()] == [True, False, False, False]


def test_dialogue_names_speakers_only_where_needed(spark):
    parts = spark.createDataFrame([([("host", "a", "Один"), ("host", "a", "Два"), ("host", "b", "Три"), ("offscreen_questioner", "c", ""), (None, None, "Кто")],)], "p array<struct<speaker_role:string,speaker:string,text:string>>")
    assert parts.select(ch.dialogue_text(F.col("p")).alias("d")).first()["d"] == "Ведущий (a): Один Два\nВедущий (b): Три\nГолос: Кто"


def test_frames_beyond_the_plan_are_taken(spark):
    rows = [(1, i, i * 10, "sample", 0, 1.0) for i in range(1, 120)]
    df = spark.createDataFrame(rows, "scene long, image_index long, ts_ms long, frame_role string, phash long, sharpness double")
    got = fr.drop_near_duplicates(df, ["scene"])
    assert got.count() == 119 and got.where("kept").count() == 1


def test_palette_boundary_moves_to_the_change(spark):
    first, second = [1.0, 0.0, 0.0, 0.0], [0.0, 0.0, 0.5, 0.5]
    rows = [("v", 0, t, 10.0 if t < 6500 else 90.0, 5.0 if t < 6500 else 60.0, first if t < 6500 else second) for t in range(0, 8500, 250)]
    rows += [("v", 1, t, 90.0, 60.0, second) for t in range(8500, 16500, 250)]
    samples = spark.createDataFrame(rows, "video_id string, scene_index long, ts_ms long, saturation double, colorfulness double, histogram array<double>")
    scenes = spark.createDataFrame([("v", 0, 0, 8500, 0, 212), ("v", 1, 8500, 16500, 212, 412)], "video_id string, scene_index long, start_ms long, end_ms long, start_frame long, end_frame long")
    candidates = pal.boundary_candidates(samples, scenes)
    best = pal.best_adjustments(candidates).collect()
    assert [(r["scene_index"], r["ts_ms"], round(r["confidence"], 3)) for r in best] == [(0, 6500, 1.0)]
    moved = pal.apply_adjustments(scenes, pal.best_adjustments(candidates)).orderBy("scene_index").collect()
    assert [(r["start_frame"], r["end_frame"]) for r in moved] == [(0, 162), (162, 412)]


def _claim(cid, text="t", kind="rule"):
    return (cid, kind, "s", text, "r", "low")


def test_overlay_rules(spark):
    shape = "struct<claim_id:string,claim_type:string,subject:string,claim:string,rationale:string,confidence:string>"
    claims = spark.createDataFrame([("j", i, f"c{i}", _claim(f"c{i}")) for i in range(4)], f"job_id string, claim_pos long, claim_id string, claim {shape}")
    edits = [
        (1, "c0", "update", _claim("c0", "new"), None), (2, "c1", "delete", None, None), (3, "c1", "update", _claim("c1", "late"), None), (4, "c1", "add", _claim("c1", "again"), None),
        (5, "c2", "update", _claim("c2", "bad", "myth"), None), (6, "n1", "add", _claim("n1"), "c0"), (7, "n2", "add", _claim("n2"), "c0"), (8, "n3", "add", _claim("n3"), "n1"),
        (9, "n4", "add", _claim("n4"), "nowhere"), (10, "n5", "update", _claim("n5"), None), (11, "c3", "add", _claim("c3", "over"), "c0"), (12, "n6", "add", _claim("other"), "c0"), (13, "n7", "add", _claim("n7"), "c1"),
    ]
    log = spark.createDataFrame([("j", *e) for e in edits], f"job_id string, edit_seq long, claim_id string, action string, claim {shape}, insert_after string")
    got = ov.fold_edits(claims, log).orderBy("order_key").collect()
    assert [(r["claim_id"], r["claim"]["claim"]) for r in got] == [
        ("c0", "new"), ("n2", "t"), ("n1", "t"), ("n3", "t"), ("c2", "t"), ("c3", "over"), ("n4", "t"), ("n7", "t")
    ]


def test_duplicate_claims_unite_their_lists_in_order(spark):
    rows = [("v", 2, "rule", "S", "Один  текст", ["b"], ["x"]), ("v", 1, "rule", "s", "один текст", ["a", "b"], []), ("v", 3, "rule", "s", "другой", [], ["q"])]
    df = spark.createDataFrame(rows, "video_id string, p long, claim_type string, subject string, claim string, conditions array<string>, evidence array<string>")
    for f in ("applies_to", "avoid", "prefer", "topics"):
        df = df.withColumn(f, F.array().cast("array<string>"))
    got = cl.merge_duplicates(df, ["video_id"], "p", ["p", "claim"]).orderBy("p").collect()
    assert [(r["p"], r["claim"], r["conditions"], r["evidence"], r["merged_from"]) for r in got] == [(1, "один текст", ["a", "b"], ["x"], 2), (3, "другой", [], ["q"], 1)]


def test_marker_inside_a_longer_name_is_no_hit(spark):
    mark = lambda t: one(spark, cl.technical_marker(F.lit(t), F.lit("vid")))
    assert [mark("see chunk_id"), mark("my_chunk_id2"), mark("vid_c_000001"), mark("Источник и временной диапазон"), mark("drawn")] == ["chunk_id", None, "vid_", "источник и временной диапазон", None]


def test_chunk_contamination_brute_force(spark):
    chunks = spark.createDataFrame([("v", "c1", "общий план", "", ["slides"], ["сумка"]), ("v", "c2", "сумка", "слева", [], [])], "video_id string, chunk_id string, visual_text string, presenter_brief string, topics array<string>, entities array<string>")
    got = sorted((r["chunk_id"], r["field"], r["marker"]) for r in ch.contamination(chunks.withColumn("combined_text", F.lit(""))).collect())
    assert got == [("c1", "combined_text", "общий план"), ("c1", "topics", "slides"), ("c1", "visual_text", "общий план"), ("c2", "combined_text", "слева сумка"), ("c2", "presenter_brief", "слева")]


def test_fingerprints_equal_trees_by_hand_and_drift_is_located(spark):
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def by_hand(rows, leaf, fan):
        level = {}
        for p, t in sorted(rows):
            level[p // leaf] = level.get(p // leaf, "") + digest(t)
        level, last = {n: digest(h) for n, h in level.items()}, max(p for p, _ in rows) // leaf
        while last:
            up = {}
            for n in sorted(level):
                up[n // fan] = up.get(n // fan, "") + level[n]
            level, last = {n: digest(h) for n, h in up.items()}, last // fan
        return level[0]

    rng = random.Random(3)
    jobs = {"hot": [(p, f"r{p}") for p in range(700)], "small": [(3, "x")], "gaps": [(p * 97, f"g{p}") for p in range(40)]}
    frame = lambda tables: spark.createDataFrame([(j, p, t) for j, rows in tables.items() for p, t in rows], "job_id string, pos long, t string")
    got = {r["job_id"]: (r["fingerprint"], r["rows"]) for r in ht.fingerprint(frame(jobs).repartition(5), ["job_id"], "pos", F.col("t"), 8, 3).collect()}
    assert got == {j: (by_hand(rows, 8, 3), len(rows)) for j, rows in jobs.items()}
    changed = {"hot": [(p, "other" if p in (17, 444) else t) for p, t in jobs["hot"] if not 96 <= p < 104] + [(2000, "late")], "small": jobs["small"], "new": [(0, "n")]}
    changed["hot"][5], changed["hot"][6] = (5, "r6"), (6, "r5")
    rng.shuffle(changed["hot"])
    found = ht.differing_leaves(frame(jobs), frame(changed), ["job_id"], "pos", F.col("t"), 8, 3).collect()
    want = set()
    for j in {*jobs, *changed}:
        blocks = [{}, {}]
        for side, tables in enumerate((jobs, changed)):
            for p, t in sorted(tables.get(j, [])):
                blocks[side].setdefault(p // 8, []).append(t)
        want |= {(j, n * 8, n * 8 + 7, *(len(b[n]) if n in b else None for b in blocks)) for n in {*blocks[0], *blocks[1]} if blocks[0].get(n) != blocks[1].get(n)}
    assert {(r["job_id"], r["from_pos"], r["to_pos"], r["left_rows"], r["right_rows"]) for r in found} == want and len(found) == len(want)


def test_drift_cases(spark):
    surface = ov.surface_drift(
        spark.createDataFrame([("j", i, "x") for i in range(28)], "job_id string, pos long, t string"), spark.createDataFrame([("j", i, "x") for i in range(30)], "job_id string, pos long, t string"), "pos", F.col("t")
    ).first()
    assert (surface["effective_rows"], surface["exported_rows"], surface["surface"]) == (28, 30, "refresh")
    chunks = spark.createDataFrame([("j", f"j_c_{i:06d}_{i + 1:06d}") for i in range(9)], "job_id string, chunk_id string")
    notes = spark.createDataFrame([("j", f"j_c_{i:06d}_{i + 1:06d}.md") for i in range(12)] + [("j", "mine.md")], "job_id string, note string")
    assert au.note_drift(chunks, notes).groupBy("kind").count().collect()[0].asDict() == {"kind": "extra", "count": 4}
    assert au.stale_notes(chunks, notes).count() == 3


def test_claim_violations_find_each_fault_once(spark):
    empty = []
    row = lambda pos, cid, chunk, **k: {
        "video_id": "v", "position": pos, "claim_id": cid, "chunk_id": chunk, "claim_type": "rule", "subject": "suit", "claim": f"text {pos}", "rationale": "why",
        "conditions": empty, "applies_to": empty, "avoid": empty, "prefer": empty, "evidence": ["seen"], "topics": ["fit"], **k,
    }
    rows = [
        row(0, "v_claim_000001", "c1"), row(1, "wrong", "c1"), row(2, "v_claim_000003", "gone"), row(3, "v_claim_000004", "c1", rationale=" "), row(4, "v_claim_000005", "c1", subject="Source refs"),
        row(5, "v_claim_000006", "c1", topics=["source", "fit"]), row(6, "v_claim_000007", "c1", evidence=["В кадре: сумка"]), row(7, "v_claim_000008", "c1", claim="тенсил"),
        row(8, "v_claim_000009", "c1", prefer=["the schema"]), row(9, "v_claim_000010", "c1", claim="Text  0"),
    ]
    fields = "video_id string, position long, claim_id string, chunk_id string, claim_type string, subject string, claim string, rationale string, " + ", ".join(
        f"{f} array<string>" for f in ("conditions", "applies_to", "avoid", "prefer", "evidence", "topics")
    )
    names = [f.split()[0] for f in fields.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], fields)
    got = sorted((r["claim_id"], r["code"]) for r in cl.claim_violations(df, spark.createDataFrame([("c1",)], "chunk_id string")).collect())
    assert got == sorted(
        [
            ("wrong", "wrong_claim_id"), ("v_claim_000003", "unknown_chunk"), ("v_claim_000004", "empty_required_field"), ("v_claim_000005", "service_subject"), ("v_claim_000006", "service_topics"),
            ("v_claim_000007", "evidence_prefix"), ("v_claim_000008", "unnormalised_term"), ("v_claim_000009", "technical_marker"), ("v_claim_000001", "duplicate_key"),
        ]
    )


def test_claim_texts_are_folded_once_and_searched_where_a_word_may_be(spark):
    fields = "video_id string, position long, claim_id string, chunk_id string, claim_type string, subject string, claim string, rationale string, " + ", ".join(
        f"{f} array<string>" for f in ("conditions", "applies_to", "avoid", "prefer", "evidence", "topics")
    )
    texts = ["plain", "THE SCHEMA", "schemata", "in \u1c83лагсы", "СЛИТКАМИ!", "слиткачество", "V_frame", "raw", None, "drawn"]
    rows = [("V", k, f"V_claim_{k + 1:06d}", "c", "rule", f"s{k}", t, t, None, ["x"], [], ["x"], ["\u00a0 seen"] if k == 0 else ["seen"], ["fit"]) for k, t in enumerate(texts)]
    found = cl.claim_violations(spark.createDataFrame(rows, fields), spark.createDataFrame([("c",)], "chunk_id string"))
    got = {(int(r["claim_id"][-6:]) - 1, r["code"]) for r in found.collect()}
    assert got == {(0, "evidence_prefix"), (1, "technical_marker"), (3, "unnormalised_term"), (4, "unnormalised_term"), (6, "technical_marker"), (7, "technical_marker")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "translate(" not in plan and plan.count("lower(value") <= 1 + plan.count("contains(lower(")
    odd = spark.createDataFrame([(t,) for t in ("\u1c83лагсы", "СеРсаКер,", "а тенсил", "İтенсил", None, "слагсысы")], "t string")
    assert all(r[0] == r[1] for r in odd.select(tx.has_unnormalised_term("t"), F.coalesce("t", F.lit("")).rlike(r"(?iU)\b(?:слагсы|серсакер|тенсил)\b")).collect())
    edges = ["", " ", "a", "\u2003a\u00a0", "a b\n", "\u0085", None, "a\u200b "]
    strips = spark.createDataFrame([(e,) for e in edges], "t string").select(tx.strip("t").alias("a"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("b")).collect()
    assert all(r["a"] == r["b"] for r in strips)


def test_unit_payloads_round_trip(spark):
    import json

    units = tr.transcript_units(tokens(spark, [("Да", 0, 1250, "a"), (" нет.", 1300, 2000, "a")]))
    payload = json.loads(tr.unit_payloads(units).first()["payload"])
    assert (payload["unit_index"], payload["start"], payload["end"], payload["duration"], payload["word_count"], payload["text"]) == (1, 0.0, 2.0, 2.0, 2, "Да нет.")
    assert (payload["boundary_reason"], payload["can_end_segment"], payload["must_end_segment"], payload["speaker_role"]) == ("end", True, True, None)


def test_note_lines_in_order(spark):
    from talkloom.sources import notes

    videos = spark.createDataFrame([("v", "Talk", "u", "ch", 12.5)], "video_id string, title string, url string, channel string, duration double")
    chunks = spark.createDataFrame([("v", 9000, "b"), ("v", 0, "a")], "video_id string, start_ms long, chunk_id string")
    index = [r["line"] for r in notes.index_lines(videos, chunks, "KB").orderBy("section", "ordinal").collect()]
    assert index == ["# KB", "", "- Video: [Talk](u)", "- Channel: ch", "- Job ID: `v`", "- Chunks: 2", "", "## Chunks", "", "- [[chunks/a|a]]", "- [[chunks/b|b]]"]
    turns = spark.createDataFrame([("s", 1, "host", "h", "B"), ("s", 0, None, None, "A")], "scene_id string, turn_index long, speaker_role string, speaker string, text string")
    events = spark.createDataFrame([("v", "s", 0, 1500, "t", ["x", "y"], [], "A B", "seen", ["SALE"], ("calm",))], "video_id string, scene_id string, start_ms long, end_ms long, timestamp_url string, topics array<string>, items array<string>, speech_text string, visual_summary string, on_screen_text array<string>, presenter_context struct<narrative_brief:string>")
    frames = spark.createDataFrame([("s", 2, "f2.jpg"), ("s", 1, "f1.jpg")], "scene_id string, ts_ms long, path string")
    claims = spark.createDataFrame([("v", 1, 500, "t", "suit", "wear it", "", ["cold"], [], ["rain"])], "video_id string, claim_pos long, start_ms long, timestamp_url string, subject string, claim string, rationale string, conditions array<string>, prefer array<string>, avoid array<string>")
    lines = [r["line"] for r in notes.video_lines(videos, claims, events, turns, frames).orderBy("section", "ordinal").collect()]
    assert lines[0] == "# Talk\n\n- Channel: ch\n- URL: u\n- Video ID: `v`\n- Duration: 12.5s\n"
    assert lines[1:3] == ["## Style Claims\n", "- [0.5s](t) **suit**: wear it\n  - Conditions: cold\n  - Avoid: rain"]
    assert lines[3:5] == ["", "## Timeline\n"]
    assert lines[5] == (
        "### 0.0s -> 1.5s\n\n- Timestamp: [YouTube](t)\n- Topics: x, y\n- Items: \n- Presenter: calm\nГолос: A\nВедущий (h): B\n\nseen\n\n"
        "On-screen text:\n- SALE\n\nFrames:\n![](../../../f1.jpg)\n![](../../../f2.jpg)\n"
    )


def test_stored_segments_must_be_a_fix_point_of_merging(spark):
    rows, segs = [], []
    for seg, (speaker, words) in enumerate([("a", 3), ("a", 3), ("b", 3), ("b", 40)]):
        start = len(rows)
        for k in range(words):
            p = len(rows)
            rows.append(("v", p, f" w{p}", 400 * p, 400 * p + 300, speaker, "host"))
        segs.append(("v", seg, f"s{seg}", 400 * start, 400 * (len(rows) - 1) + 300, start, len(rows) - 1, words, speaker, "host", " ".join(f"w{p}" for p in range(start, len(rows)))))
    tokens = spark.createDataFrame(rows, "video_id string, pos long, text string, start_ms long, end_ms long, speaker string, speaker_role string")
    segments = spark.createDataFrame(segs, "video_id string, seg long, segment_id string, start_ms long, end_ms long, start_pos long, end_pos long, words long, speaker string, speaker_role string, text string")
    units = segments.select("video_id", "start_pos", "end_pos", F.lit(True).alias("can_end"), (F.col("seg") == 1).alias("must_end"))
    check = lambda s: sorted((r["seg"], r["code"]) for r in tr.segment_table_violations(s, units, tokens).collect())
    assert check(segments) == [(0, "not_merged"), (2, "not_merged")]
    merged = tr.merge_short_segments(segments).select(*segments.columns)
    assert [c for c in check(merged) if c[1] == "not_merged"] == []
    late = segments.withColumn("end_pos", F.when(F.col("seg") == 1, F.col("end_pos") + 1).otherwise(F.col("end_pos")))
    assert {(1, "must_end_inside"), (1, "ends_inside_unit"), (2, "token_gap_or_overlap"), (1, "speaker_disagrees"), (1, "text_disagrees"), (1, "times_disagree")} <= set(check(late))


def test_a_segment_that_ends_far_behind_the_stream_meets_its_tokens_alone(spark):
    tokens = spark.createDataFrame([(1, p, f" w{p}", 100 * p, 100 * p + 50, "a", "host") for p in range(6)], "video_id long, pos long, text string, start_ms long, end_ms long, speaker string, speaker_role string")
    units = spark.createDataFrame([(1, 0, 2, True, True), (1, 3, 5, True, True)], "video_id long, start_pos long, end_pos long, can_end boolean, must_end boolean")
    row = "video_id long, seg long, segment_id string, start_ms long, end_ms long, start_pos long, end_pos long, words long, speaker string, speaker_role string, text string"
    segments = spark.createDataFrame([(1, 0, "s0", 0, 250, 0, 2, 3, "a", "host", "w0 w1 w2"), (1, 1, "s1", 300, 550, 3, 10**12, 3, "a", "host", "w3 w4 w5")], row)
    found = tr.segment_table_violations(segments, units, tokens, merged=False)
    assert sorted((r["seg"], r["code"]) for r in found.collect()) == [(-1, "stream_not_covered"), (1, "ends_inside_unit"), (1, "must_end_inside"), (1, "unknown_end")]
