"""Markers in texts against a search for each in each."""

import random

from pyspark.sql import functions as F

from talkloom.functions import text as tx
from talkloom.operators import visual as vis

FIELDS = ["visual_summary", "observations", "interpretations", "items", "style_topics", "notes"]
EVENT = "video_id string, scene_id string, visual_summary string, observations array<string>, interpretations array<string>, items array<string>, style_topics array<string>, notes string, recurring boolean"


def test_markers_equal_substring_search(spark):
    rng = random.Random(5)
    words = ["red", "scarf", "a", "it", "with", "spring", "ring", "éclair", "dress", "ress", "hat", "x"]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    events = []
    for k in range(150):
        texts = [[pick(rng.randrange(0, 6)) for _ in range(rng.randrange(0, 3))] for _ in range(6)]
        flat = [" ".join(texts[0]) or None, *texts[1:5], " ".join(texts[5])]
        events.append((rng.choice(["hot"] * 3 + ["v", "w"]), f"s{k}", *flat, rng.random() < 0.8))
    markers = {}
    for video in ("hot", "v", "other"):
        for _ in range(60):
            key = pick(rng.randrange(1, 4))
            for cut in (key, key[1:], key[:-1], key[2:-2]):
                if cut and cut == " ".join(cut.split()):
                    markers[video, cut] = cut.upper()
    frame = spark.createDataFrame(events, EVENT).withColumn("presenter_context", F.struct(F.col("recurring").alias("is_recurring"))).drop("recurring")
    table = spark.createDataFrame([(v, k, m, 0) for (v, k), m in markers.items()], "video_id string, marker_key string, marker string, ordinal int")
    got = sorted((r["video_id"], r["scene_id"], r["field"], r["marker"]) for r in vis.baseline_leakage(frame, table, ["video_id", "scene_id"]).collect())
    want = []
    for e in events:
        for field, value in zip(FIELDS, e[2:8], strict=True):
            text = " ".join(" ".join(value if isinstance(value, list) else [value or ""]).split())
            want += [(e[0], e[1], field, m) for (v, k), m in markers.items() if e[8] and v == e[0] and k in text]
    assert got == sorted(want) and len(got) > 500


def test_every_text_of_a_row_is_judged_once(spark):
    rows = spark.createDataFrame([(1, "s", ["on  screen", "plain", None], ["plain", "on screen", "red"]), (2, None, None, ["Red"])], "k int, visual_summary string, observations array<string>, items array<string>")
    fields = ["visual_summary", "observations", "items"]
    found = vis.marker_kinds(rows, ["k"], fields, ["technical", "presentation"])
    assert sorted((r["k"], r["field"], r["marker"], r["kind"]) for r in found.collect()) == [(1, "items", "on screen", "technical"), (1, "items", "red", "technical"), (1, "observations", "on screen", "technical"), (2, "items", "Red", "technical")]
    for frame in (found, vis.marker_hits(rows, ["k"], fields, "noise")):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count(tx.NOT_WORD + "+") == 1


def test_first_words_of_a_text_are_cut_without_splitting_the_rest(spark, tmp_path):
    import re

    from talkloom.plans import inputs

    texts = ["", " ,. a b", "a,b;c:d!e?f.g h i j k l", "...one two three four five six seven eight nine", "one two three four five six seven eight", "one\n\ntwo. ", "a b c d e f g h "]
    spark.createDataFrame([(k, t, "de", "web", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    events = inputs.visual_events(spark, str(tmp_path)).select("doc_id", "items", "on_screen_text", "presentation_context", "style_topics")
    for row in events.collect():
        words = [w for w in re.split(r"[\s.,;:!?]+", texts[row["doc_id"]]) if w]
        assert (row["items"], row["on_screen_text"], row["presentation_context"]) == (words[:5], words[2:5], words[6:8])
        assert row["style_topics"][2] == (words[5] if len(words) > 5 else "")
    assert "!?]+, 10)" in events._jdf.queryExecution().optimizedPlan().toString()
