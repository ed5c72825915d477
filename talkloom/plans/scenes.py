"""Registered queries over scenes, frames and palettes."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.config import PaletteLimits
from talkloom.operators import frames as fr
from talkloom.operators import palette as pal
from talkloom.operators import scenes as sc
from talkloom.plans import inputs
from talkloom.plans import oracle_inputs as oi
from talkloom.session import materialise

SCENES = r"""
vid AS (SELECT video_id, max(end_ms) AS duration_ms FROM tok GROUP BY 1),
fin AS (SELECT video_id, greatest(1, CAST(round_even(duration_ms * 25 / 1000.0, 0) AS BIGINT)) AS f FROM vid),
scn AS (
  SELECT video_id, CAST(i // 750 AS BIGINT) AS scene_index, printf('%d_scene_%06d', video_id, i // 750) AS scene_id, i AS start_frame, least(i + 750, f) AS end_frame,
    i * 40 AS start_ms, least(i + 750, f) * 40 AS end_ms, (least(i + 750, f) - i) * 40 AS duration_ms
  FROM (SELECT video_id, f, unnest(range(0, f, 750)) AS i FROM fin))"""
SCN = oi.with_ctes(oi.TOKENS, SCENES).rstrip() + " "


def fallback_scenes(spark, sf_dir):
    videos = inputs.video_ends(inputs.tokens(spark, sf_dir))
    return sc.scenes_from_boundaries(sc.fallback_boundaries(videos))


SCENE_TILES = SCN + "SELECT video_id, scene_index, scene_id, start_frame, end_frame, start_ms, end_ms, duration_ms FROM scn"


def _damaged(scenes):
    """Every seventh scene starts 10 frames late, so that gaps exist to be found."""
    late = F.when(F.col("scene_index") % 7 == 3, 10).otherwise(0)
    return scenes.withColumn("start_frame", F.col("start_frame") + late)


def scene_violations(spark, sf_dir):
    return sc.scene_violations(_damaged(fallback_scenes(spark, sf_dir)))


SCENE_VIOLATIONS = SCN + """, dmg AS (SELECT video_id, scene_index, start_frame + CASE WHEN scene_index % 7 = 3 THEN 10 ELSE 0 END AS s, end_frame AS e FROM scn),
lg AS (SELECT *, lag(e) OVER (PARTITION BY video_id ORDER BY scene_index) AS pe FROM dmg)
SELECT video_id, scene_index, 'coverage_gap_or_overlap' AS code FROM lg WHERE pe <> s
UNION ALL SELECT video_id, scene_index, 'empty_scene' FROM lg WHERE s >= e"""


def scene_statistics(spark, sf_dir):
    return sc.scene_statistics(fallback_scenes(spark, sf_dir))


SCENE_STATISTICS = SCN + "SELECT video_id, count(*) AS scenes_count, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms, round_even(avg(duration_ms), 3) AS avg_ms FROM scn GROUP BY 1"


def scene_report(spark, sf_dir):
    """Detected scenes exist for even videos only; the others fall back to tiling."""
    scenes = materialise(fallback_scenes(spark, sf_dir))
    detected = scenes.where("video_id % 2 = 0")
    shifted = scenes.where("scene_index % 5 = 2").select("video_id", "scene_index")
    videos = inputs.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id")).distinct()
    return sc.scene_report(detected, _damaged(scenes), shifted, videos)


SCENE_REPORT = SCN + """, dmg AS (SELECT *, start_frame + CASE WHEN scene_index % 7 = 3 THEN 10 ELSE 0 END AS s FROM scn),
lg AS (SELECT *, lag(end_frame) OVER (PARTITION BY video_id ORDER BY scene_index) AS pe FROM dmg)
SELECT video_id, CASE WHEN video_id % 2 = 0 THEN count(*) ELSE 0 END AS detected_scenes, count(*) AS scenes_count, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms,
  round_even(avg(duration_ms), 3) AS avg_ms, count(*) FILTER (scene_index % 5 = 2) AS boundary_adjustments, count(*) FILTER (pe <> s) AS coverage_warnings, video_id % 2 <> 0 AS fallback_used
FROM lg GROUP BY video_id"""


def scene_report_drift(spark, sf_dir):
    """Stored scene reports against the detector settings in force."""
    videos = inputs.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("video_id")).agg(F.count("*").alias("turns"))
    reports = videos.select(
        "video_id",
        F.when(F.col("turns") > 5, "adaptive").otherwise("content").alias("detector"),
        F.when(F.col("video_id") % 3 == 0, F.lit(None).cast("int")).otherwise(F.lit(38)).alias("min_scene_len_frames"),
        F.lit(1).alias("schema_version"),
    )
    return sc.report_drift(reports, {"detector": "adaptive", "min_scene_len_frames": 38, "schema_version": 1})


SCENE_REPORT_DRIFT = """
WITH v AS (SELECT conv_id AS video_id, count(*) AS turns FROM conversations GROUP BY 1)
SELECT video_id, 'detector' AS field FROM v WHERE turns <= 5 UNION ALL SELECT video_id, 'min_scene_len_frames' FROM v WHERE video_id % 3 = 0"""


def frame_plan(spark, sf_dir):
    return sc.frame_plan(fallback_scenes(spark, sf_dir)).select("video_id", "scene_id", "image_index", "planned_ms", "frame_role")


PLAN = SCN + r""",
cntd AS (SELECT *, CAST(CASE WHEN duration_ms <= 4000 THEN 1 WHEN duration_ms <= 8000 THEN 2 ELSE greatest(1, least(8, greatest(4, ceil(duration_ms / 1000.0 / 4)))) END AS INT) AS n,
    CASE WHEN duration_ms > 700 THEN start_ms + 350 ELSE start_ms END AS lo,
    CASE WHEN duration_ms > 700 THEN end_ms - 350 ELSE greatest(end_ms - 1, start_ms) END AS hi FROM scn),
slots AS (SELECT *, unnest(range(0, n)) AS i FROM cntd),
tsd AS (SELECT *, CAST(round_even(greatest(lo, least(start_ms + duration_ms * CASE WHEN n = 1 THEN CAST(0.5 AS DOUBLE) WHEN n = 2 THEN CAST([0.33, 0.67][i + 1] AS DOUBLE)
    WHEN n = 3 THEN CAST([0.15, 0.5, 0.85][i + 1] AS DOUBLE) ELSE (i + CAST(0.5 AS DOUBLE)) / n END, hi)), 0) AS BIGINT) AS planned_ms FROM slots),
plan AS (SELECT video_id, scene_id, scene_index, lo, hi, planned_ms, min(i) AS i0, any_value(n) AS n FROM tsd GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY i0) AS image_index, CASE WHEN i0 < least(n, 4) THEN 'keyframe' ELSE 'sample' END AS frame_role FROM plan)
"""
FRAME_PLAN = PLAN + "SELECT video_id, scene_id, image_index, planned_ms, frame_role FROM numbered"


def probe_grid(spark, sf_dir):
    grid = sc.probe_grid(sc.frame_plan(fallback_scenes(spark, sf_dir)))
    return grid.select("scene_id", "image_index", F.explode("requested").alias("requested_ms"))


PROBE_GRID = PLAN + """
SELECT DISTINCT scene_id, image_index, CAST(greatest(lo, least(planned_ms + o, hi)) AS BIGINT) AS requested_ms
FROM numbered, (SELECT unnest([-600, -300, 0, 300, 600]) AS o)"""


def _q(i):
    return F.bround(F.get("embedding", F.lit(i)).cast("double") * 1000).cast("long")


def frame_features(spark, sf_dir):
    """Frame features out of the embedding table: eight frames to a scene, hash bits from the signs."""
    emb = inputs.table(spark, sf_dir, "embeddings")
    bits = F.transform("embedding", lambda v, i: F.when(v > 0, F.shiftleft(F.lit(1).cast("long"), 0)).otherwise(F.lit(0).cast("long")))
    packed = F.aggregate(
        bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b)
    )
    tiles = F.transform(F.slice("embedding", 9, 16), lambda v: F.abs(F.bround(v.cast("double") * 1000)))
    scene = F.floor(F.col("vec_id") / 8).cast("long")
    slot = (F.col("vec_id") % 8).cast("long")
    return emb.select(
        scene.alias("scene"),
        (slot + 1).alias("image_index"),
        F.when(slot < 4, "keyframe").otherwise("sample").alias("frame_role"),
        (30000 * scene + 3000 * slot).alias("ts_ms"),
        F.concat(F.lit("frames/"), F.col("vec_id"), F.lit(".jpg")).alias("path"),
        packed.alias("phash"),
        F.abs(_q(0)).cast("double").alias("global_sharpness"),
        F.abs(_q(0)).cast("double").alias("sharpness"),
        (F.abs(_q(1)) / 4).alias("contrast"),
        (F.abs(_q(2)) / 2000).alias("edge_density"),
        (F.abs(_q(3)) / 8).alias("mean_saturation"),
        (F.abs(_q(4)) / 5).alias("saturation_p90"),
        tiles.alias("tiles"),
    )


FEATURES = r"""
fq AS (SELECT vec_id, vec_id // 8 AS scene, vec_id % 8 + 1 AS image_index, CASE WHEN vec_id % 8 < 4 THEN 'keyframe' ELSE 'sample' END AS frame_role,
    30000 * (vec_id // 8) + 3000 * (vec_id % 8) AS ts_ms, embedding AS v,
    list_transform(embedding, lambda x: abs(round_even(CAST(x AS DOUBLE) * 1000, 0))) AS q FROM embeddings),
fm AS (SELECT *, q[1] AS gs, q[2] / 4 AS co, q[3] / 2000 AS ed, q[4] / 8 AS ms, q[5] / 5 AS p90, q[9:24] AS tiles,
    len(list_filter(q[9:24], lambda x: x < 20)) / 16.0 AS br, len(list_filter([q[14], q[15], q[18], q[19]], lambda x: x < 20)) / 4.0 AS cb FROM fq),
fx AS (SELECT *, gs < 35 AS ls, co < 18 AS lc, ed < 0.035 AS le, ms < 18 AND p90 < 32 AS lsat, cb >= 0.5 AS hc, ms < 18 AND p90 < 32 AND co < 30 AND ed < 0.06 AS grey FROM fm),
fs AS (SELECT *, greatest(0.0, round_even(0.55 * least(1.0, ln(1 + gs) / ln(181.0)) + 0.20 * least(1.0, ln(1 + co) / ln(49.0)) + 0.15 * least(1.0, ed / 0.16)
    - 0.10 * br - 0.20 * cb - CASE WHEN grey THEN 0.18 ELSE 0.0 END, 6)) AS score,
    CASE WHEN (ls AND (lc OR le)) OR grey OR hc THEN 'low_quality_kept' ELSE 'good' END AS quality_class FROM fx)"""
FEAT = oi.with_ctes(FEATURES).rstrip() + " "


def quality_flags(spark, sf_dir):
    return fr.quality(fr.tile_ratios(frame_features(spark, sf_dir))).select(
        "scene", "image_index", F.array_join("flags", ",").alias("flags"), "score", "quality_class",
        "blurred_tile_ratio", "central_blurred_tile_ratio",
        *[F.bround(c, 3).alias(c) for c in ("tile_p10", "tile_p50", "tile_p90")],
    )


QUALITY_FLAGS = FEAT + """
SELECT scene, image_index, array_to_string(list_filter([CASE WHEN ls THEN 'low_global_sharpness' END, CASE WHEN lc THEN 'low_contrast' END, CASE WHEN le THEN 'low_edge_density' END,
    CASE WHEN lsat THEN 'low_saturation' END, CASE WHEN br >= 0.65 THEN 'high_blurred_tile_ratio' END, CASE WHEN hc THEN 'high_central_blurred_tile_ratio' END,
    CASE WHEN ls AND (lc OR le) THEN 'transition_like' END, CASE WHEN hc AND NOT ls THEN 'partial_blur_like' END, CASE WHEN grey THEN 'gray_transition_like' END], lambda x: x IS NOT NULL), ',') AS flags,
  score, quality_class, CAST(br AS DOUBLE) AS blurred_tile_ratio, CAST(cb AS DOUBLE) AS central_blurred_tile_ratio,
  round_even(list_aggregate(tiles, 'quantile_cont', 0.1), 3) AS tile_p10, round_even(list_aggregate(tiles, 'quantile_cont', 0.5), 3) AS tile_p50, round_even(list_aggregate(tiles, 'quantile_cont', 0.9), 3) AS tile_p90
FROM fs"""


def probe_selection(spark, sf_dir):
    """Four probes to a slot; the planned time lies between the second and the third."""
    scored = fr.quality(fr.tile_ratios(frame_features(spark, sf_dir)))
    probes = scored.select(
        "scene", F.floor((F.col("image_index") - 1) / 4).cast("long").alias("slot"), ((F.col("image_index") - 1) % 4).alias("probe"), "ts_ms", "score",
    ).withColumn("planned_ms", 30000 * F.col("scene") + 12000 * F.col("slot") + 4000)
    grid = F.transform(F.array(*[F.lit(o) for o in (-3000, 0, 3000)]), lambda o: F.col("planned_ms") + o)
    near = sc.nearest_requested(probes.withColumn("requested", grid))
    asked = near.groupBy("scene", "slot").agg(F.sum("requested_ms").alias("requested_sum"))
    return sc.select_probe(probes, ["scene", "slot"]).join(asked, ["scene", "slot"])


PROBE_SELECTION = FEAT + r""",
pr AS (SELECT scene, (image_index - 1) // 4 AS slot, (image_index - 1) % 4 AS probe, ts_ms, score, 30000 * scene + 12000 * ((image_index - 1) // 4) + 4000 AS planned_ms FROM fs),
nr AS (SELECT *, (SELECT p FROM (SELECT unnest([planned_ms - 3000, planned_ms, planned_ms + 3000]) AS p) ORDER BY abs(p - ts_ms), p LIMIT 1) AS requested_ms FROM pr),
rk AS (SELECT *, row_number() OVER (PARTITION BY scene, slot ORDER BY abs(ts_ms - planned_ms), probe) AS a, row_number() OVER (PARTITION BY scene, slot ORDER BY score DESC, probe) AS b FROM nr),
ch AS (SELECT scene, slot, count(*) AS probes, sum(requested_ms) AS rs, max(probe) FILTER (a = 1) AS pp, max(score) FILTER (a = 1) AS ps, max(ts_ms) FILTER (a = 1) AS pt,
   max(probe) FILTER (b = 1) AS bp, max(score) FILTER (b = 1) AS bs, max(ts_ms) FILTER (b = 1) AS bt FROM rk GROUP BY 1, 2)
SELECT scene, slot, probes, CASE WHEN ps >= bs * 0.92 THEN pp ELSE bp END AS selected_probe, CASE WHEN ps >= bs * 0.92 THEN pt ELSE bt END AS ts_ms, CASE WHEN ps >= bs * 0.92 THEN ps ELSE bs END AS score,
  CASE WHEN ps >= bs * 0.92 OR pp = bp THEN 'planned_nearest_kept' ELSE 'replaced_by_higher_quality_probe' END AS decision, CAST(rs AS BIGINT) AS requested_sum FROM ch"""


def quality_drop(spark, sf_dir):
    scored = fr.quality(fr.tile_ratios(frame_features(spark, sf_dir)))
    return fr.quality_drop(scored, ["scene"], min_frames=2)


QDROP = r""",
qw AS (
  SELECT scene, CAST(0 AS BIGINT) AS image_index, count(*) AS lft, count(*) FILTER (frame_role = 'keyframe') AS ks, '' AS status, CAST(NULL AS VARCHAR) AS guard FROM fs GROUP BY scene
  UNION ALL
  SELECT f.scene, f.image_index, w.lft - CASE WHEN f.d THEN 1 ELSE 0 END, w.ks - CASE WHEN f.d AND f.frame_role = 'keyframe' THEN 1 ELSE 0 END,
    CASE WHEN f.d THEN 'low_quality_dropped' ELSE f.quality_class END,
    CASE WHEN f.quality_class = 'low_quality_kept' AND f.am THEN 'min_scene_guard' WHEN f.quality_class = 'low_quality_kept' AND NOT f.d THEN 'only_keyframe_guard' END
  FROM qw w JOIN LATERAL (SELECT *, w.lft <= {MIN} AS am, quality_class = 'low_quality_kept' AND w.lft > {MIN} AND NOT (w.ks <= 1 AND frame_role = 'keyframe') AS d FROM fs x WHERE x.scene = w.scene AND x.image_index = w.image_index + 1) f ON true)
"""
FEAT_R = FEAT.replace("WITH ", "WITH RECURSIVE ", 1)
QUALITY_DROP = FEAT_R + QDROP.replace("{MIN}", "2") + "SELECT scene, image_index, status, guard FROM qw WHERE image_index > 0"


HASH_DISTANCE = "CAST(list_sum(list_transform(range(1, 65), lambda k: CASE WHEN ({a}[k] > 0) <> ({b}[k] > 0) THEN 1 ELSE 0 END)) AS BIGINT)"


def hamming_pairs(spark, sf_dir):
    return fr.hamming_pairs(frame_features(spark, sf_dir), ["scene"], 28)


HAMMING_PAIRS = FEAT + f"""
SELECT * FROM (SELECT a.scene, a.image_index AS left_index, b.image_index AS right_index, {HASH_DISTANCE.format(a='a.v', b='b.v')} AS distance
FROM fs a JOIN fs b ON a.scene = b.scene AND a.image_index < b.image_index) WHERE distance <= 28"""


def near_duplicates(spark, sf_dir):
    return fr.drop_near_duplicates(frame_features(spark, sf_dir), ["scene"], max_distance=30, min_frames=4)


def _dedup_sql(source: str, distance: int) -> str:
    return f""",
pro AS (SELECT scene, coalesce(min(image_index) FILTER (frame_role = 'keyframe'), min(image_index)) AS p FROM {source} GROUP BY 1),
ord AS (SELECT s.*, row_number() OVER (PARTITION BY s.scene ORDER BY s.ts_ms, s.image_index) AS k, p FROM {source} s JOIN pro USING (scene)),
pd AS (SELECT a.scene, a.k AS ka, b.k AS kb, a.image_index AS ia, {HASH_DISTANCE.format(a='a.v', b='b.v')} AS d FROM ord a JOIN ord b ON a.scene = b.scene AND a.k < b.k),
dw AS (
  SELECT scene, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS m FROM pro
  UNION ALL
  SELECT scene, k, CASE WHEN keep THEN list_append(kept, k) ELSE kept END, CASE WHEN NOT keep THEN m END FROM (
    SELECT o.scene, o.k, w.kept, c.m, o.image_index = o.p OR c.m IS NULL AS keep FROM dw w JOIN ord o ON o.scene = w.scene AND o.k = w.k + 1
    LEFT JOIN LATERAL (SELECT min(ka) AS m FROM pd WHERE pd.scene = o.scene AND pd.kb = o.k AND pd.d <= {distance} AND list_contains(w.kept, pd.ka)) c ON true)),
dd AS (SELECT o.scene, o.image_index, o.gs, o.k, w.m IS NULL AS kept, (SELECT ia FROM pd WHERE pd.scene = w.scene AND ka = w.m AND kb = w.k) AS matched_index,
    (SELECT d FROM pd WHERE pd.scene = w.scene AND ka = w.m AND kb = w.k) AS distance FROM dw w JOIN ord o ON o.scene = w.scene AND o.k = w.k)
"""


NEAR_DUPLICATES = FEAT_R + _dedup_sql("fs", 30) + """,
rr AS (SELECT *, count(*) FILTER (kept) OVER (PARTITION BY scene) AS nk, row_number() OVER (PARTITION BY scene, kept ORDER BY gs DESC, k) AS rk FROM dd)
SELECT scene, image_index, kept OR rk <= 4 - nk AS kept, CASE WHEN rk <= 4 - nk AND NOT kept THEN NULL ELSE matched_index END AS matched_index,
  CASE WHEN rk <= 4 - nk AND NOT kept THEN NULL ELSE distance END AS distance FROM rr"""


def frame_outcomes(spark, sf_dir):
    scored = materialise(fr.quality(fr.tile_ratios(frame_features(spark, sf_dir))))
    return fr.frame_outcomes(scored, ["scene"], max_distance=30)


FRAME_OUTCOMES = FEAT_R + QDROP.replace("{MIN}", "1") + """,
sv AS (SELECT f.* FROM fs f JOIN qw q ON q.scene = f.scene AND q.image_index = f.image_index WHERE q.status <> 'low_quality_dropped')""" + _dedup_sql("sv", 30) + """
SELECT q.scene, q.image_index, CASE WHEN q.status = 'low_quality_dropped' THEN 'quality_dropped' WHEN d.kept THEN 'kept' ELSE 'duplicate' END AS outcome, q.guard, d.matched_index, d.distance
FROM qw q LEFT JOIN dd d ON d.scene = q.scene AND d.image_index = q.image_index WHERE q.image_index > 0"""


def extraction_report(spark, sf_dir):
    return fr.extraction_report(frame_outcomes(spark, sf_dir), ["scene"])


EXTRACTION_REPORT = FRAME_OUTCOMES.replace("\nSELECT q.scene, q.image_index, CASE", ",\noc AS (SELECT q.scene, q.image_index, CASE", 1) + """)
SELECT scene, count(*) AS frames_planned, count(*) FILTER (outcome = 'kept') AS frames_kept, count(*) FILTER (outcome = 'quality_dropped') AS dropped_quality,
  count(*) FILTER (outcome = 'duplicate') AS dropped_duplicate, count(guard) AS guarded, true AS adds_up FROM oc GROUP BY 1"""


def bootstrap_sample(spark, sf_dir):
    """Scenes to draw a presenter profile from, each with its middle frame out of the plan."""
    scenes = materialise(fallback_scenes(spark, sf_dir))
    frames = sc.frame_plan(scenes).select(
        "video_id", "scene_id", F.col("planned_ms").alias("ts_ms"), F.concat("scene_id", F.lit("/"), "image_index").alias("path")
    )
    picked = sc.bootstrap_sample(scenes, limit=5).select("video_id", "scene_index", "scene_id")
    return picked.join(sc.middle_frame(frames), ["video_id", "scene_id"], "left")


BOOTSTRAP_SAMPLE = PLAN + r""",
bc AS (SELECT video_id, greatest(1, (max(scene_index) + 1) // 2) AS half FROM scn GROUP BY 1),
be AS (SELECT *, least(3, half) AS early, 5 - least(3, half) AS lft, half - least(3, half) AS free FROM bc),
ix AS (SELECT video_id, unnest(range(0, early)) AS scene_index FROM be
  UNION SELECT video_id, unnest(range(early, half)) FROM be WHERE lft > 0 AND free > 0 AND lft >= free
  UNION SELECT video_id, CAST(early + round_even(i * ((free - 1) / greatest(lft - 1, 1)), 0) AS BIGINT) FROM (SELECT *, unnest(range(0, lft)) AS i FROM be WHERE lft > 0 AND free > 0 AND lft < free)),
mf AS (SELECT scene_id, list(scene_id || '/' || image_index ORDER BY planned_ms) AS l FROM numbered GROUP BY 1)
SELECT s.video_id, s.scene_index, s.scene_id, l[len(l) // 2 + 1] AS path FROM ix JOIN scn s USING (video_id, scene_index) LEFT JOIN mf USING (scene_id)"""


def palette_samples(spark, sf_dir):
    """Palette samples out of the embedding table: four a second, peaked histograms, ten-second scenes."""
    emb = inputs.table(spark, sf_dir, "embeddings")
    at = F.col("vec_id") % 100
    weights = F.transform("embedding", lambda v: F.pow(v.cast("double") * (1 + F.col("vec_id") % 100 / 25), F.lit(2.0)))
    return (
        emb.withColumn("w", weights)
        .withColumn("mass", pal.array_sum(F.col("w")))
        .select(
            F.floor(F.col("vec_id") / 100).cast("long").alias("video_id"),
            F.floor(at / 40).cast("long").alias("scene_index"),
            (at * 250).cast("long").alias("ts_ms"),
            F.abs(_q(0)).cast("double").alias("saturation"),
            (F.abs(_q(1)) / 4).alias("colorfulness"),
            F.transform("w", lambda x: x / F.col("mass")).alias("histogram"),
        )
    )


def _palette_scenes(samples):
    return samples.groupBy("video_id", "scene_index").agg(F.min("ts_ms").alias("start_ms"), (F.max("ts_ms") + 250).alias("end_ms")).withColumns(
        {"start_frame": F.col("start_ms") / 40, "end_frame": F.col("end_ms") / 40}
    ).withColumns({c: F.col(c).cast("long") for c in ("start_frame", "end_frame")})


LOOSE = PaletteLimits(min_histogram_distance=0.53, min_confidence=0.6, max_boundary_shift_seconds=6.0, min_scene_duration_seconds=5.0)


def palette_candidates(spark, sf_dir):
    samples = materialise(palette_samples(spark, sf_dir))
    return pal.boundary_candidates(samples, _palette_scenes(samples), LOOSE).select(
        "video_id", "scene_index", "ts_ms", "reason", *[F.bround(c, 6).alias(c) for c in ("confidence", "distance", "next_distance")]
    )


PALETTE = r"""
WITH ps AS (SELECT vec_id // 100 AS video_id, (vec_id % 100) // 40 AS scene_index, (vec_id % 100) * 250 AS ts_ms, abs(round_even(CAST(embedding[1] AS DOUBLE) * 1000, 0)) AS sat,
    abs(round_even(CAST(embedding[2] AS DOUBLE) * 1000, 0)) / 4 AS col, list_transform(embedding, lambda x: pow(CAST(x AS DOUBLE) * (1 + vec_id % 100 / 25), 2)) AS w FROM embeddings),
bin AS (SELECT video_id, scene_index, ts_ms, b, w[b] / list_sum(w) AS h FROM (SELECT *, unnest(range(1, 65)) AS b FROM ps)),
sc AS (SELECT video_id, scene_index, min(ts_ms) AS s, max(ts_ms) + 250 AS e, count(*) AS n FROM ps GROUP BY 1, 2),
bd AS (SELECT a.*, b.s AS ns, b.n AS nn, b.e - b.s AS nd, (SELECT count(*) FROM ps WHERE ps.video_id = a.video_id AND ps.scene_index = a.scene_index + 1 AND ts_ms BETWEEN b.s AND b.s + 1000) AS nw
  FROM sc a JOIN sc b ON b.video_id = a.video_id AND b.scene_index = a.scene_index + 1),
br AS (SELECT *, CASE WHEN e - s < 5000 OR n < 4 THEN 'insufficient_previous_samples' WHEN nd < 5000 OR nn < 2 THEN 'insufficient_next_samples' WHEN nw < 2 THEN 'insufficient_next_profile' END AS r FROM bd),
cd AS (SELECT p.video_id, p.scene_index, p.ts_ms, CASE WHEN b.e - p.ts_ms > 6000 THEN 'outside_boundary_shift_window' WHEN least(p.ts_ms - b.s, b.e - p.ts_ms) < 750 THEN 'edge_guard'
   WHEN least(p.ts_ms - b.s, b.e - p.ts_ms) < 1500 THEN 'min_segment' END AS g FROM ps p JOIN br b USING (video_id, scene_index) WHERE b.r IS NULL AND p.ts_ms > b.s AND p.ts_ms < b.e),
zn AS (SELECT 'left' AS z UNION ALL SELECT 'right' UNION ALL SELECT 'post'),
wn AS (SELECT c.video_id, c.scene_index, c.ts_ms, z, p.ts_ms AS st, p.sat, p.col FROM cd c, zn, ps p WHERE c.g IS NULL AND p.video_id = c.video_id AND p.scene_index = c.scene_index
   AND ((z = 'left' AND p.ts_ms >= c.ts_ms - 1000 AND p.ts_ms < c.ts_ms) OR (z = 'right' AND p.ts_ms BETWEEN c.ts_ms AND c.ts_ms + 1000) OR (z = 'post' AND p.ts_ms BETWEEN c.ts_ms + 1000 AND c.ts_ms + 2000))),
wp AS (SELECT video_id, scene_index, ts_ms, z, count(*) AS n, median(sat) AS sat, median(col) AS col FROM wn GROUP BY ALL),
wh AS (SELECT w.video_id, w.scene_index, w.ts_ms, w.z, b.b, avg(b.h) AS h FROM wn w JOIN bin b ON b.video_id = w.video_id AND b.scene_index = w.scene_index AND b.ts_ms = w.st GROUP BY ALL),
nh AS (SELECT r.video_id, r.scene_index, b.b, avg(b.h) AS h FROM br r JOIN bin b ON b.video_id = r.video_id AND b.scene_index = r.scene_index + 1 AND b.ts_ms BETWEEN r.ns AND r.ns + 1000 WHERE r.r IS NULL GROUP BY ALL),
sd AS (SELECT video_id, scene_index, ts_ms, z, median(d) AS spread FROM (SELECT w.video_id, w.scene_index, w.ts_ms, w.z, w.st, sqrt(greatest(0.0, 1 - sum(sqrt(b.h * h.h)))) AS d
   FROM wn w JOIN bin b ON b.video_id = w.video_id AND b.scene_index = w.scene_index AND b.ts_ms = w.st JOIN wh h ON h.video_id = w.video_id AND h.scene_index = w.scene_index AND h.ts_ms = w.ts_ms AND h.z = w.z AND h.b = b.b GROUP BY ALL) GROUP BY ALL),
ds AS (SELECT l.video_id, l.scene_index, l.ts_ms, sqrt(greatest(0.0, 1 - sum(sqrt(l.h * r.h)))) AS d, sqrt(greatest(0.0, 1 - sum(sqrt(r.h * x.h)))) AS nd FROM wh l JOIN wh r ON r.video_id = l.video_id AND r.scene_index = l.scene_index AND r.ts_ms = l.ts_ms AND r.b = l.b AND r.z = 'right'
   JOIN nh x ON x.video_id = l.video_id AND x.scene_index = l.scene_index AND x.b = l.b WHERE l.z = 'left' GROUP BY ALL),
po AS (SELECT r.video_id, r.scene_index, r.ts_ms, sqrt(greatest(0.0, 1 - sum(sqrt(r.h * p.h)))) AS pd FROM wh r JOIN wh p ON p.video_id = r.video_id AND p.scene_index = r.scene_index AND p.ts_ms = r.ts_ms AND p.b = r.b AND p.z = 'post' WHERE r.z = 'right' GROUP BY ALL),
cf AS (SELECT c.video_id, c.scene_index, c.ts_ms, coalesce(l.n, 0) AS ln, coalesce(r.n, 0) AS rn, coalesce(p.n, 0) AS pn, d.d, d.nd, po.pd,
   0.65 * least(1.0, d.d / 0.53) + 0.20 * greatest(0.0, least(1 - least(1.0, ls.spread / 0.53), 1 - least(1.0, rs.spread / 0.53))) + 0.15 * greatest(least(1.0, abs(l.sat - r.sat) / 30), least(1.0, abs(l.col - r.col) / 8)) AS conf
  FROM cd c LEFT JOIN wp l ON l.video_id = c.video_id AND l.scene_index = c.scene_index AND l.ts_ms = c.ts_ms AND l.z = 'left' LEFT JOIN wp r ON r.video_id = c.video_id AND r.scene_index = c.scene_index AND r.ts_ms = c.ts_ms AND r.z = 'right'
  LEFT JOIN wp p ON p.video_id = c.video_id AND p.scene_index = c.scene_index AND p.ts_ms = c.ts_ms AND p.z = 'post' LEFT JOIN ds d ON d.video_id = c.video_id AND d.scene_index = c.scene_index AND d.ts_ms = c.ts_ms
  LEFT JOIN sd ls ON ls.video_id = c.video_id AND ls.scene_index = c.scene_index AND ls.ts_ms = c.ts_ms AND ls.z = 'left' LEFT JOIN sd rs ON rs.video_id = c.video_id AND rs.scene_index = c.scene_index AND rs.ts_ms = c.ts_ms AND rs.z = 'right'
  LEFT JOIN po ON po.video_id = c.video_id AND po.scene_index = c.scene_index AND po.ts_ms = c.ts_ms WHERE c.g IS NULL),
allc AS (
SELECT video_id, scene_index, CAST(NULL AS BIGINT) AS ts_ms, r AS reason, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS DOUBLE) AS distance, CAST(NULL AS DOUBLE) AS next_distance FROM br WHERE r IS NOT NULL
UNION ALL SELECT video_id, scene_index, ts_ms, g, NULL, NULL, NULL FROM cd WHERE g IS NOT NULL
UNION ALL SELECT video_id, scene_index, ts_ms, CASE WHEN ln < 2 OR rn < 2 THEN 'insufficient_window_samples' WHEN d < 0.53 THEN 'low_histogram_distance' WHEN nd >= 0.53 THEN 'right_profile_not_next_scene'
  WHEN conf < 0.6 THEN 'low_confidence' WHEN pn >= 2 AND pd >= 0.53 THEN 'unstable_post_right_window' END, conf, d, nd FROM cf)
"""
PALETTE_CANDIDATES = PALETTE + "SELECT video_id, scene_index, ts_ms, reason, round_even(confidence, 6) AS confidence, round_even(distance, 6) AS distance, round_even(next_distance, 6) AS next_distance FROM allc"


def boundary_shift(spark, sf_dir):
    """Scenes after moving the accepted boundaries."""
    samples = materialise(palette_samples(spark, sf_dir))
    scenes = _palette_scenes(samples)
    best = pal.best_adjustments(pal.boundary_candidates(samples, scenes, LOOSE))
    return pal.apply_adjustments(scenes, best)


BOUNDARY_SHIFT = PALETTE.rstrip() + """,
bs AS (SELECT video_id, scene_index, round_even(arg_max(ts_ms, confidence * 1e9 - ts_ms / 1e6) * 25 / 1000.0, 0)::BIGINT AS cut FROM allc WHERE reason IS NULL GROUP BY 1, 2)
SELECT s.video_id, s.scene_index, coalesce(p.cut, s.s // 40) AS start_frame, coalesce(n.cut, s.e // 40) AS end_frame, p.cut IS NOT NULL OR n.cut IS NOT NULL AS moved
FROM sc s LEFT JOIN bs n ON n.video_id = s.video_id AND n.scene_index = s.scene_index LEFT JOIN bs p ON p.video_id = s.video_id AND p.scene_index = s.scene_index - 1
WHERE coalesce(n.cut, s.e // 40) > coalesce(p.cut, s.s // 40)"""


def _planted_cuts(scenes):
    """Cuts after the first two scenes of each video: sound ones, outside their scenes, and such that cross each other."""
    v, i = F.col("video_id") % 4, F.col("scene_index")
    ts = (
        F.when(v == 0, F.col("end_ms") - 1000)
        .when(v == 1, F.col("start_ms"))
        .when(v == 2, F.when(i == 0, F.col("end_ms") + 5000).otherwise(F.col("start_ms") + 4000))
        .otherwise(F.col("end_ms") + 10**6)
    )
    return scenes.where(i < 2).select("video_id", "scene_index", ts.cast("long").alias("ts_ms"))


def boundary_refinement(spark, sf_dir):
    """Scenes after planted cuts, renumbered, with a row for each refusal."""
    scenes = materialise(_palette_scenes(materialise(palette_samples(spark, sf_dir))))
    kept, refused = pal.refine_boundaries(scenes, _planted_cuts(scenes))
    none = F.lit(None)
    gone = refused.select("video_id", none.cast("long").alias("position"), "scene_index", *[none.cast("long").alias(c) for c in ("start_frame", "end_frame")], none.cast("boolean").alias("moved"), "reason")
    return kept.withColumn("reason", none.cast("string")).unionByName(gone)


BOUNDARY_REFINEMENT = PALETTE.rstrip() + """,
f AS (SELECT video_id, scene_index, s, e, s // 40 AS a, e // 40 AS b FROM sc),
t AS (SELECT *, round_even(CASE video_id % 4 WHEN 0 THEN e - 1000 WHEN 1 THEN s WHEN 2 THEN CASE WHEN scene_index = 0 THEN e + 5000 ELSE s + 4000 END ELSE e + 1000000 END * 25 / 1000.0, 0)::BIGINT AS cut FROM f WHERE scene_index < 2),
k AS (SELECT t.video_id, t.scene_index, t.cut, coalesce(t.cut > t.a AND t.cut < n.b, false) AS ok FROM t LEFT JOIN f n ON n.video_id = t.video_id AND n.scene_index = t.scene_index + 1),
m AS (SELECT f.video_id, f.scene_index, coalesce(p.cut, f.a) AS start_frame, coalesce(n.cut, f.b) AS end_frame, p.cut IS NOT NULL OR n.cut IS NOT NULL AS moved FROM f
  LEFT JOIN k n ON n.video_id = f.video_id AND n.scene_index = f.scene_index AND n.ok LEFT JOIN k p ON p.video_id = f.video_id AND p.scene_index = f.scene_index - 1 AND p.ok)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start_frame, end_frame, scene_index) - 1 AS position, scene_index, start_frame, end_frame, moved, CAST(NULL AS VARCHAR) AS reason FROM m WHERE end_frame > start_frame
UNION ALL SELECT video_id, NULL, scene_index, NULL, NULL, NULL, 'invalid_final_boundary' FROM m WHERE end_frame <= start_frame
UNION ALL SELECT video_id, NULL, scene_index, NULL, NULL, NULL, 'invalid_adjusted_boundary' FROM k WHERE NOT ok"""


def shift_rejections(spark, sf_dir):
    samples = materialise(palette_samples(spark, sf_dir))
    return pal.rejection_histogram(pal.boundary_candidates(samples, _palette_scenes(samples), LOOSE))


SHIFT_REJECTIONS = PALETTE + "SELECT reason, count(*) AS candidates FROM allc WHERE reason IS NOT NULL GROUP BY 1"


QUERIES = {
    "scene_tiles": (fallback_scenes, SCENE_TILES),
    "scene_violations": (scene_violations, SCENE_VIOLATIONS),
    "scene_statistics": (scene_statistics, SCENE_STATISTICS),
    "scene_report": (scene_report, SCENE_REPORT),
    "scene_report_drift": (scene_report_drift, SCENE_REPORT_DRIFT),
    "frame_plan": (frame_plan, FRAME_PLAN),
    "probe_grid": (probe_grid, PROBE_GRID),
    "probe_selection": (probe_selection, PROBE_SELECTION),
    "quality_flags": (quality_flags, QUALITY_FLAGS),
    "quality_drop": (quality_drop, QUALITY_DROP),
    "hamming_pairs": (hamming_pairs, HAMMING_PAIRS),
    "near_duplicate_frames": (near_duplicates, NEAR_DUPLICATES),
    "frame_outcomes": (frame_outcomes, FRAME_OUTCOMES),
    "extraction_report": (extraction_report, EXTRACTION_REPORT),
    "bootstrap_sample": (bootstrap_sample, BOOTSTRAP_SAMPLE),
    "palette_candidates": (palette_candidates, PALETTE_CANDIDATES),
    "boundary_shift": (boundary_shift, BOUNDARY_SHIFT),
    "boundary_refinement": (boundary_refinement, BOUNDARY_REFINEMENT),
    "boundary_shift_rejections": (shift_rejections, SHIFT_REJECTIONS),
}
