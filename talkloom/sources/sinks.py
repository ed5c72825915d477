"""Sinks: JSON lines, the export bundle with its manifest, and notes written only when changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.operators.hashtree import fingerprint
from talkloom.session import materialise

PARTS = 64
SPREAD = 8


def write_lines(df: DataFrame, path: str, key: str = "video_id") -> None:
    """JSON lines with sorted keys; only the lines of the videos present in ``df`` are replaced, atomically per commit.

    Videos are dealt to ``PARTS`` folders by hash, each of at most ``SPREAD`` files, so the number of files does not grow
    with that of videos and a video with very many lines is written by several tasks. Lines of other videos that lie in
    the same folders are carried over as they are."""
    spark = df.sparkSession
    lines = df.select(
        F.col(key).cast("string").alias(key), F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")
    ).withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        lines = materialise(lines)
        stored = spark.read.schema("value string, part int").text(path).join(lines.select("part").distinct(), "part", "left_semi")
        stored = stored.select(F.from_json("value", F.lit(f"`{key}` string"))[key].alias(key), "value", "part")
        replaced = lines.select(F.col(key).alias("__key")).distinct()
        lines = lines.unionByName(stored.join(replaced, F.col(key).eqNullSafe(F.col("__key")), "left_anti"))
    dealt = lines.repartition("part", F.pmod(F.xxhash64("value"), F.lit(SPREAD))).sortWithinPartitions("part", key)
    dealt.select("value", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").text(path)


def bundle_tables(visual_enabled: bool) -> list[str]:
    return [t for t in fx.EXPORT_TABLES if visual_enabled or t not in fx.VISUAL_EXPORT_TABLES]


def write_bundle(tables: dict[str, DataFrame], folder: str, visual_enabled: bool) -> list[str]:
    """Write every table of the bundle; the list of written folders comes back."""
    written = []
    for name in bundle_tables(visual_enabled):
        if name in tables:
            write_lines(tables[name], f"{folder}/{name}")
            written.append(f"{folder}/{name}")
    return written


def manifest(claims: DataFrame, visual_enabled: bool, pos: str = "claim_pos") -> DataFrame:
    """Manifest rows per video and file: role, whether it is imported, and for the claims their fingerprint and count."""
    row = F.to_json(F.struct(*sorted(c for c in claims.columns if c != "video_id")), {"ignoreNullFields": "false"})
    prints = fingerprint(claims, ["video_id"], pos, row)
    entries = F.array(
        *[
            F.struct(
                F.lit(f"{name}.jsonl").alias("filename"),
                F.lit("knowledge" if name in fx.KNOWLEDGE_EXPORT_TABLES else "audit").alias("role"),
                F.lit(name in fx.KNOWLEDGE_EXPORT_TABLES).alias("kb_import"),
            )
            for name in bundle_tables(visual_enabled)
        ]
    )
    files = prints.select("video_id", "fingerprint", "rows", F.explode(entries).alias("e")).select("video_id", "fingerprint", "rows", "e.*")
    is_claims = F.col("filename") == "style_claims.jsonl"
    return files.select(
        "video_id", "filename", "role", "kb_import", F.lit(visual_enabled).alias("visual_enabled"),
        F.when(is_claims, F.col("fingerprint")).alias("claims_sha256"),
        F.when(is_claims, F.col("rows")).alias("claims_count"),
    )


def manifest_problems(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """Files a stored manifest lacks or should not list, and claim metadata that no longer holds."""
    key = ["video_id", "filename"]
    missing = expected.join(stored, key, "left_anti").select(*key, F.lit("missing").alias("problem"))
    extra = stored.join(expected, key, "left_anti").select(*key, F.lit("unexpected").alias("problem"))
    now = expected.select(*key, F.col("claims_sha256").alias("sha"), F.col("claims_count").alias("n"))
    drift = stored.join(now, key).where(~(F.col("claims_sha256").eqNullSafe(F.col("sha")) & F.col("claims_count").eqNullSafe(F.col("n"))))
    return missing.unionByName(extra).unionByName(drift.select(*key, F.lit("claims_changed").alias("problem")))


def changed_notes(notes: DataFrame, stored: DataFrame) -> DataFrame:
    """Notes whose content differs from the stored one (by digest), or that are new."""
    digest = F.sha2("body", 256)
    there = stored.select("path", digest.alias("digest"))
    return notes.withColumn("digest", digest).join(there, ["path", "digest"], "left_anti").drop("digest")


def write_notes(notes: DataFrame, folder: str) -> None:
    """One row per note, kept with its path; rows are not gathered anywhere."""
    notes.select("path", "body").write.mode("overwrite").json(folder)
