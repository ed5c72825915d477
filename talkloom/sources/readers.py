"""Readers: JSON documents and JSON lines, strict or lenient, and the job and stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from talkloom.sources.schemas import TABLES


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one per file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema: a line that does not parse or fit is an error, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_lines(spark, path, TABLES[name])


def unknown_fields(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields in the lines that the schema does not know, with how many lines carry them (empty when sound)."""
    known = T.StructType.fromDDL(schema).fieldNames()
    keys = F.array_except(F.json_object_keys("value"), F.array(*[F.lit(k) for k in known]))
    return spark.read.text(path).where(F.trim("value") != "").select(F.explode(keys).alias("field")).groupBy("field").agg(F.count("*").alias("lines"))


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that parse as objects; a missing file is an empty table."""
    full = T.StructType.fromDDL(schema).add("_corrupt_record", T.StringType())
    try:
        rows = spark.read.text(path)
    except AnalysisException:
        return spark.createDataFrame([], T.StructType.fromDDL(schema))
    parsed = rows.select(F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"), "value")
    is_object = F.col("value").rlike(r"^\s*\{")
    return parsed.where(is_object & F.col("r._corrupt_record").isNull()).select("r.*").drop("_corrupt_record")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "jobs").orderBy("created_at", "job_id")


def read_stages(spark: SparkSession, path: str) -> DataFrame:
    """Stage rows with their JSON text columns decoded."""
    s = read_table(spark, path, "stages")
    return s.withColumns(
        {"input_files": F.from_json("input_files", "array<string>"), "output_files": F.from_json("output_files", "array<string>"), "metrics": F.from_json("metrics", "map<string,string>")}
    ).orderBy("job_id", "ordinal")
