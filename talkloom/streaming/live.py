"""The event log and the edit log as streams.

Every query writes to tables through foreachBatch or a file sink, keyed by batch number, so a batch that is
replayed after a failure replaces its own rows. Results are read back as the latest row per key."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talkloom import fixed_values as fx
from talkloom.operators.audit import stage_state
from talkloom.operators.overlay import fold_edits
from talkloom.session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: str, max_files: int = 100) -> DataFrame:
    """New parquet files of a folder, as they arrive; a folder of part files under that very name is read as the table it is."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    if any(entry.isDirectory() for entry in found or []):
        return reader.parquet(f"{folder}/{pattern}")
    return reader.option("pathGlobFilter", pattern).parquet(folder)


def _folders(spark: SparkSession) -> tuple[str, str]:
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    return f"{base}/state", f"{base}/rows"


def drain(stream: DataFrame, mode: str, state: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all that has arrived, from where its checkpoint stands, then stop it."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def _batch_rows(spark: SparkSession, rows: str, schema) -> DataFrame:
    return spark.read.schema(schema.add("batch", "long")).option("basePath", rows).parquet(rows)


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Drain a stream into a table with one folder per batch, and read the table back with its batch number.

    In complete mode only the last batch counts, as each one holds the whole result."""
    state, rows = _folders(stream.sparkSession)
    drain(stream, mode, state, lambda batch, number: batch.write.mode("overwrite").parquet(f"{rows}/batch={number}"))
    table = _batch_rows(stream.sparkSession, rows, stream.schema)
    if mode != "complete":
        return table
    return table.where(F.col("batch") == table.agg(F.max("batch")).scalar()).drop("batch")


def latest_rows(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the last batch per key: what an update-mode stream stands at."""
    fields = [c for c in table.columns if c not in (*keys, "batch")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("r")).select(*keys, "r.*")


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Monitored events counted per tumbling window and event."""
    counted = (
        events.where(F.col("event").isin(fx.MONITORED_EVENTS))
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width).alias("w"), "event")
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), "event", "n")
    )
    return latest_rows(run_to_table(counted, "update"), ["window_start", "event"])


class SeenIndex:
    """Which keys have been let through, and by which batch, as a stored table dealt to parts by the hash of the key.

    A batch looks up its own parts alone and appends what is new to them. Its entries bear its number: a batch that is
    run again meets only those of the batches before it, so it lets the same rows through and replaces its own entries."""

    def __init__(self, spark: SparkSession, folder: str, key: str, kind: str, parts: int = 64) -> None:
        self.spark, self.folder, self.key, self.kind, self.parts = spark, folder, key, kind, parts

    def entries(self) -> DataFrame:
        schema = f"`{self.key}` {self.kind}, part int, batch long"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.folder)

    def fresh(self, batch: DataFrame, number: int) -> DataFrame:
        """The rows of a batch whose key no earlier batch has let through, one of each key."""
        dealt = batch.dropDuplicates([self.key]).withColumn("part", F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int"))
        known = self.entries().where(F.col("batch") < number).drop("batch")
        same = dealt[self.key].eqNullSafe(known[self.key]) & (dealt["part"] == known["part"])
        return dealt.join(known, same, "left_anti")

    def add(self, rows: DataFrame, number: int) -> None:
        """Enter the keys of a batch that were let through (rows from ``fresh``)."""
        keys = rows.select(self.key, "part", F.lit(number).cast("long").alias("batch"))
        keys.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(self.folder)


def unique_events(events: DataFrame, key: str = "event_id", parts: int = 64) -> DataFrame:
    """Log rows exactly once, by event identifier, however far apart their copies arrive: the first batch to bring one wins."""
    spark = events.sparkSession
    state, rows = _folders(spark)
    index = SeenIndex(spark, f"{rows}-seen", key, events.schema[key].dataType.simpleString(), parts)

    def write(batch: DataFrame, number: int) -> None:
        target = f"{rows}/batch={number}"
        index.fresh(batch, number).write.mode("overwrite").parquet(target)
        index.add(spark.read.parquet(target), number)

    drain(events, "append", state, write)
    return _batch_rows(spark, rows, events.schema).drop("batch")


def run_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a job's activity, parted by idle time."""
    sessions = (
        events.withWatermark("ts", late)
        .groupBy(F.session_window("ts", gap).alias("w"), "job_id")
        .agg(F.count("*").alias("n"))
        .select("job_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
    )
    return run_to_table(sessions, "complete")


def live_stage_state(events: DataFrame) -> DataFrame:
    """Stage state kept up to date from the log; equal to the batch fold over the same rows."""
    return latest_rows(run_to_table(stage_state(events), "update"), ["job_id", "stage"])


class LiveOverlay:
    """The effective claims of all jobs, kept up to date from a stream of edits.

    A batch stores its edits, then folds again all edits up to it of the jobs that it touches, and of no others. Both are
    written under the batch's number, and a job's claims are those of the last batch that touched it; so a batch that is
    run again replaces its own rows, leaves later ones alone, and changes nothing. Jobs without edits keep their claims."""

    def __init__(self, claims: DataFrame, edit_schema, folder: str) -> None:
        self.spark, self.claims, self.folder = claims.sparkSession, claims, folder
        self.edit_schema = edit_schema
        fold = fold_edits(claims.limit(0), self.spark.createDataFrame([], edit_schema))
        self.claim_schema = fold.schema

    def _table(self, name: str, schema) -> DataFrame:
        where = f"{self.folder}/{name}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema).withColumn("batch", F.lit(None).cast("long"))
        return self.spark.read.schema(schema).parquet(where).withColumn("batch", F.regexp_extract(F.input_file_name(), "/batch=([0-9]+)/", 1).cast("long"))

    def apply(self, batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.folder}/edits/batch={number}")
        edits = self._table("edits", self.edit_schema).where(F.col("batch") <= number)
        jobs = edits.where(F.col("batch") == number).select("job_id").distinct()
        jobs.write.mode("overwrite").parquet(f"{self.folder}/jobs/batch={number}")
        touched = self.spark.read.parquet(f"{self.folder}/jobs/batch={number}")
        folded = fold_edits(self.claims.join(touched, "job_id", "left_semi"), edits.drop("batch").join(touched, "job_id", "left_semi"))
        folded.write.mode("overwrite").parquet(f"{self.folder}/claims/batch={number}")

    def current(self, upto: int | None = None) -> DataFrame:
        """The effective claims as of a batch, or of the last one."""
        within = F.lit(True) if upto is None else F.col("batch") <= upto
        last = self._table("jobs", "job_id string").where(within).groupBy("job_id").agg(F.max("batch").alias("batch"))
        edited = self._table("claims", self.claim_schema).join(last, ["job_id", "batch"], "left_semi").drop("batch")
        untouched = self.claims.join(last, "job_id", "left_anti")
        return edited.unionByName(fold_edits(untouched, self.spark.createDataFrame([], self.edit_schema)))


def live_overlay(claims: DataFrame, edits: DataFrame) -> LiveOverlay:
    """The overlay after all edits of a stream that have arrived."""
    state, rows = _folders(claims.sparkSession)
    overlay = LiveOverlay(claims, edits.schema, rows)
    drain(edits, "append", state, overlay.apply)
    return overlay


class OverdueStarts:
    """Starts of a job's stage that no end follows in time, found batch by batch with one sort of what is still open.

    A batch is judged together with what the one before left waiting: starts whose time is not up, and ends that the
    clock has not passed, for starts that arrive after them. The clock is the highest event time less the lateness; rows
    behind it come too late and are left out. Once it has passed a start's time no end can come that counts, so a start
    without one is reported, once. Everything is written under the batch's number: a batch that is run again reads what
    the one before it left, and replaces its own rows."""

    def __init__(self, spark: SparkSession, schema, folder: str, within_us: int, late_us: int) -> None:
        self.spark, self.folder, self.within, self.late = spark, folder, within_us, late_us
        self.schema = schema

    def _left(self, number: int, due: bool) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch={number}/due={str(due).lower()}")

    def _waiting(self, number: int) -> DataFrame:
        """What the batch before left, with its clock."""
        return self._left(number - 1, False) if number else self.spark.createDataFrame([], self.schema)

    def apply(self, batch: DataFrame, number: int) -> None:
        before = self._waiting(number)
        clock = before.where("kind = 'clock'").agg(F.max("at")).first()[0]
        timed = batch.select(*self.schema.names).where("at IS NOT NULL")
        last = timed.agg(F.max("at") - self.late).first()[0]
        now = max([t for t in (clock, last) if t is not None], default=None)
        fresh = timed.where(F.col("kind").isin("start", "end"))
        fresh = fresh if clock is None else fresh.where(F.col("at") > clock)
        rows = before.where("kind <> 'clock'").unionByName(fresh)
        # a start delivered again is one start; of equal ends one is enough
        same = F.when(F.col("kind") == "start", F.col("event_id"))
        once = rows.groupBy("kind", "job_id", "stage", same.alias("event_id"), F.when(F.col("kind") == "end", F.col("at")).alias("end_at")).agg(F.max("at").alias("at"))
        later = Window.partitionBy("job_id", "stage").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        end = F.min(F.when(F.col("kind") == "end", F.col("at"))).over(later)
        judged = once.withColumn("end_at", end)
        waits = (F.col("kind") == "start") & F.coalesce(F.col("end_at") > F.col("at") + self.within, F.lit(True))
        passed = F.lit(False) if now is None else F.col("at") + self.within < now
        keeps = waits if now is None else waits | ((F.col("kind") == "end") & (F.col("at") >= now))
        left = judged.where(keeps).select(*self.schema.names, ((F.col("kind") == "start") & passed).alias("due"))
        ticks = self.spark.range(1).select(F.lit("clock").alias("kind"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields[1:-1]], F.lit(now).cast("long").alias("at"), F.lit(False).alias("due"))
        nothing = ticks.withColumn("kind", F.lit("none")).withColumn("due", F.lit(True))  # so that both folders are there
        left.unionByName(ticks).unionByName(nothing).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("due").parquet(f"{self.folder}/batch={number}")

    def reported(self) -> DataFrame:
        found = self.spark.read.schema(self.schema).parquet(f"{self.folder}/batch=*/due=true")
        return found.where("kind = 'start'").select("event_id", "job_id", "stage", F.col("at").alias("started_us"))


def unfinished_stages(lifecycle: DataFrame, within_us: int, closing: Sequence[DataFrame] = (), late: str = "10 minutes") -> DataFrame:
    """Stage starts without an end within a time, each reported once: event_id, job_id, stage, started_us.

    ``lifecycle`` has kind (start, end, or anything else for rows that only tell the time), event_id, job_id, stage and ts.
    A start is reported when the event time has passed its time and the lateness. A log that is closed is drained with
    ``closing`` rows that tell a later time, one table after the other; without them the last starts are still waited for."""
    spark = lifecycle.sparkSession
    state, rows = _folders(spark)
    ticks = f"{rows}-ticks"
    columns = ["kind", "event_id", "job_id", "stage", "ts"]
    schema = lifecycle.select(*columns).schema
    spark.createDataFrame([], schema).write.parquet(ticks)
    stream = lifecycle.select(*columns).unionByName(spark.readStream.schema(schema).parquet(ticks))
    timed = stream.withColumn("at", F.unix_micros("ts")).drop("ts")
    late_us = spark.sql(f"SELECT unix_micros(timestamp_micros(0) + INTERVAL {late})").first()[0]
    overdue = OverdueStarts(spark, timed.schema, rows, within_us, late_us)
    drain(timed, "append", state, overdue.apply)
    for table in closing:
        table.select(*columns).write.mode("append").parquet(ticks)
        drain(timed, "append", state, overdue.apply)
    return overdue.reported()
