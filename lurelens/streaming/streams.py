"""Structured Streaming jobs.

The scorers are stateless projections, so a stream runs the same code as a
batch: no watermark, no state store, no shuffle.  Sources are file streams
(new Parquet/JSON files in a folder); sinks are Parquet tables with a
checkpoint in the shared ``spark.checkpoint.dir`` so a restarted query (or a
lost executor) resumes without duplicates.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring as sc
from ..session import scratch_path


def table_folder(folder: str, table: str) -> str:
    """The place of a Parquet table, one file or a folder of part files, for
    ``file_stream``.  A file source takes a folder as base of partition columns
    and refuses a file there, and ``pathGlobFilter`` looks at the names of files
    alone; a pattern that only this name fits serves both."""
    return f"{folder.rstrip('/')}/{{{table}.parquet}}"


def file_stream(spark: SparkSession, folder: str, schema, fmt: str = "parquet", glob: str | None = None,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the rows of new files in ``folder``."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(folder)


def score_url_stream(stream: DataFrame, url_col: str = "url") -> DataFrame:
    """R17 on a stream (same projection as batch)."""
    return sc.score_urls(stream, url_col)


def score_email_stream(stream: DataFrame, **names) -> DataFrame:
    """M17 on a stream; the URL analyses are arrays in the email row, so
    there is no streaming aggregation or join."""
    return sc.score_emails_with_urls(stream, **names)


def to_parquet(df: DataFrame, path: str, checkpoint: str, available_now: bool = True,
               processing_time: str | None = None) -> StreamingQuery:
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()


def _stream_id(checkpoint: str) -> str:
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def _content(rows: DataFrame) -> DataFrame:
    """n_rows, digest of a table, whatever the order of its rows and columns."""
    row = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(rows.columns)])
    return rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def write_attempt(batch: DataFrame, batch_id: int, history_path: str, stream_id: str) -> str:
    """Writes a batch to a folder of its own and returns the attempt's name; no
    reader sees it yet."""
    attempt = uuid.uuid4().hex
    batch.withColumn("scanned_at", F.current_timestamp()).write.parquet(
        f"{history_path.rstrip('/')}/data/stream_id={stream_id}/batch_id={batch_id}/attempt={attempt}")
    return attempt


def commit_attempt(spark: SparkSession, batch_id: int, history_path: str, stream_id: str, attempt: str) -> None:
    """The commit record (stream, batch, attempt, rows, digest) of a written
    batch: one row, in a folder that can be written once."""
    root = history_path.rstrip("/")
    written = spark.read.parquet(f"{root}/data/stream_id={stream_id}/batch_id={batch_id}/attempt={attempt}")
    record = _content(written).select(F.lit(stream_id).alias("stream_id"), F.lit(batch_id).cast("long").alias("batch_id"),
                                      F.lit(attempt).alias("attempt"), "n_rows", "digest")
    record.coalesce(1).write.mode("errorifexists").parquet(f"{root}/commits/{stream_id}-{batch_id}")


def commits(spark: SparkSession, history_path: str) -> DataFrame:
    """The commit records of a history."""
    schema = "stream_id string, batch_id long, attempt string, n_rows long, digest string"
    path = f"{history_path.rstrip('/')}/commits"
    try:
        return spark.read.schema(schema).parquet(f"{path}/*")
    except AnalysisException:                                     # nothing is committed yet
        return spark.createDataFrame([], schema)


def append_history(df: DataFrame, history_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append scored rows to a history table.

    A micro-batch is written to a folder of its own and becomes visible by a
    commit record of (stream, batch, attempt, rows, digest); readers take
    committed attempts only.  A batch that fails before its commit leaves a
    folder that nobody reads, and its replay writes another; a batch that fails
    after it is known to be committed and is not written again.  The stream id is
    a digest of the checkpoint's place, so it stays with the checkpoint and
    several streams share a history.  All rows of a batch are kept."""
    stream_id = _stream_id(checkpoint)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if commits(spark, history_path).filter((F.col("stream_id") == stream_id) & (F.col("batch_id") == batch_id)).limit(1).count():
            return
        commit_attempt(spark, batch_id, history_path, stream_id, write_attempt(batch, batch_id, history_path, stream_id))

    w = df.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_to_table(spark: SparkSession, stream: DataFrame, name: str,
                 transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs ``stream`` (optionally transformed) once over everything
    available into a fresh Parquet folder under the checkpoint dir and
    returns the written table."""
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    q = to_parquet(transform(stream) if transform else stream, out, ckpt)
    q.awaitTermination()
    return spark.read.parquet(out)


def history(spark: SparkSession, history_path: str) -> DataFrame:
    """The committed rows of a history, with stream_id and batch_id."""
    root = history_path.rstrip("/")
    done = commits(spark, history_path).select("stream_id", "batch_id", "attempt")
    rows = spark.read.option("basePath", f"{root}/data").parquet(f"{root}/data")
    rows = rows.withColumns({"stream_id": F.col("stream_id").cast("string"), "batch_id": F.col("batch_id").cast("long"), "attempt": F.col("attempt").cast("string")})
    return rows.join(done, ["stream_id", "batch_id", "attempt"], "left_semi").drop("attempt")


def damaged_batches(spark: SparkSession, history_path: str) -> DataFrame:
    """Commit records whose files no longer hold the rows that were committed."""
    root = history_path.rstrip("/")
    out = []
    for r in commits(spark, history_path).collect():              # one row a batch
        now = _content(spark.read.parquet(f"{root}/data/stream_id={r['stream_id']}/batch_id={r['batch_id']}/attempt={r['attempt']}")).first()
        if (now["n_rows"], now["digest"]) != (r["n_rows"], r["digest"]):
            out.append(tuple(r))
    return spark.createDataFrame(out, commits(spark, history_path).schema)


def history_count(spark: SparkSession, history_path: str) -> DataFrame:
    """Rows in the scan history."""
    return history(spark, history_path).agg(F.count("*").cast("bigint").alias("n_scans"))
