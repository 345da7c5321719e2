"""Live interview turns into the chunk store.

Questions and answers arrive as rows of their own, in any order and in different micro-batches; stream state pairs them.
Micro-batches append to a change log (one directory per batch, replaced whole when a batch is replayed), so
no batch rewrites the store; readers keep the greatest version per key. `compact` embeds the newest rows of the log,
merges them into the store in append mode and removes the folders it has merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from profilelab.operators.chunks import transcript_chunks
from profilelab.operators.store import embed, hashed_embedding, last_per_key, merge_store
from profilelab.sources.sinks import PARTS

KEYS = ["user_id", "chunk_id"]
_STATE = "question string, asked long, answer string, answered long, score double"


def pair_stream(rows: DataFrame, keep_minutes: int | None = None) -> DataFrame:
    """rows(user_id, turn, role, text, evaluation_score, at) -> (user_id, turn_number, question, answer, evaluation_score, answered_at).

    The answer to turn n of role 'user' is turn n + 1 of role 'assistant'. The state of a pair holds the newest question and the
    newest answer (equal times: the greater text); whenever both are known and one of them is new the pair is sent again,
    with the later of the two times as version. Nothing is sent for an older or repeated row, a lone question or a lone answer. `keep_minutes` forgets
    a pair that has seen no row for so long; without it pairs stay, so that any later score finds its question. Rows without text, turn or time are left out.
    """
    asked = F.col("role") == "user"
    halves = (rows.where("role in ('user', 'assistant') and text is not null and turn is not null and at is not null")
              .select(F.col("user_id").cast("string").alias("user_id"), F.when(asked, F.col("turn")).otherwise(F.col("turn") - 1).cast("long").alias("turn_number"),
                      asked.alias("asked"), "text", F.unix_micros("at").alias("at"), F.col("evaluation_score").cast("double").alias("score")))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        question, asked_at, answer, answered_at, score = state.get if state.exists else (None, None, None, None, None)
        news = False
        for frame in frames:
            for is_question, text, at, points in zip(frame["asked"], frame["text"], frame["at"], frame["score"]):
                if is_question:
                    if question is None or (at, text) > (asked_at, question):
                        question, asked_at, news = text, int(at), True
                elif answer is None or (at, text) > (answered_at, answer):
                    answer, answered_at, news = text, int(at), True
                    score = None if pd.isna(points) else float(points)
        state.update((question, asked_at, answer, answered_at, score))
        if keep_minutes is not None:
            state.setTimeoutDuration(keep_minutes * 60_000)
        if news and question is not None and answer is not None:
            yield pd.DataFrame({"user_id": [key[0]], "turn_number": [key[1]], "question": [question], "answer": [answer],
                                "evaluation_score": pd.Series([score], dtype="float64"), "at": [max(asked_at, answered_at)]})

    timeout = GroupStateTimeout.NoTimeout if keep_minutes is None else GroupStateTimeout.ProcessingTimeTimeout
    pairs = halves.groupBy("user_id", "turn_number").applyInPandasWithState(
        step, "user_id string, turn_number long, question string, answer string, evaluation_score double, at long", _STATE, "update", timeout)
    return pairs.select("user_id", "turn_number", "question", "answer", F.when(~F.isnan("evaluation_score"), F.col("evaluation_score")).alias("evaluation_score"),
                        F.timestamp_micros("at").alias("answered_at"))


def turn_chunks(turns: DataFrame, version: str = "answered_at") -> DataFrame:
    """turns(user_id, turn_number, question, answer, …, version) -> chunk rows with `version`, one per key."""
    cols = ["user_id", "turn_number", "question", "answer",
            *[c for c in ("question_topic", "evaluation_score") if c in turns.columns]]
    newest = last_per_key(turns.select(*cols, F.col(version).alias("version")), ["user_id", "turn_number"], F.struct(
        "version", "answer"))
    chunk_id = F.concat(F.col("user_id").cast("string"), F.lit("-turn-"), F.col("turn_number").cast("string"))
    stamps = newest.select("user_id", chunk_id.alias("chunk_id"), "version")
    return transcript_chunks(newest).join(stamps, KEYS)


def stream_transcripts(stream: DataFrame, log_dir: str, checkpoint: str, version: str = "answered_at"):
    """Start the keyed last-write-wins stream of pairs; returns a DataStreamWriter ready for trigger() and start()."""

    def write(batch: DataFrame, batch_id: int) -> None:
        turn_chunks(batch, version).write.mode("overwrite").parquet(f"{log_dir}/batch={batch_id}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def log_batches(spark: SparkSession, log_dir: str) -> list[str]:
    """Complete batch folders of the log."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{log_dir}/batch=*/_SUCCESS")
    found = done.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def read_log(spark: SparkSession, log_dir: str, batches: list[str] | None = None) -> DataFrame | None:
    """Newest version per (user, chunk) over the log, None when it is empty."""
    batches = log_batches(spark, log_dir) if batches is None else batches
    if not batches:
        return None
    return last_per_key(spark.read.option("basePath", log_dir).parquet(*batches), KEYS, F.struct("version", "batch")).drop("batch")


def read_transcripts(spark: SparkSession, log_dir: str, store: DataFrame | None = None) -> DataFrame | None:
    """Current transcript chunks: newest version per (user, chunk) over the store's transcripts, if given, and the log."""
    log = read_log(spark, log_dir)
    if store is None:
        return log
    kept = store.where("source_type = 'transcript' and deleted_at is null")
    if log is None:
        return kept
    shared = [c for c in log.columns if c in kept.columns]
    return last_per_key(kept.select(*shared).unionByName(log.select(*shared)), KEYS, F.col("version"))


def compact(spark: SparkSession, log_dir: str, store_path: str, schema: StructType, as_of: str, embedder=hashed_embedding, parts: int = PARTS) -> int:
    """Merge the log into the store and remove the merged folders; returns their number.

    `schema` is the store's, with a `version` column; a row that is older than the stored one changes nothing, so a
    compaction that was broken off is simply run again. Batches that arrive meanwhile stay in the log.
    """
    batches = log_batches(spark, log_dir)
    if not batches:
        return 0
    rows = embed(read_log(spark, log_dir, batches), embedder)
    merge_store(store_path, schema, rows.select(*[c for c in schema.names if c in rows.columns]), as_of, mode="append", newer="version", parts=parts)
    for folder in batches:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(batches)
