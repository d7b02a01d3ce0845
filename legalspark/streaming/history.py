"""Sessions: history, merging, latest states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_history(turns: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Append the turns of a stream to a parquet table, one folder per batch: rows are never rewritten, and a batch that is
    repeated overwrites itself. Arrays are built only when a history is read."""

    def save(batch: DataFrame, version: int) -> None:
        batch.select("session_id", "question", "answer", "ts", "duration").write.mode("overwrite").parquet(f"{table}/batch={version}")

    return turns.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_turns(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).drop("batch")


def history(turns: DataFrame) -> DataFrame:
    """session_id, history: the session's turns (ts, question, answer, duration) in order of time."""
    turn = F.struct("ts", "question", "answer", "duration")
    return turns.groupBy("session_id").agg(F.sort_array(F.collect_list(turn)).alias("history"))


def read_session(turns: DataFrame, session_id: str) -> DataFrame:
    """One session; the filter reaches the scan before anything is grouped."""
    return history(turns.where(F.col("session_id") == session_id))


def delete_session(turns: DataFrame, session_id: str) -> DataFrame:
    return turns.where(~F.col("session_id").eqNullSafe(session_id))


def merge_sessions(a: DataFrame, b: DataFrame) -> DataFrame:
    """The latest record of each id over both lists (equal times: the later list wins), newest first; null ids go."""
    rows = a.withColumn("_l", F.lit(0)).unionByName(b.withColumn("_l", F.lit(1)), allowMissingColumns=True).where("id is not null")
    w = Window.partitionBy("id").orderBy(F.col("createdAt").desc_nulls_last(), F.desc("_l"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_l").orderBy(F.col("createdAt").desc_nulls_last(), "id")


def put_session(sessions: DataFrame, new: DataFrame) -> DataFrame:
    """Add or replace by id."""
    return sessions.join(new.select("id"), "id", "left_anti").unionByName(new, allowMissingColumns=True)


def remove_session(sessions: DataFrame, session_id: str) -> DataFrame:
    return sessions.where(~F.col("id").eqNullSafe(session_id))


def latest_workspace(updates: DataFrame, lists: tuple[str, ...] = ("cases", "documents")) -> DataFrame:
    """The last write of each user (ts, then seq if there is one); missing lists are empty."""
    order = F.struct("ts", "seq") if "seq" in updates.columns else F.col("ts")
    rest = [c for c in updates.columns if c != "user_id"]
    last = updates.groupBy("user_id").agg(F.max_by(F.struct(*rest), order).alias("r")).select("user_id", "r.*")
    return last.withColumns({c: F.coalesce(c, F.array().cast(last.schema[c].dataType)) for c in lists if c in rest})
