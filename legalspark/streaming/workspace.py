"""The last write of each key as streaming state, with deletions that stay."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

#: What is kept of a key: when it was written, in microseconds, the number of the write, whether it is a deletion, and its record.
_STATE = "ts long, seq long, deleted boolean, record string"
#: The store that keyed state of this kind needs.
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class LastWrite(StatefulProcessor):
    """Of a key, the write with the largest (ts, seq); of equal ones the later to come. What is older than the state says
    nothing, so a late write does not undo a deletion."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:  # a hot key comes in many frames, of which one row is held
            top = pdf.sort_values(["ts", "seq"], kind="stable").iloc[-1]
            if best is None or (top["ts"], top["seq"]) >= (best["ts"], best["seq"]):
                best = top
        known = self.last.get()
        if best is not None and (known is None or (best["ts"], best["seq"]) >= (known[0], known[1])):
            row = (int(best["ts"]), int(best["seq"]), bool(best["deleted"]), best["record"])
            self.last.update(row)
            yield pd.DataFrame([(key[0], *row)], columns=["id", "ts", "seq", "deleted", "record"])

    def close(self) -> None:
        pass


def stream_writes(writes: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the last write of each id of a stream (id, ts, seq, deleted, other columns) as state, and append what changes to a parquet
    table, one folder per batch. A batch that is repeated overwrites itself; the state is in the checkpoint, so that a
    restart goes on where the stream ended. Rows without id or ts are no writes; no seq counts as 0, no deleted as false."""
    spark = writes.sparkSession
    rest = [c for c in writes.columns if c not in ("id", "ts", "seq", "deleted")]
    record = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    rows = writes.where("id is not null and ts is not null").select("id", F.unix_micros("ts").alias("ts"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("deleted", F.lit(False)).alias("deleted"), record.alias("record"))
    kind = writes.schema["id"].dataType.simpleString()
    last = rows.groupBy("id").transformWithStateInPandas(LastWrite(), f"id {kind}, {_STATE}", "Update", "None")

    def save(batch: DataFrame, version: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={version}")

    before = spark.conf.get(_STORE[0], None)
    spark.conf.set(*_STORE)
    try:
        return last.writeStream.foreachBatch(save).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE[0], before) if before else spark.conf.unset(_STORE[0])


def read_writes(spark: SparkSession, table: str, schema: StructType | str) -> DataFrame:
    """id, ts, seq and the record's columns (schema) of the ids whose last write is no deletion."""
    rows = spark.read.parquet(table)
    last = rows.groupBy("id").agg(F.max_by(F.struct("ts", "seq", "deleted", "record"), F.struct("ts", "seq", "batch")).alias("r")).select("id", "r.*")
    return last.where("not deleted").select("id", F.timestamp_micros("ts").alias("ts"), "seq", F.from_json("record", schema).alias("r")).select("id", "ts", "seq", "r.*")


def last_writes(writes: DataFrame) -> DataFrame:
    """The same of a whole table of writes, as a batch."""
    rest = [c for c in writes.columns if c not in ("id", "ts")]
    order = F.struct("ts", F.coalesce("seq", F.lit(0)).alias("seq"))
    last = writes.where("id is not null and ts is not null").groupBy("id").agg(F.max_by(F.struct("ts", *rest), order).alias("r")).select("id", "r.*")
    return last.where(~F.coalesce("deleted", F.lit(False))).drop("deleted").withColumn("seq", F.coalesce("seq", F.lit(0)))
