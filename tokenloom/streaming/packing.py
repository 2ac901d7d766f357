"""Streaming packing: windows fill across micro-batches, the unfilled ones flush at the end.

A micro-batch is packed with the rows left over from the one before, so the samples are those of
one batch run over the rows in arrival order. What is carried is less than one window per shard.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.operators.chunk import split_units
from tokenloom.operators.encode import Encoder, append_end
from tokenloom.operators.guards import drop_blank
from tokenloom.operators.indexing import join_on
from tokenloom.operators.packing import ROW, assign_windows, first_units, pack_units
from tokenloom.staging import remove, stage


@dataclass
class StreamPacker:
    """Packs a stream of text rows into padded samples under ``output``.

    Every micro-batch writes folders named by its number, samples and carry-over alike, and reads
    only those of its predecessor. Repeating a batch after a failure rewrites the same folders.
    """

    spark: SparkSession
    encoder: Encoder
    output: str
    state: str
    seq_len: int
    window_units: int
    capacity: int
    eos_id: int
    pad_id: int
    shard: str
    key: str
    min_len: int = 2
    text_column: str = "text"
    chunk_rows: int | None = None

    def run(self, rows: DataFrame, checkpoint: str) -> DataFrame:
        """Drain ``rows`` (a streaming DataFrame), flush, and return all samples."""
        last = -1

        def pack(batch: DataFrame, number: int) -> None:
            nonlocal last
            self.pack_batch(batch, number)
            last = number

        query = (
            rows.writeStream.foreachBatch(pack)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return self.flush(last)

    def pack_batch(self, batch: DataFrame, number: int) -> None:
        encoded = self.encoder.encode(drop_blank(batch, self.text_column), self.text_column)
        arrival = F.lit(number).cast("long").alias("arrival")
        fresh = append_end(encoded, self.eos_id).select(
            arrival, self.shard, self.key, "ids",
            F.struct(arrival, F.monotonically_increasing_id().alias("n")).alias(ROW))
        # Stored once: rows keep their numbers and are not encoded again for the units and what is left.
        rows = fresh = stage(fresh, "stream-rows")
        if number > 0:
            rows = self._read(f"{self.state}/rows/{number - 1}", fresh.schema).unionByName(fresh)
        self._pack(rows, number, closing=False)
        if number > 1:  # a repeat of this batch reads what its predecessor left, nothing older
            for kind in ("rows", "windows"):
                remove(self.spark, f"{self.state}/{kind}/{number - 2}")

    def flush(self, last: int) -> DataFrame:
        """Pack what the last micro-batch left over; returns all samples."""
        if last < 0:
            raise ValueError("the stream brought no new rows")
        left = self.spark.read.parquet(f"{self.state}/rows/{last}")
        self._pack(left, last + 1, closing=True)
        return self.spark.read.parquet(self.output).drop("batch")

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def _pack(self, rows: DataFrame, number: int, closing: bool) -> None:
        columns = ["arrival", self.shard, self.key, ROW]
        rows = rows.withColumn("at", F.struct("arrival", self.key, ROW))
        units = stage(split_units(rows, self.seq_len, self.min_len), "stream-units")
        windows = stage(
            assign_windows(first_units(units, [*columns, "at"]), window_units=self.window_units,
                           shard=self.shard, order=["at"], chunk_rows=self.chunk_rows),
            "stream-windows",
        )
        filled = windows.groupBy(self.shard, "window_id").agg(
            (F.sum("n_units") >= self.window_units).alias("closed"))
        marked = join_on(windows, filled, [self.shard, "window_id"])
        ready = marked if closing else marked.where("closed")
        done = self._windows_before(number, filled)
        numbered = (
            join_on(ready, done, [self.shard], "left")
            .withColumn("window_id", F.col("window_id") + F.coalesce("before", F.lit(0)))
        )
        samples = pack_units(units, numbered, capacity=self.capacity, min_len=self.min_len,
                             pad_id=self.pad_id, shard=self.shard, key=ROW, order="at")
        samples.write.mode("overwrite").parquet(f"{self.output}/batch={number}")
        if closing:
            return
        waiting = marked.where(~F.col("closed")).select(ROW)
        rows.drop("at").join(waiting, ROW, "left_semi") \
            .write.mode("overwrite").parquet(f"{self.state}/rows/{number}")
        closed_now = filled.where("closed").groupBy(self.shard).agg(F.count("*").alias("before"))
        done.select(self.shard, "before").unionByName(closed_now).groupBy(self.shard) \
            .agg(F.sum("before").alias("before")) \
            .write.mode("overwrite").parquet(f"{self.state}/windows/{number}")

    def _windows_before(self, number: int, filled: DataFrame) -> DataFrame:
        """Windows each shard had closed before this batch."""
        kind = filled.schema[self.shard].dataType.simpleString()
        schema = f"`{self.shard}` {kind}, before long"
        if number == 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.state}/windows/{number - 1}")
