"""Streaming packing with keyed state: a query that can be stopped anywhere and started again.

One streaming query encodes, cuts and packs. Per shard it keeps the units of the open window in list state and
the window's number and fill in value state, so a sample leaves as soon as its window closes, and the
checkpoint alone tells where to go on. The rows that wait are read from the checkpoint when the stream
is to be closed, as often as wanted. A shard's windows depend on all its earlier rows, so one task follows
a shard at a time; ``lanes`` splits shards into that many windows filled side by side.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tokenloom import kernels
from tokenloom.functions.arrays import positions
from tokenloom.operators.encode import Encoder, append_end
from tokenloom.operators.guards import drop_blank, min_unit
from tokenloom.operators.packing import pad_samples, unit_segments

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SAMPLES = "_lane string, window_id long, bin int, input_ids array<int>, _lens array<int>"


class WindowState(StatefulProcessor):
    """Fills windows of one lane; a window closes after the row that brings it to ``window_units``.

    With ``idle_ms`` a window also closes when its lane has brought no row for so long.
    """

    def __init__(self, seq_len: int, window_units: int, capacity: int, min_len: int, idle_ms: int | None):
        self.seq_len, self.window_units, self.capacity, self.low = seq_len, window_units, capacity, min_len
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "number long, units long")
        self.waiting = handle.getListState("waiting", "ids array<int>")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        lane = key[0]
        number, filled = self.window.get() if self.window.exists() else (0, 0)
        held = [list(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        # the rows of one micro-batch go by their key, null first; four bytes a token while they are sorted
        arrived = [(r["key"] is not None, r["key"] or 0, array("i", r["ids"])) for r in rows]
        arrived.sort(reverse=True)
        while arrived:
            units = kernels.cut_units(arrived.pop()[2], self.seq_len, self.low)
            held += units
            filled += len(units)
            if filled >= self.window_units:
                yield from self._closed(lane, number, held)
                number, filled, held = number + 1, 0, []
        self.window.update((number, filled))
        if held:
            self.waiting.put([(ids,) for ids in held])
        else:
            self.waiting.clear()
        if self.idle_ms:
            self._wake(timerValues)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        number, filled = self.window.get() if self.window.exists() else (0, 0)
        if filled:
            yield from self._closed(key[0], number, [list(r[0]) for r in self.waiting.get()])
            self.window.update((number + 1, 0))
            self.waiting.clear()

    def close(self) -> None:
        pass

    def _wake(self, timers: Any) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def _closed(self, lane: str, number: int, units: list[list[int]]) -> Iterator[Row]:
        for bin_no, (ids, lens) in enumerate(kernels.window_bins(units, self.capacity, self.low)):
            yield Row(_lane=lane, window_id=number, bin=bin_no, input_ids=ids, _lens=lens)


@dataclass
class ResumablePacker:
    """Packs a stream of text rows into padded samples under ``output``.

    ``start`` begins or resumes the query of ``checkpoint``; ``samples`` gives what has been packed, with the open
    windows packed as they are now if ``closing``. Both may be called after a stop at any point, by another
    session too, and the samples are those of one run. The encoder of ``start`` must work in place (no rest of
    a dictionary to be joined); ``start_encoded`` takes rows that any encoder has encoded. With more than one lane, rows go to lanes by a hash of ``key``, and
    ``lane`` is a column of the samples.
    """

    spark: SparkSession
    encoder: Encoder
    output: str
    checkpoint: str
    seq_len: int
    window_units: int
    capacity: int
    eos_id: int
    pad_id: int
    shard: str
    key: str
    min_len: int = 2
    text_column: str = "text"
    lanes: int = 1
    idle_ms: int | None = None

    def start(self, rows: DataFrame, trigger: dict[str, Any] | None = None) -> StreamingQuery:
        """The running query; by default it stops when all that is available has been packed."""
        if getattr(self.encoder, "tail", None) is not None:
            raise ValueError("the encoder's dictionary is larger than what tasks are handed; "
                             "use stream_encoded and start_encoded, or StreamPacker")
        return self.start_encoded(self.encoder.encode(drop_blank(rows, self.text_column), self.text_column), trigger)

    def start_encoded(self, encoded: DataFrame, trigger: dict[str, Any] | None = None) -> StreamingQuery:
        """Like ``start``, for rows that bring their ``ids``, as ``stream_encoded`` stores them."""
        shard = F.coalesce(F.concat(F.lit("="), F.col(self.shard).cast("string")), F.lit(""))
        lane = F.concat(F.pmod(F.xxhash64(self.key), F.lit(self.lanes)).cast("string"), F.lit("|"), shard)
        given = append_end(encoded, self.eos_id).select(lane.alias("_lane"), F.col(self.key).alias("key"), "ids")
        state = WindowState(self.seq_len, max(1, self.window_units), self.capacity, min_unit(self.min_len), self.idle_ms)
        packed = given.groupBy("_lane").transformWithState(
            state, T._parse_datatype_string(SAMPLES), "Append", "ProcessingTime" if self.idle_ms else "None")
        out = self._padded(packed, encoded.schema[self.shard].dataType)
        before = self.spark.conf.get(PROVIDER)
        self.spark.conf.set(PROVIDER, ROCKS)
        try:
            return (
                out.writeStream.format("parquet").outputMode("append").option("path", self.output)
                .option("checkpointLocation", self.checkpoint).trigger(**trigger or {"availableNow": True}).start()
            )
        finally:
            self.spark.conf.set(PROVIDER, before)

    def waiting(self) -> DataFrame:
        """``_lane``, window_id, units (in order) of the windows that are open at the last checkpoint."""
        def read(name: str) -> DataFrame:
            return (
                self.spark.read.format("statestore").option("path", self.checkpoint).option("stateVarName", name)
                .option("flattenCollectionTypes", False).load()
            )

        window = read("window").select(F.col("key._lane").alias("_lane"), F.col("value.number").alias("window_id"))
        units = read("waiting").select(F.col("key._lane").alias("_lane"), F.transform("list_value", lambda u: u["ids"]).alias("units"))
        return window.join(units, "_lane")

    def samples(self, closing: bool = True) -> DataFrame:
        """All samples: those of closed windows and, if ``closing``, those that the open ones make as they are."""
        packed = self.spark.read.parquet(self.output)
        if not closing:
            return packed
        capacity, low = self.capacity, min_unit(self.min_len)

        @F.arrow_udf("array<struct<bin:int,input_ids:array<int>,_lens:array<int>>>")
        def bins(units):
            return kernels.bins_of(units, capacity, low)

        left = self.waiting().select("_lane", "window_id", F.explode(bins("units")).alias("s")).select("_lane", "window_id", "s.*")
        return packed.unionByName(self._padded(left, packed.schema[self.shard].dataType))

    def _padded(self, packed: DataFrame, kind: T.DataType) -> DataFrame:
        shard: Column = F.substring_index("_lane", "|", 1)
        rest = F.expr("substring(_lane, instr(_lane, '|') + 1)")
        name = F.when(rest != "", F.expr("substring(_lane, instr(_lane, '|') + 2)")).cast(kind)
        lane = [shard.cast("int").alias("lane")] if self.lanes > 1 else []
        built = packed.select(
            name.alias(self.shard), *lane, "window_id", "bin", "input_ids", F.col("input_ids").alias("labels"),
            positions(F.col("_lens")).alias("position_ids"), unit_segments(F.col("_lens")).alias("segments"))
        return pad_samples(built, self.capacity, self.pad_id)
