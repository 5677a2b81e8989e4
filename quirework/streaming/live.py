"""Live editing sessions, as streams and as tables, whose rows are a stream's final answer.

events.ts must be a timestamp (UTC), which watermarks need. Where an answer hangs on deadlines, on order or on what an item was before, the stream
keeps its own state.
"""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quirework.streaming.cursors import Commands, after

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
LATENESS = "1 hour"


def read_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The events table, as a table or as a stream of its files, with ts as a timestamp."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(EVENTS).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def edit_bursts(events: DataFrame, gap: str = "6 hours", lateness: str = LATENESS) -> DataFrame:
    """(doc_id, started, settles, edits): edits of a document closer than the gap make one rebuild; edits later than allowed are dropped by a stream."""
    rows = events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("edits"))
    return rows.select(F.col("user_id").alias("doc_id"), F.col("w.start").alias("started"), F.col("w.end").alias("settles"), "edits")


def latest_generation(results: DataFrame) -> DataFrame:
    """(doc_id, generation, result): of results (doc_id, generation, result) the newest generation's; an older one never replaces it. Streams run it in update mode."""
    return results.groupBy("doc_id").agg(F.max("generation").alias("generation"), F.max_by("result", "generation").alias("result"))


def reply_deadlines(requests: DataFrame, replies: DataFrame, deadline: str = "6 hours", lateness: str = LATENESS) -> DataFrame:
    """(request_id, reply_id): each request with each reply of its document inside the deadline; a request without one has a null reply.

    requests is (request_id, doc_id, asked_at), replies (reply_id, reply_doc, replied_at).
    """
    a, b = requests.withWatermark("asked_at", lateness), replies.withWatermark("replied_at", lateness)
    in_time = (F.col("doc_id") == F.col("reply_doc")) & (F.col("replied_at") >= F.col("asked_at")) & (F.col("replied_at") <= F.col("asked_at") + F.expr(f"interval {deadline}"))
    return a.join(b, in_time, "left_outer").select("request_id", "reply_id")


class ReplyTimers(StatefulProcessor):
    """Open requests and replies of one document; a timer behind each deadline decides a request, when all replies in time must have come."""

    def __init__(self, deadline_us: int) -> None:
        self.deadline_us = deadline_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getMapState("asked", "request_id long", "at long")
        self.replied = handle.getMapState("replied", "reply_id long", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            for kind, number, at in zip(b["kind"], b["id"].tolist(), b["at_us"].tolist(), strict=True):
                if kind == "reply":
                    self.replied.updateValue((number,), (at,))
                else:
                    self.asked.updateValue((number,), (at,))
                    self.handle.registerTimer((at + self.deadline_us) // 1000 + 1)
        yield pd.DataFrame({"request_id": pd.array([], "Int64"), "reply_id": pd.array([], "Int64"), "answered": pd.array([], bool)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        asked = {k[0]: v[0] for k, v in self.asked.iterator()}
        replied = {k[0]: v[0] for k, v in self.replied.iterator()}
        due = sorted(k for k, at in asked.items() if at + self.deadline_us < now)
        first = [min((r for r, at in replied.items() if asked[k] <= at <= asked[k] + self.deadline_us), default=None) for k in due]
        for k in due:
            self.asked.removeKey((k,))
        # a request to come is no older than the watermark
        needed = min([at for k, at in asked.items() if k not in {*due}] + [timerValues.getCurrentWatermarkInMs() * 1000])
        for r, at in replied.items():
            if at < needed:
                self.replied.removeKey((r,))
        yield pd.DataFrame({"request_id": pd.array(due, "Int64"), "reply_id": pd.array(first, "Int64"), "answered": pd.array([f is not None for f in first], bool)})


def answered_requests(requests: DataFrame, replies: DataFrame, deadline: dt.timedelta = dt.timedelta(hours=6), lateness: str = LATENESS) -> DataFrame:
    """(request_id, reply_id, answered) of two streams: exactly one row for each request, once the watermark has passed its deadline.

    The reply is the one of the smallest id among those in time, null if the deadline was missed; rows later than allowed are dropped. Runs in append mode
    and needs the RocksDB state store.
    """
    asked = requests.select("doc_id", F.lit("request").alias("kind"), F.col("request_id").alias("id"), F.col("asked_at").alias("at"))
    came = replies.select(F.col("reply_doc").alias("doc_id"), F.lit("reply").alias("kind"), F.col("reply_id").alias("id"), F.col("replied_at").alias("at"))
    both = asked.unionByName(came).withWatermark("at", lateness).withColumn("at_us", F.unix_micros("at"))
    timers = ReplyTimers(deadline // dt.timedelta(microseconds=1))
    return both.groupBy("doc_id").transformWithStateInPandas(timers, "request_id long, reply_id long, answered boolean", "append", "EventTime")


class CursorState(StatefulProcessor):
    """(cursor, undone) of one document after all commands before the watermark, and the later ones in their order, which earlier ones may still precede."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.settled = handle.getValueState("settled", "cursor long, undone long")
        self.pending = handle.getMapState("pending", "at long, id long", "command string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            for at, number, command in zip(b["at_us"].tolist(), b["event_id"].tolist(), b["command"], strict=True):
                self.pending.updateValue((at, number), (command,))
        state = self.settled.get() if self.settled.exists() else (0, 0)
        passed, rest = Commands(), Commands()
        sure = timerValues.getCurrentWatermarkInMs() * 1000
        for (at, number), (command,) in sorted((tuple(k), tuple(v)) for k, v in self.pending.iterator()):
            (passed if at < sure else rest).add(command)
            if at < sure:
                self.pending.removeKey((at, number))
        state = after(tuple(state), *passed.parts())
        self.settled.update(state)
        cursor, undone = after(state, *rest.parts())
        yield pd.DataFrame({"doc_id": [key[0]], "cursor": [cursor], "length": [cursor + undone]})


def live_cursor_stream(commands: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(doc_id, cursor, length) after each batch of a stream of commands (doc_id, ts, event_id, command), in update mode.

    Commands count in the order of (ts, event_id) however they arrive; what comes later than allowed is dropped. A document's state is a pair
    of numbers and the commands that the watermark hasn't passed. Needs the RocksDB state store.
    """
    rows = commands.withWatermark("ts", lateness).select("doc_id", "ts", F.unix_micros("ts").alias("at_us"), "event_id", "command")
    return rows.groupBy("doc_id").transformWithStateInPandas(CursorState(), "doc_id long, cursor long, length long", "update", "EventTime")


def live_cursor(commands: DataFrame) -> DataFrame:
    """(doc_id, cursor, length) of a table of commands (doc_id, seq, command) in the order of seq.

    Commands are dealt out by ranges of document and place, so a document with many is in many tasks. Each task sends one summary for each of its
    documents; a document's summaries, as many as ranges it is in, are applied in their order.
    """

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, own, no = None, Commands(), 0
        for b in itertools.chain(batches, [None]):
            out: list[dict] = []
            for doc, command in zip(b.column("doc_id").to_pylist(), b.column("command").to_pylist(), strict=True) if b else [(None, "")]:
                if doc != of or b is None:
                    if no:
                        runs, pieces = own.parts()
                        out.append({"doc_id": of, "runs": runs, "pieces": pieces})
                    of, own, no = doc, Commands(), 0
                own.add(command)
                no += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.int64()), ("runs", pa.list_(pa.int64())), ("pieces", pa.list_(pa.list_(pa.int64())))]))

    @F.udf("cursor long, undone long", useArrow=True)
    def applied(summaries):
        state = (0, 0)
        for s in summaries:
            state = after(state, s["runs"], s["pieces"])
        return state

    ranges = commands.repartitionByRange("doc_id", "seq").sortWithinPartitions("doc_id", "seq").select("doc_id", "command")
    parts = ranges.mapInArrow(summarise, "doc_id long, runs array<long>, pieces array<array<long>>").withColumn("part", F.spark_partition_id())
    ordered = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "runs", "pieces"))).alias("s"))
    return ordered.select("doc_id", applied("s").alias("s")).select("doc_id", F.col("s.cursor").alias("cursor"), (F.col("s.cursor") + F.col("s.undone")).alias("length"))


def batch_progress(statuses: DataFrame) -> DataFrame:
    """(batch_id, items, done, failed, percent) from status rows (batch_id, item, at, status): each item counts with its latest status."""
    latest = statuses.groupBy("batch_id", "item").agg(F.max_by("status", F.struct("at", "status")).alias("status"))
    done = F.count_if(F.col("status") == "done")
    return latest.groupBy("batch_id").agg(F.count("*").alias("items"), done.alias("done"), F.count_if(F.col("status") == "failed").alias("failed"), F.floor(100 * done / F.count("*")).cast("long").alias("percent"))


class BatchCounters(StatefulProcessor):
    """Counters of one batch, and the latest status of each of its items; a change takes an item out of one counter and adds it to another."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "item long", "at long, id long, status string")
        self.counts = handle.getValueState("counts", "items long, done long, failed long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.counts.get()) if self.counts.exists() else (0, 0, 0)
        items, done, failed = before
        for b in rows:
            newest = b.sort_values(["at_us", "event_id", "status"]).drop_duplicates("item", keep="last")
            for item, at, number, status in zip(newest["item"].tolist(), newest["at_us"].tolist(), newest["event_id"].tolist(), newest["status"], strict=True):
                known = self.latest.containsKey((item,))
                was = tuple(self.latest.getValue((item,))) if known else None
                if was and was >= (at, number, status):
                    continue
                self.latest.updateValue((item,), (at, number, status))
                items += not known
                done += (status == "done") - (known and was[2] == "done")
                failed += (status == "failed") - (known and was[2] == "failed")
        if (items, done, failed) != before:
            self.counts.update((items, done, failed))
            yield pd.DataFrame({"batch_id": [key[0]], "items": [items], "done": [done], "failed": [failed], "percent": [100 * done // items]})


def batch_progress_stream(statuses: DataFrame) -> DataFrame:
    """batch_progress() of a stream of status rows, in update mode: a row for each batch whose counters a micro-batch has changed, and no others.

    Statuses may come late, in any order. Needs the RocksDB state store, from which only the items that a micro-batch names are read.
    """
    rows = statuses.select("batch_id", "item", F.unix_micros("at.ts").alias("at_us"), F.col("at.event_id").alias("event_id"), "status")
    return rows.groupBy("batch_id").transformWithStateInPandas(BatchCounters(), "batch_id long, items long, done long, failed long, percent long", "update", "None")


def follow_progress(statuses: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs batch_progress_stream() over what there is of a stream; each micro-batch's changed batches are given to write."""
    return batch_progress_stream(statuses).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def first_replies(pairs: DataFrame) -> DataFrame:
    """(request_id, reply_id, answered): the smallest reply of each request."""
    w = Window.partitionBy("request_id").orderBy(F.col("reply_id").asc_nulls_last())
    return pairs.withColumn("r", F.row_number().over(w)).where("r = 1").select("request_id", "reply_id", F.col("reply_id").isNotNull().alias("answered"))
