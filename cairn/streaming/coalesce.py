"""Coalescing bursts of messages.

A buffer of a key takes messages until it has been idle or open for too long, or is full by number or characters. In batch this is a fold
over a key's messages in order; in a stream the same fold keeps the open buffer as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scores, text
from ..sources.shared import dealt

WAVES = "key string, wave_start double, wave_end double, parts int, chars int, reason string"
#: Idle seconds, window seconds, parts and characters of a profile's buffers. Fixed values.
PROFILES = {"default": (12.0, 4.0, 8, 2000), "tech": (8.0, 2.5, 6, 1500), "intimate": (20.0, 8.0, 12, 3000)}
#: The most characters of a message that may wait, by profile. Fixed values.
MOST_SINGLE = {"default": 500, "tech": 400, "intimate": 800}

Buffer = tuple[float, float, int, int]


def step(buffer: Buffer | None, ts: float, size: int, idle: float, window: float, parts: int, chars: int) -> tuple[Buffer | None, list[tuple]]:
    """The buffer (start, last, parts, chars) after a message, and the waves that it closes."""
    out = []
    if buffer is not None:
        start, last, n, c = buffer
        if ts - last >= idle or ts - start >= window:
            out.append((start, last, n, c, "idle" if ts - last >= idle else "window"))
            buffer = None
    buffer = (ts, ts, 1, size) if buffer is None else (buffer[0], ts, buffer[2] + 1, buffer[3] + size)
    if buffer[2] >= parts or buffer[3] >= chars:
        out.append((*buffer, "parts" if buffer[2] >= parts else "chars"))
        buffer = None
    return buffer, out


#: Seconds of a slot. A key's messages are put in order slot by slot, so that a busy key is no single task.
SLOT = 86_400


def in_runs(messages: DataFrame, idle_s: float) -> DataFrame:
    """messages (key, ts_s, size, seq) with run, a number that rises with each pause of idle_s between messages of a key, from 0.

    Order is found within slots of time; a slot knows the last message before it and the pauses so far from a row for each slot.
    """
    slotted = messages.withColumn("_slot", F.floor(F.col("ts_s") / SLOT))
    order = Window.partitionBy("key", "_slot").orderBy("ts_s", "seq")
    opens = slotted.withColumn("_gap", F.col("ts_s") - F.lag("ts_s").over(order)).withColumn("_open", F.coalesce((F.col("_gap") >= idle_s).cast("int"), F.lit(0)))
    slots = opens.groupBy("key", "_slot").agg(F.min("ts_s").alias("_first"), F.max("ts_s").alias("_last"), F.sum("_open").alias("_opens"))
    after = Window.partitionBy("key").orderBy("_slot")
    slots = slots.withColumn("_new", F.coalesce((F.col("_first") - F.lag("_last").over(after) >= idle_s).cast("int"), F.lit(0)))
    slots = slots.select("key", "_slot", (F.sum(F.col("_new") + F.col("_opens")).over(after) - F.col("_opens")).alias("_base"))
    return opens.join(slots, ["key", "_slot"]).withColumn("run", F.sum("_open").over(order) + F.col("_base")).drop("_slot", "_gap", "_open", "_base")


def sessions(messages: DataFrame, idle_s: float) -> DataFrame:
    """messages (key, ts_s, size, seq) in runs without a pause of idle_s: (key, run, start_s, end_s, parts, chars), for keys of any size."""
    return in_runs(messages, idle_s).groupBy("key", "run").agg(F.min("ts_s").alias("start_s"), F.max("ts_s").alias("end_s"), F.count("*").alias("parts"), F.sum("size").alias("chars"))


def buffer_status(messages: DataFrame, as_of: float, idle_s: float) -> DataFrame:
    """The buffers that are open at as_of, each key's last run if its pause is not over: (key, parts, chars, age_s, idle_s)."""
    last = sessions(messages.where(F.col("ts_s") <= as_of), idle_s).groupBy("key").agg(F.max_by(F.struct("start_s", "end_s", "parts", "chars"), "run").alias("x"))
    return last.where(F.lit(as_of) - F.col("x.end_s") < idle_s).select("key", "x.parts", "x.chars", (F.lit(as_of) - F.col("x.start_s")).alias("age_s"), (F.lit(as_of) - F.col("x.end_s")).alias("idle_s"))


def live_sessions(messages: DataFrame, as_of: float, ttl_s: float = 1_800, most: int = 100, history: int = 50) -> DataFrame:
    """The search sessions that are open at as_of, the `most` latest of them: (key, start_s, last_s, parts, history), history the seqs of the last messages, oldest first."""
    runs = in_runs(messages.where(F.col("ts_s") <= as_of), ttl_s)
    last = runs.groupBy("key", "run").agg(F.min("ts_s").alias("start_s"), F.max("ts_s").alias("last_s"), F.count("*").alias("parts"))
    live = last.where(F.lit(as_of) - F.col("last_s") < ttl_s).orderBy(F.desc("last_s"), "key").limit(most)
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("ts_s"), F.desc("seq")))
    said = runs.join(live.select("key", "run"), ["key", "run"]).withColumn("_n", place).where(F.col("_n") <= history)
    said = said.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts_s", "seq"))), lambda x: x["seq"]).alias("history"))
    return live.join(said, "key").select("key", "start_s", "last_s", "parts", "history")


def coalesce_stream(messages: DataFrame, profile: str = "default", watermark: str = "10 minutes") -> DataFrame:
    """Waves of a stream of messages (key, ts timestamp, size): buffers are state, closed by the next message or by event time passing their idle limit.

    Late messages beyond the watermark are dropped, as the reference of time is the event's own.
    """
    idle, window, parts, chars = PROFILES[profile]

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, out = (state.get if state.exists else None), []
        if state.hasTimedOut:
            if buffer is not None:
                out.append((*buffer, "idle"))
            state.remove()
        else:
            rows = sorted((t.timestamp(), int(s)) for frame in frames for t, s in zip(frame["ts"], frame["size"]))
            for ts, size in rows:
                buffer, closed = step(buffer, ts, size, idle, window, parts, chars)
                out += closed
            if buffer is None:
                if state.exists:
                    state.remove()
            else:
                state.update(buffer)
                state.setTimeoutTimestamp(max(int((buffer[1] + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], *w) for w in out], columns=["key", "wave_start", "wave_end", "parts", "chars", "reason"])

    watched = messages.withWatermark("ts", watermark)
    return watched.groupBy("key").applyInPandasWithState(update, WAVES, "start double, last double, n int, chars int", "append", GroupStateTimeout.EventTimeTimeout)


def coalesce_batch(messages: DataFrame, profile: str = "default") -> DataFrame:
    """The waves of all messages (key, ts_s, size, seq), the last of each key closed as 'idle'.

    A pause of the idle limit always closes a buffer, so that each run between such pauses is folded on its own. Runs of one message need no
    fold; the others are dealt out and sorted, and each task folds its stream of messages, holding one buffer.
    """
    idle, window, parts, chars = PROFILES[profile]
    placed = in_runs(messages, idle).select("key", "run", F.col("ts_s").cast("double").alias("ts_s"), F.col("size").cast("long").alias("size"), "seq")
    runs = placed.groupBy("key", "run").agg(F.count("*").alias("n"), F.min("ts_s").alias("ts_s"), F.min("size").alias("size"))
    full = F.when(F.lit(parts) <= 1, "parts").when(F.col("size") >= chars, "chars").otherwise("idle")
    alone = runs.where("n = 1").select("key", F.col("ts_s").alias("wave_start"), F.col("ts_s").alias("wave_end"), F.lit(1).alias("parts"), F.col("size").cast("int").alias("chars"), full.alias("reason"))
    longer = placed.join(runs.where("n > 1").select("key", "run"), ["key", "run"], "left_semi")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, buffer = None, None
        for batch in batches:
            out = []
            for key, run, ts, size in zip(*(batch.column(c).to_pylist() for c in ("key", "run", "ts_s", "size"))):
                if (key, run) != at:
                    if buffer is not None:
                        out.append((at[0], *buffer, "idle"))
                    at, buffer = (key, run), None
                buffer, closed = step(buffer, ts, size, idle, window, parts, chars)
                out += [(key, *w) for w in closed]
            yield _waves(out)
        if buffer is not None:
            yield _waves([(at[0], *buffer, "idle")])

    folded = dealt(longer, "key", "run").sortWithinPartitions("key", "run", "ts_s", "seq").mapInArrow(fold, WAVES)
    return alone.unionByName(folded)


def _waves(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "wave_start", "wave_end", "parts", "chars", "reason"])


def buffer_reason(content: Column, profile: Column, is_async: Column, opted_out: Column, no_fastpath: Column) -> Column:
    """'ok' for a message that waits in its profile's buffer, else the first reason why it is taken at once.

    Only asynchronous calls wait, and none that has opted out. Empty and null messages, those longer than the profile allows, and short facts of a known form (unless the call wants none
    taken that way) don't. An unknown profile is the default; null flags are false.
    """
    said, on = F.trim(F.coalesce(content, F.lit(""))), lambda c: F.coalesce(c, F.lit(False))
    most = scores.choose(profile, MOST_SINGLE, MOST_SINGLE["default"])
    return (
        F.when(~on(is_async), "sync_path")
        .when(on(opted_out), "opt_out")
        .when(said == "", "empty")
        .when(F.length(said) > most, "too_long")
        .when(~on(no_fastpath) & text.fastpath(said).isNotNull(), "fastpath_candidate")
        .otherwise("ok")
    )


def saved(waves: DataFrame, profile: str) -> DataFrame:
    """What waves save: (day, profile, reason, waves, messages, saved), a wave being one call for all its messages."""
    day = F.date_format(F.timestamp_seconds(F.floor("wave_start")), "yyyy-MM-dd").alias("day")
    grouped = waves.groupBy(day, F.lit(profile).alias("profile"), "reason")
    return grouped.agg(F.count("*").alias("waves"), F.sum("parts").cast("long").alias("messages"), F.sum(F.col("parts") - 1).cast("long").alias("saved"))
