"""Streams: a run state machine, windows over events, and a unit pipeline that resumes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veridoc.operators.history import TRANSITIONS

_OUT = "run_id string, sequence bigint, event_type string, state_after string, accepted boolean, reason string"
_STATE = "next bigint, state string"


def run_states(events: DataFrame) -> DataFrame:
    """ST1: a stream of ``(run_id, sequence, event_type)`` to accepted and refused transitions.

    State per run: the next sequence number and the current state. A repeated, missing or
    illegal event is refused with its reason and leaves the state as it is; refused rows are
    the dead-letter output.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, now = state.get if state.exists else (0, "")
        rows = []
        frame = pd.concat(list(batches)).sort_values("sequence", kind="stable")
        for n, kind in zip(frame["sequence"], frame["event_type"]):
            before, after = TRANSITIONS.get(kind, (None, None))
            reason = None
            if after is None:
                reason = "unknown type"
            elif n < following:
                reason = "repeated"
            elif n > following:
                reason = "gap"
            elif (before or "") != now:
                reason = "illegal transition"
            if reason is None:
                following, now = following + 1, after
            rows.append((key[0], int(n), kind, now, reason is None, reason))
        state.update((following, now))
        yield pd.DataFrame(rows, columns=["run_id", "sequence", "event_type", "state_after", "accepted", "reason"])

    return events.groupBy("run_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window (an extension: the source system has no windows)."""
    stream = events.withWatermark("ts", late) if events.isStreaming else events
    g = stream.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "value")


def process_units(units: DataFrame, output: str, checkpoint: str) -> None:
    """ST4: measure every unit ``(unit_id, path, content)`` once, whatever the number of interrupted runs.

    The stream reads what is there and stops; its checkpoint is the exact record of the finished
    files, so a run after an interruption goes on behind it and the output equals that of one run.
    """
    measured = units.select(
        "unit_id", F.sha2("content", 256).alias("sha256"), F.octet_length("content").alias("bytes"), F.size(F.split("content", "\n")).alias("lines"),
        F.when(F.lower("path").endswith(".json"), "json").when(F.lower("path").endswith(".md"), "markdown").otherwise("text").alias("kind"),
    )
    q = measured.writeStream.format("parquet").outputMode("append").option("path", output).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
