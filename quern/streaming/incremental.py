"""Structured Streaming: incremental builds, deduplication with state, and sessions with a timeout."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.functions import text as T


def incremental(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], files_per_batch: int = 100) -> None:
    """Takes the files that are new since the last run, in batches, and appends what `transform` makes of them; a run that died goes on where it was."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def new_texts(docs: DataFrame, text: str, time: str | None = None, late: str = "1 day") -> DataFrame:
    """The first row of each text; with a time column, texts are remembered as long as late rows may come."""
    keyed = docs.withColumn("text_hash", F.sha2(T.for_duplicates(text), 256))
    if time:
        return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["text_hash"])
    return keyed.dropDuplicates(["text_hash"])


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per key and window; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


SESSION = "session string, state string, events long, asked long, last_type string"
_STATE = "state string, events long, asked long"


def session_states(events: DataFrame, key: str, kind: str, wait_ms: int = 600_000, most_questions: int = 6) -> DataFrame:
    """Running, waiting_clarification or completed per session.

    `question` asks (repeats and questions beyond `most_questions` do not count), `answer` resumes, `done` ends;
    a session that waits longer than `wait_ms` is timed out and ends.
    """

    def step(session: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, events_, asked = state.get if state.exists else ("running", 0, 0)
        last = None
        if state.hasTimedOut:
            now, last = "completed", "timeout"
        else:
            for pdf in batches:
                for k in pdf[kind]:
                    last = k
                    events_ += 1
                    if now == "completed":
                        continue
                    if k == "question" and asked < most_questions:
                        asked += 1
                        now = "waiting_clarification"
                    elif k == "answer":
                        now = "running"
                    elif k == "done":
                        now = "completed"
        if now == "completed" and state.hasTimedOut:
            state.remove()
        else:
            state.update((now, events_, asked))
            if now == "waiting_clarification":
                state.setTimeoutDuration(wait_ms)
        yield pd.DataFrame({"session": [str(session[0])], "state": [now], "events": [events_], "asked": [asked], "last_type": [last]})

    return events.groupBy(key).applyInPandasWithState(step, SESSION, _STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)
