"""The job queue as a stream: JSON messages in, validated rows out, at least once, duplicates dropped within a watermark."""

from __future__ import annotations

from collections.abc import Callable
from threading import Event

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

#: The fields of a message and the defaults of those that may be absent.
SCHEMA = "action string, project_id string, template_type string, target_length double, music_uri string, enable_beat_sync boolean, start_phase int"
DEFAULT_ACTION, DEFAULT_SYNC = "run", True


def parse(raw: DataFrame, body: str = "body") -> DataFrame:
    """Message columns with their defaults, and ``valid``: whether the body is an object with a project."""
    m = F.from_json(body, SCHEMA)
    return raw.select(
        "*",
        F.coalesce(m["action"], F.lit(DEFAULT_ACTION)).alias("action"),
        m["project_id"].alias("project_id"),
        m["template_type"].alias("template_type"),
        m["target_length"].alias("target_length"),
        m["music_uri"].alias("music_uri"),
        F.coalesce(m["enable_beat_sync"], F.lit(DEFAULT_SYNC)).alias("enable_beat_sync"),
        m["start_phase"].alias("start_phase"),
        F.coalesce(m["project_id"].isNotNull(), F.lit(False)).alias("valid"),
    )


def runnable(messages: DataFrame) -> DataFrame:
    """Valid messages of the run action; others are acknowledged and left."""
    return messages.where("valid and action = 'run'")


def once(messages: DataFrame, message_id: str, at: str, delay: str = "1 hour") -> DataFrame:
    """Each message id once within the delay."""
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark([message_id])


def rejected(messages: DataFrame) -> DataFrame:
    """The messages that can't be handled, with the reason, for a table of their own."""
    why = F.when(F.col("project_id").isNull(), "no project").when(F.col("action") != "run", F.concat(F.lit("action "), F.col("action")))
    return messages.withColumn("reason", why).where("reason is not null")


def drain(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Handle all that is there in micro-batches; offsets are kept in ``checkpoint``, so a failed batch comes again."""
    stream.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Drain into the folder ``path``, each batch into its own part, so that a batch that comes again replaces its rows."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    drain(stream, write, checkpoint)


def poll(make: Callable[[], StreamingQuery], stop: Event, pause: float = 5.0, most: int | None = None) -> int:
    """Run the query that ``make`` starts until ``stop`` is set; after an error wait ``pause`` seconds and start it again from its checkpoint. Gives the number of errors; from ``most`` on the last is raised."""
    errors = 0
    while not stop.is_set():
        try:
            query = make()
            while query.isActive and not stop.wait(0.2):
                pass
            query.stop()
            if (failed := query.exception()) is not None:
                raise failed
            return errors
        except StreamingQueryException:
            errors += 1
            if most is not None and errors >= most:
                raise
            stop.wait(pause)
    return errors


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 day", delay: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per tumbling window, or sliding by ``slide``; rows later than ``delay`` behind the latest are left out of windows that have ended."""
    w = F.window(at, width, slide) if slide else F.window(at, width)
    return events.withWatermark(at, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def joined(left: DataFrame, right: DataFrame, key: str, at_left: str, at_right: str, within: str, delay: str = "1 hour") -> DataFrame:
    """Rows of two streams of one key, the right one at or up to ``within`` after the left; both watermarked, so that state is dropped."""
    l, r = left.withWatermark(at_left, delay).alias("l"), right.withWatermark(at_right, delay).alias("r")
    return l.join(r, F.expr(f"l.{key} = r.{key} AND r.{at_right} >= l.{at_left} AND r.{at_right} <= l.{at_left} + INTERVAL {within}"))


STATE = "key string, n bigint, last_value string, last_at timestamp"


def latest_states(events: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Keyed state over a stream in update mode: after each batch the number of events of each key in it and the latest value by time, then by value."""

    def fold(k, batches, state: GroupState):
        n, last = state.get if state.exists else (0, None)
        for rows in batches:
            n += len(rows)
            new = max((pd.Timestamp(t).value // 1000, v) for t, v in zip(rows["at"], rows["value"], strict=True))
            last = new if last is None else max(tuple(last), new)
        state.update((n, last))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "last_value": [last[1]], "last_at": [pd.Timestamp(last[0], unit="us")]})

    chosen = events.select(F.col(key).cast("string").alias("key"), F.col(value).cast("string").alias("value"), F.col(at).alias("at")).where("value is not null and at is not null")
    return chosen.groupBy("key").applyInPandasWithState(fold, STATE, "n bigint, last struct<at:bigint,value:string>", "update", "NoTimeout")
