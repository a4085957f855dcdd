"""Event streams: duplicates, the barrier over several completions, deliveries that are made once, and rate limits."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Window in which the publisher drops repeated messages.
DEDUPLICATION = "5 minutes"


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Files of a folder as a stream of events."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def without_repeats(events: DataFrame, key: str = "msg_id", at: str = "ts", within: str = DEDUPLICATION) -> DataFrame:
    """First event of each key within the window; the state is bounded by the watermark.

    A table has no watermark: of each key the event of the least time stays, whatever lies between the others.
    """
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if not events.isStreaming:
        first = timed.groupBy(F.col(key).alias("__k")).agg(F.min_by(F.struct(*timed.columns), at).alias("__r"), F.first(F.struct(*timed.columns)).alias("__any"))
        return first.select(F.coalesce("__r", "__any").alias("__r")).select("__r.*")
    return timed.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def completed(events: DataFrame, key: str, kind: str, wanted: Sequence[str], at: str) -> DataFrame:
    """Keys with an event of every wanted kind, and when the last of them came; each key once, whatever the order."""
    firsts = events.where(F.col(kind).isin(list(wanted))).groupBy(key, kind).agg(F.min(at).alias("at"))
    return firsts.groupBy(key).agg(F.count("*").alias("kinds"), F.max("at").alias("completed_at")).where(F.col("kinds") == len(wanted)).drop("kinds")


def barrier_stream(events: DataFrame, wanted: Sequence[str], expire_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """key and kinds of every key of the stream (key, kind), once, when all wanted kinds have come, in any order.

    Repeated and later events change nothing. The state of a key is one number and expires when the key has been idle.
    """
    bits = {kind: 1 << k for k, kind in enumerate(sorted(set(wanted)))}
    full = (1 << len(bits)) - 1

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        before = state.get[0] if state.exists else 0
        seen = before
        for frame in frames:
            for kind in frame["kind"]:
                seen |= bits.get(kind, 0)
        state.update((seen,))
        state.setTimeoutDuration(expire_ms)
        if seen == full != before:
            yield pd.DataFrame({"key": [key[0]], "kinds": [len(bits)]})

    return events.groupBy("key").applyInPandasWithState(fold, "key string, kinds int", "seen int", "update", GroupStateTimeout.ProcessingTimeTimeout)


def undelivered(wanted: DataFrame, log: DataFrame, keys: Sequence[str] = ("audit_id", "channel")) -> DataFrame:
    """Deliveries that no row of the log (with status) reports as delivered, each key once."""
    done = log.where("status = 'delivered'").select(*keys).distinct()
    return wanted.dropDuplicates(list(keys)).join(done, list(keys), "left_anti")


def deliver_once(stream: DataFrame, read_log: Callable[[], DataFrame], send: Callable[[DataFrame], DataFrame], write_log: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Sends what the log does not have yet, batch by batch; a replayed batch sends nothing again.

    `send` gives the rows with their status; they go to the log before the next batch begins.
    """

    def run(batch: DataFrame, _: int) -> None:
        write_log(send(undelivered(batch, read_log())))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admitted(requests: DataFrame, key: str, at: str, rate: float, burst: int) -> DataFrame:
    """requests with `allowed`: a token bucket for each key, in order of time, with `rate` tokens a second and room for `burst`.

    Keys are independent; one key's requests are folded in order as sorted batches, so memory does not grow with them.
    """
    kinds = dict(requests.dtypes)
    ordered = requests.repartition(key).sortWithinPartitions(key, at)
    ddl = ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", allowed boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        owner: object = None
        tokens, last = float(burst), None
        for frame in frames:
            allowed = []
            for k, moment in zip(frame[key], frame[at]):
                if k != owner:
                    owner, tokens, last = k, float(burst), moment
                tokens = min(float(burst), tokens + (moment - last).total_seconds() * rate)
                last = moment
                allowed.append(tokens >= 1)
                tokens -= allowed[-1]
            yield frame.assign(allowed=allowed)

    return ordered.mapInPandas(run, ddl)
