"""Progress events of audit jobs as streams: stage records, rate limits, expiry, fan-out. Each stateful operator has a batch
form with the same result, for replay and for tests."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

LIMIT, SECONDS, TTL_SECONDS = 30, 60, 3600
#: Seconds added to event times: a stream's first watermark is 0, and what isn't behind it counts as late.
_SHIFT = 86_400
STAGE = "job long, stage string, started double, ended double, status string"


def stage_records(events: DataFrame) -> DataFrame:
    """Batch: events (job, stage, kind start/complete/error, at, seq) to stage records. An end closes the first record of
    its stage that still runs: the n-th end closes the n-th start, if that came before it; ends that find none vanish."""
    w = Window.partitionBy("job", "stage").orderBy("at", "seq")
    e = events.withColumn("_step", F.when(F.col("kind") == "start", 1).otherwise(-1)).withColumn("_sum", F.sum("_step").over(w))
    # ends beyond the starts so far are dropped: each new minimum below zero of the running sum is one
    e = e.withColumn("_low", F.least(F.lit(0), F.min("_sum").over(w))).withColumn("_before", F.coalesce(F.lag("_low").over(w), F.lit(0)))
    e = e.filter((F.col("_step") == 1) | (F.col("_low") == F.col("_before")))
    e = e.withColumn("n", F.row_number().over(Window.partitionBy("job", "stage", "_step").orderBy("at", "seq")))
    ends = e.filter("_step = -1").select("job", "stage", "n", F.col("at").alias("ended"), F.col("kind").alias("_end"))
    out = e.filter("_step = 1").select("job", "stage", "n", F.col("at").alias("started")).join(ends, ["job", "stage", "n"], "left")
    return out.select("job", "stage", "started", "ended", F.when(F.col("_end").isNull(), "running").when(F.col("_end") == "complete", "completed").otherwise("failed").alias("status"))


def _advance(seconds: float):
    def one(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        running = list(state.get[0]) if state.exists else []
        rows = pd.concat(frames).sort_values(["at", "seq"])
        done = []
        for at, kind in zip(rows["at"], rows["kind"], strict=True):
            if kind == "start":
                running.append(float(at))
            elif running:
                done.append((key[0], key[1], running.pop(0), float(at), "completed" if kind == "complete" else "failed"))
        running = [x for x in running if x > float(rows["at"].iloc[-1]) - seconds]
        if running:
            state.update((running,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(done, columns=["job", "stage", "started", "ended", "status"])

    return one


def stage_stream(events: DataFrame, seconds: float = 24 * TTL_SECONDS) -> DataFrame:
    """Streaming: finished stage records. State is the running ones of each (job, stage), without those that have run for
    longer than `seconds`; a stage with none leaves no state."""
    return events.groupBy("job", "stage").applyInPandasWithState(_advance(seconds), STAGE, "running array<double>", "append", GroupStateTimeout.NoTimeout)


def _allow(limit: int, seconds: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = object(), deque()
        for batch in batches:
            out = []
            for key, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != now:
                    now, kept = key, deque()
                while kept and kept[0] <= at - seconds:
                    kept.popleft()
                out.append(len(kept) < limit)
                if out[-1]:
                    kept.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.bool_())], ["key", "seq", "accepted"])

    return run


def rate_limit(requests: DataFrame, limit: int = LIMIT, seconds: float = SECONDS) -> DataFrame:
    """Batch: requests (key, at, seq) with whether each is accepted: fewer than `limit` accepted ones of its key in the
    trailing window; rejected ones don't count. Requests without a key share one. Each partition is read in order once; what
    is remembered is at most `limit` times of one key, however many requests it has."""
    ordered = requests.select(F.col("key").cast("long"), F.col("at").cast("double"), F.col("seq").cast("long")).repartition("key").sortWithinPartitions("key", "at", "seq")
    return ordered.mapInArrow(_allow(limit, seconds), "key long, seq long, accepted boolean")


def _as_key(key) -> object:
    """A group's key as it came: pandas may hand a null over as NaN."""
    return None if key is None or key != key else key


def _allow_state(limit: int, seconds: float):
    def one(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        columns = ["key", "seq", "accepted"]
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0] if state.exists else [])
        rows = pd.concat(frames).sort_values(["at", "seq"])
        out = []
        for at, seq in zip(rows["at"].tolist(), rows["seq"].tolist(), strict=True):
            while kept and kept[0] <= at - seconds:
                kept.popleft()
            out.append((_as_key(key[0]), seq, len(kept) < limit))
            if out[-1][2]:
                kept.append(at)
        if kept:
            state.update((list(kept),))
            # nothing of the window counts any more once time has passed it
            state.setTimeoutTimestamp(max(int((kept[-1] + seconds + _SHIFT) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        made = pd.DataFrame(out, columns=columns)
        yield made.astype({"key": "Int64", "seq": "int64", "accepted": "bool"})

    return one


def _timed(rows: DataFrame, delay: str) -> DataFrame:
    return rows.withColumn("moment", F.timestamp_micros(((F.col("at") + _SHIFT) * 1_000_000).cast("long"))).withWatermark("moment", delay)


def rate_limit_stream(requests: DataFrame, limit: int = LIMIT, seconds: float = SECONDS, delay: str = "1 minute") -> DataFrame:
    """Streaming: state is the accepted times of the window, `limit` at most for a key. A timer in event time drops the state
    of a key whose window has passed, so idle keys leave none. Requests that come later than `delay` get no decision."""
    return _timed(requests, delay).groupBy("key").applyInPandasWithState(_allow_state(limit, seconds), "key long, seq long, accepted boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def trailing_count(requests: DataFrame, seconds: int = SECONDS) -> DataFrame:
    """Requests of a key in the trailing window, itself included: an upper bound of what a rate limit counts."""
    w = Window.partitionBy("key").orderBy("at").rangeBetween(-seconds, 0)
    return requests.withColumn("n", F.count(F.lit(1)).over(w))


def evict(jobs: DataFrame, now: float, ttl: float = TTL_SECONDS) -> DataFrame:
    """Jobs without the ended ones that are older than the time to live."""
    return jobs.filter(~(F.col("status").isin("completed", "failed") & (F.lit(now) - F.col("created") > ttl)))


TERMINAL = ("completed", "failed")


def _expire(ttl: float):
    def one(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        columns = ["job", "created", "status"]
        if state.hasTimedOut:
            created, status = state.get
            state.remove()
            yield pd.DataFrame([(key[0], created, status)], columns=columns)
            return
        created, status = state.get if state.exists else (None, "running")
        rows = pd.concat(frames).sort_values(["at", "seq"])
        created = float(rows["at"].iloc[0]) if created is None else min(created, float(rows["at"].iloc[0]))
        ended = [x for x in rows["status"] if x in TERMINAL]
        status = status if status in TERMINAL else ended[0] if ended else "running"
        due = int((created + ttl + _SHIFT) * 1000) + 1
        if status in TERMINAL and due <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
            yield pd.DataFrame([(key[0], created, status)], columns=columns)
            return
        state.update((created, status))
        if status in TERMINAL:
            state.setTimeoutTimestamp(due)

    return one


def evict_stream(events: DataFrame, ttl: float = TTL_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """Streaming: events (job, status, at, seq) to the ended jobs that have outlived `ttl` since their first event: job,
    created, status, each once. State is a job's first time and end; the timer that makes the row removes it, so what is kept
    are the jobs that evict() keeps: running ones and those ended not long ago."""
    return _timed(events, delay).groupBy("job").applyInPandasWithState(_expire(ttl), "job long, created double, status string", "created double, status string", "append", GroupStateTimeout.EventTimeTimeout)


def job_states(events: DataFrame) -> DataFrame:
    """Batch: job, created (first event), status (the first end, else running) from events (job, status, at, seq)."""
    first_end = F.min(F.when(F.col("status").isin(*TERMINAL), F.struct("at", "seq", "status")))
    return events.groupBy("job").agg(F.min("at").alias("created"), F.coalesce(first_end["status"], F.lit("running")).alias("status"))


def snapshot_then_tail(states: DataFrame, events: DataFrame, job: int, since: float | None) -> DataFrame:
    """What a new subscriber gets: the job's state, then the events behind `since` (None: there is no such place, so none); an
    ended job's state only."""
    since = F.lit(since).cast("double")
    own = states.filter(F.col("job") == job)
    live = own.filter(~F.col("status").isin(*TERMINAL)).select("job")
    tail = events.filter((F.col("job") == job) & (F.col("at") > since)).join(live, "job", "left_semi")
    return own.select(F.lit(0).alias("block"), since.alias("at"), F.col("status").alias("what")).unionByName(tail.select(F.lit(1).alias("block"), "at", F.col("kind").alias("what")))


@dataclass(frozen=True)
class Subscriber:
    """Who gets events. sink: (rows, number) -> None; number is the micro-batch's, -1 for the snapshot. job: only its events,
    up to the one whose kind is in `ends`, which closes the subscription. snapshot: a row of the job's state, handed out once
    before everything else; with an ended job it is all that is. since: only events behind it."""

    name: str
    sink: Callable[[DataFrame, int], None]
    job: int | None = None
    snapshot: DataFrame | None = None
    since: float | None = None
    ends: tuple[str, ...] = ("complete", "error")


class _Offsets:
    """What has been handed out to a subscriber: a small table a step, written when the step is done."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def has(self, name: str, step: str) -> bool:
        try:
            return not self.spark.read.schema("id long").parquet(f"{self.path}/{name}/{step}").isEmpty()
        except AnalysisException:
            return False

    def put(self, name: str, step: str) -> None:
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{name}/{step}")


def _hand_out(offsets: _Offsets, who: Subscriber, batch: DataFrame, number: int) -> None:
    if offsets.has(who.name, "closed"):
        return
    if who.snapshot is not None and not offsets.has(who.name, "snapshot"):
        who.sink(who.snapshot, -1)
        if not who.snapshot.filter(F.col("status").isin(*TERMINAL)).isEmpty():
            offsets.put(who.name, "closed")
            return
        offsets.put(who.name, "snapshot")
    if offsets.has(who.name, str(number)):
        return
    rows, closes = batch, False
    if who.job is not None:
        rows = rows.filter(F.col("job") == who.job)
        rows = rows if who.since is None else rows.filter(F.col("at") > who.since)
        end = rows.filter(F.col("kind").isin(*who.ends)).agg(F.min(F.struct("at", "seq")).alias("end")).first()["end"]
        if end is not None:
            closes = True
            rows = rows.filter((F.col("at") < end["at"]) | ((F.col("at") == end["at"]) & (F.col("seq") <= end["seq"])))
    if who.job is None or not rows.isEmpty():
        who.sink(rows, number)
    offsets.put(who.name, "closed" if closes else str(number))


def fan_out(stream: DataFrame, sinks: Sequence[Subscriber | Callable[[DataFrame, int], None]], checkpoint: str):
    """A streaming query that hands each micro-batch to every subscriber once: the number of a batch is kept for each of
    them when it has been handed out, so a batch that is run again after a failure reaches only those that haven't had it. A
    sink that fails after a part of its work gets the same number again and overwrites that part (table_sink does). The
    batch is kept for the time of one hand-out. Those who subscribe without a name are named by their place."""
    who = [s if isinstance(s, Subscriber) else Subscriber(f"sink{i}", s) for i, s in enumerate(sinks)]
    if len({s.name for s in who}) < len(who):
        raise ValueError("two subscribers of one name")
    offsets = _Offsets(stream.sparkSession, f"{checkpoint}/handed")

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for s in who:
                _hand_out(offsets, s, batch, number)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def table_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to a folder of its number: writing it again replaces it."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def step_log(stream: DataFrame, path: str, checkpoint: str):
    """Append every row as a line of JSON."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def dedup_stream(events: DataFrame, *keys: str, at: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Each key once. A stream needs an event time: keys are remembered for the watermark's delay only."""
    if events.isStreaming and at is None:
        raise ValueError("a stream without event time would remember its keys for ever")
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys)) if at else events.dropDuplicates(list(keys))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder as a stream, one file a micro-batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)
