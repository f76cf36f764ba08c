"""Structured Streaming jobs over live positions and chat messages (survey J1-J6).

Each job is a function ``streaming DataFrame -> streaming DataFrame`` (or a started query for the stateful sinks),
so the same code runs on a file / Kafka source in production and on ``availableNow`` over parquet in tests.
Event time is ``last_contact_ts`` (TIMESTAMP); watermarks bound the state.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor

from skydelay.operators import live as L
from skydelay.session import cut_lineage


def with_event_time(df: DataFrame, ts: str = "last_contact_ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ)."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# J3 -----------------------------------------------------------------------------------------------
def dedupe_states(stream: DataFrame, ts: str = "last_contact_ts", delay: str = "10 minutes") -> DataFrame:
    """One row per (icao24, last_contact). ``delay`` is how late a source may deliver: rows that come later than that
    behind the newest event are dropped by the watermark, so it must cover the source's lateness."""
    return with_event_time(stream, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["icao24", ts])


# J4 -----------------------------------------------------------------------------------------------
def traffic_counts(stream: DataFrame, window: str = "1 hour", ts: str = "last_contact_ts", delay: str = "10 minutes",
                   region: str = "origin_country") -> DataFrame:
    """Distinct aircraft per region per tumbling event-time window. In a stream a window is emitted once, when the
    watermark passes its end: aircraft are de-duplicated within the window, then counted."""
    s = with_event_time(stream, ts)
    if not s.isStreaming:
        counted = s.groupBy(F.window(ts, window).alias("w"), region).agg(F.count_distinct("icao24").alias("aircraft"))
    else:
        once = s.withWatermark(ts, delay).select(F.window(ts, window).alias("w"), region, "icao24") \
            .dropDuplicates(["w", region, "icao24"])
        counted = once.groupBy("w", region).agg(F.count(F.lit(1)).alias("aircraft"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), region, "aircraft")


def traffic_counts_batch(df: DataFrame, window: str = "1 hour", ts: str = "last_contact_ts",
                         region: str = "origin_country") -> DataFrame:
    return traffic_counts(df, window, ts, region=region)


# J1 / J2 ------------------------------------------------------------------------------------------
def latest_positions_batch(df: DataFrame, ts: str = "last_contact_ts", order: str = "event_id") -> DataFrame:
    """Newest state per aircraft (batch form of J1): max_by on (time, arrival) - a partial aggregate."""
    others = [c for c in df.columns if c != "icao24"]
    agg = df.groupBy("icao24").agg(F.max_by(F.struct(*others), F.struct(F.col(ts), F.col(order))).alias("r"))
    return agg.select("icao24", *[F.col("r")[c].alias(c) for c in others])


class ChangeLog:
    """What a stateful stream emits, one folder of changed rows per micro-batch: a batch costs its own rows, whatever the
    table holds. A row is a key's newest version, or its removal (``removed``). A batch that is repeated after a crash
    rewrites its own folder; a folder without Spark's commit mark is not read."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)

    def write(self, batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch:09d}")

    def epochs(self) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(path(f"{self.path}/epoch=*/_SUCCESS"))
        return sorted(s.getPath().getParent().toString() for s in found)

    def changes(self) -> DataFrame | None:
        folders = self.epochs()
        return self.spark.read.option("basePath", self.path).parquet(*folders) if folders else None

    def read(self) -> DataFrame | None:
        """The table now: of each key the newest version, unless it was removed. A partial aggregate."""
        rows = self.changes()
        if rows is None:
            return None
        others = [c for c in rows.columns if c not in (*self.keys, "epoch")]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others), F.col("epoch").cast("long")).alias("r"))
        return newest.where(~F.col("r.removed")).select(*self.keys, *[F.col("r")[c].alias(c) for c in others if c != "removed"])

    def compact(self) -> None:
        """Folds all committed folders into the newest of them. Not while the stream runs."""
        folders = self.epochs()
        if len(folders) < 2:
            return
        folded = cut_lineage(self.read().withColumn("removed", F.lit(False)))
        folded.write.mode("overwrite").parquet(folders[-1])
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for old in folders[:-1]:
            path(old).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path(old), True)


_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _packed(stream: DataFrame, columns: Sequence[str]):
    """The columns as one JSON text, which keeps their nulls and types apart from pandas."""
    return F.to_json(F.struct(*columns), _EXACT)


def _unpacked(out: DataFrame, schema: T.StructType, columns: Sequence[str], *others: str) -> DataFrame:
    wanted = T.StructType([schema[c] for c in columns])
    return out.select(*others, F.from_json("payload", wanted, _EXACT).alias("r")).select(*others, "r.*")


@contextmanager
def state_store(spark: SparkSession):
    """Keyed state with timers needs the RocksDB store; a query takes the setting when it starts."""
    key, store = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, store)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _LatestPosition(StatefulProcessor):
    """Value state: an aircraft's newest contact (time, arrival, row). Timer: when it has been silent for too long."""

    def __init__(self, forget_ms: int) -> None:
        self.forget_ms = forget_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "micros long, number long, payload string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        found = [(int(m), int(n), p) for pdf in rows for m, n, p in zip(pdf["micros"], pdf["number"], pdf["payload"])]
        best = max(found)
        held = self.newest.get() if self.newest.exists() else None
        if held is not None and tuple(held)[:2] >= best[:2]:
            return
        self.newest.update(best)
        if held is not None:
            self.handle.deleteTimer(held[0] // 1000 + self.forget_ms)
        self.handle.registerTimer(best[0] // 1000 + self.forget_ms)
        yield pd.DataFrame({"icao24": [key[0]], "payload": [best[2]], "removed": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        import pandas as pd
        held = self.newest.get()
        self.newest.clear()
        yield pd.DataFrame({"icao24": [key[0]], "payload": [held[2]], "removed": [True]})

    def close(self) -> None:
        pass


def latest_positions_stream(stream: DataFrame, ts: str = "last_contact_ts", order: str = "event_id",
                            forget_seconds: int | None = None, delay: str = "1 minute") -> DataFrame:
    """J1: the changes of the newest state per aircraft (``removed`` false). Older arrivals never replace a newer state; an
    aircraft whose state stays may be written again. Without ``forget_seconds`` it is a running aggregate: rows are combined
    before they meet the state. With it (by ``transformWithState``) an aircraft is removed when the watermark (``delay``) passes
    its last contact by that much, which bounds the state to the aircraft now flying; ``delay`` must cover the source's
    lateness. Write with ``run_changes``."""
    columns = [c for c in stream.columns if c != "icao24"]
    s = with_event_time(stream, ts)
    if forget_seconds is not None:
        s = s.withWatermark(ts, delay)
    rows = s.select("icao24", ts, F.coalesce(F.unix_micros(ts), F.lit(-(1 << 62))).alias("micros"),
                    F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 62))).alias("number"), _packed(s, columns).alias("payload"))
    if forget_seconds is None:
        newest = rows.groupBy("icao24").agg(F.max(F.struct("micros", "number", "payload")).alias("newest"))
        out = newest.select("icao24", "newest.payload", F.lit(False).alias("removed"))
    else:
        out = rows.groupBy("icao24").transformWithStateInPandas(_LatestPosition(forget_seconds * 1000), "icao24 string, payload string, removed boolean",
                                                                "Update", "EventTime")
    return _unpacked(out, s.schema, columns, "icao24", "removed")


def run_changes(changes: DataFrame, log: ChangeLog, checkpoint: str) -> None:
    """Runs a stream of changes over everything available and appends each micro-batch to the log."""
    with state_store(changes.sparkSession):
        run_available_now(changes, None, checkpoint, mode="update", foreach_batch=log.write)


def expire_positions(df: DataFrame, as_of_ts: str, ts: str = "last_contact_ts", ttl_seconds: int = 300) -> DataFrame:
    """J2 in batch: age against ``as_of_ts``; label fresh / stale / gone and drop those silent longer than ttl."""
    age = F.unix_timestamp(F.lit(as_of_ts).cast("timestamp")) - F.unix_timestamp(F.col(ts).cast("timestamp"))
    out = df.withColumn("age_seconds", age).withColumn("freshness", L.age_label("age_seconds"))
    return out.where(F.col("age_seconds") <= ttl_seconds)


def expire_positions_stream(stream: DataFrame, ttl_seconds: int = 300, ts: str = "last_contact_ts",
                            delay: str = "1 minute", order: str = "event_id") -> DataFrame:
    """J2 as a stream: every arrival is emitted as 'live', and an aircraft is emitted as 'gone' (with its last contact)
    once for each silence longer than ``ttl_seconds``: between two of its contacts, or when the watermark passes its
    last one by that much. State is one row per aircraft now flying; what is emitted does not depend on how the arrivals
    are cut into micro-batches. ``delay`` must cover the source's lateness."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    s = with_event_time(stream, ts).withWatermark(ts, delay).select("icao24", order, ts)
    out_schema = f"icao24 string, {order} long, {ts} timestamp, status string"
    ttl = pd.Timedelta(seconds=ttl_seconds)

    def fn(key, pdfs, state):
        def rows(items, status):
            return pd.DataFrame({"icao24": [key[0]] * len(items), order: [i for _, i in items], ts: [t for t, _ in items],
                                 "status": [status] * len(items)})
        if state.hasTimedOut:
            last, number = state.get
            state.remove()
            yield rows([(pd.Timestamp(last), number)], "gone")
            return
        arrived = sorted((t, int(i)) for pdf in pdfs for t, i in zip(pdf[ts], pdf[order]))
        yield rows(arrived, "live")
        seen = ([(pd.Timestamp(state.get[0]), state.get[1])] if state.exists else []) + arrived
        seen.sort()
        if silent := [a for a, b in zip(seen, seen[1:]) if b[0] - a[0] > ttl]:
            yield rows(silent, "gone")
        newest = seen[-1]
        expiry = int(newest[0].timestamp() * 1000) + ttl_seconds * 1000
        if expiry <= state.getCurrentWatermarkMs():  # already silent for longer than ttl
            if state.exists:
                state.remove()
            yield rows([newest], "gone")
            return
        state.update((newest[0].to_pydatetime(), newest[1]))
        state.setTimeoutTimestamp(expiry)

    return s.groupBy("icao24").applyInPandasWithState(fn, out_schema, "last timestamp, number long", "append",
                                                      GroupStateTimeout.EventTimeTimeout)


# J5 -----------------------------------------------------------------------------------------------
class _LastMessages(StatefulProcessor):
    """List state: the last n messages of a session as (turn, row)."""

    def __init__(self, n: int, session: str, turn: str) -> None:
        self.n, self.session, self.turn = n, session, turn

    def init(self, handle) -> None:
        self.held = handle.getListState("messages", "turn long, payload string")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd
        before = {int(t): p for t, p in self.held.get()} if self.held.exists() else {}
        arrived: dict[int, str] = {}
        for pdf in rows:
            for t, p in zip(pdf["turn"], pdf["payload"]):
                arrived[int(t)] = max(p, arrived.get(int(t), ""))
        both = before | arrived
        last = sorted(both)[-self.n:]
        self.held.put([(t, both[t]) for t in last])
        changed = [(t, both[t], False) for t in last if before.get(t) != both[t]]
        changed += [(t, before[t], True) for t in before if t not in last]
        if changed:
            turns, payloads, removed = zip(*changed)
            yield pd.DataFrame({self.session: [key[0]] * len(changed), self.turn: turns, "payload": payloads, "removed": removed})

    def close(self) -> None:
        pass


def last_messages_stream(stream: DataFrame, n: int = 16, session: str = "session_id", turn: str = "turn") -> DataFrame:
    """J5: the changes of the last n messages of every session, by ``transformWithState``: new and replaced messages, and
    those that fall out (``removed``). A message that comes again replaces its turn (of several in one micro-batch the
    largest). State is n messages a session. Write with ``run_changes``."""
    columns = [c for c in stream.columns if c not in (session, turn)]
    rows = stream.select(session, F.col(turn).cast("long").alias("turn"), _packed(stream, columns).alias("payload"))
    kind = stream.schema[session].dataType.simpleString()
    out = rows.groupBy(session).transformWithStateInPandas(
        _LastMessages(n, session, turn), f"{session} {kind}, {turn} long, payload string, removed boolean", "Update", "None")
    return _unpacked(out, stream.schema, columns, session, turn, "removed") \
        .withColumn(turn, F.col(turn).cast(stream.schema[turn].dataType))


# J6 -----------------------------------------------------------------------------------------------
def score_stream(stream: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """I5 applied to arriving schedule rows (the fitted pipeline is a plain transformer)."""
    from skydelay.plans.ml import score
    return score(stream, model, threshold)


def run_available_now(df: DataFrame, sink_dir: str, checkpoint: str, mode: str = "append",
                      fmt: str = "parquet", foreach_batch=None) -> None:
    """Process everything available, then stop (tests and scheduled catch-up runs)."""
    w: DataStreamWriter = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if foreach_batch is not None:
        q = w.foreachBatch(foreach_batch).start()
    else:
        q = w.format(fmt).option("path", sink_dir).start()
    q.awaitTermination()


def stream_files(spark, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)


__all__: Sequence[str] = ("dedupe_states", "traffic_counts", "traffic_counts_batch", "latest_positions_batch",
                          "ChangeLog", "latest_positions_stream", "run_changes", "expire_positions", "expire_positions_stream",
                          "last_messages_stream", "score_stream", "run_available_now", "stream_files")
