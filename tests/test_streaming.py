import shutil
import tempfile
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from conftest import SF_SMALL
from skydelay.plans import fixtures as FX
from skydelay.streaming import live as S


def _live_dir(spark, parts=3):
    """Files that arrive in the order of their events."""
    from skydelay.plans.queries_live import _feed
    live = FX.view(spark, SF_SMALL, "live_states").withColumn("last_contact_ts", F.col("last_contact_ts").cast("timestamp"))
    return _feed(spark, live, "last_contact_ts", tempfile.mkdtemp(prefix="skydelay-live-") + "/src", parts)


def test_dedupe_stream_equals_batch(spark):
    src = _live_dir(spark)
    schema = spark.read.parquet(src).schema
    out, ck = tempfile.mkdtemp() + "/o", tempfile.mkdtemp() + "/c"
    S.run_available_now(S.dedupe_states(S.stream_files(spark, src, schema, max_files=1)).select("icao24", "last_contact_ts"),
                        out, ck)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    want = {tuple(r) for r in spark.read.parquet(src).select("icao24", "last_contact_ts").distinct().collect()}
    assert got == want


def test_latest_positions_stream_equals_batch_over_a_restart(spark):
    src = _live_dir(spark, 4)
    schema = spark.read.parquet(src).schema
    files = sorted(Path(src).glob("*.parquet"))
    now = Path(tempfile.mkdtemp())
    log, ck = S.ChangeLog(spark, tempfile.mkdtemp() + "/t", ["icao24"]), tempfile.mkdtemp() + "/c"
    assert log.read() is None
    arrived = 0
    for part in (files[:2], files[2:]):  # the second run starts from the first one's checkpoint
        for f in part:
            shutil.copy(f, now / f.name)
        stream = S.stream_files(spark, str(now), schema, max_files=1).select("event_id", "icao24", "last_contact_ts", "latitude")
        S.run_changes(S.latest_positions_stream(stream), log, ck)
        whole = spark.read.schema(schema).parquet(str(now)).select("event_id", "icao24", "last_contact_ts", "latitude")
        got = {(r.icao24, r.event_id, r.last_contact_ts, r.latitude) for r in log.read().collect()}
        assert got == {(r.icao24, r.event_id, r.last_contact_ts, r.latitude) for r in S.latest_positions_batch(whole).collect()}
    # a batch writes one row per aircraft that came in it, not the table
    for epoch, count in log.changes().groupBy("epoch").count().collect():
        arrived = max(arrived, count)
    assert arrived <= max(spark.read.parquet(str(f)).select("icao24").distinct().count() for f in files)
    before = {tuple(r) for r in log.read().collect()}
    spark.range(1).write.parquet(f"{log.path}/epoch=000000009/_temporary/0")  # a write that never committed
    log.compact()
    assert {tuple(r) for r in log.read().collect()} == before and len(log.epochs()) == 1


def test_old_contacts_never_replace_new_ones_and_silence_removes(spark):
    at = lambda m: datetime(2024, 1, 1, 0, m)
    src = Path(tempfile.mkdtemp())
    schema = "icao24 string, event_id long, last_contact_ts timestamp, altitude double"
    feeds = ([("a", 1, at(5), None), ("b", 2, at(1), 2.5)], [("a", 3, at(2), 1.0), ("c", 4, at(3), float("nan"))],
             [("d", 5, at(40), 0.1)], [("d", 6, at(41), 0.1)])
    log, ck = S.ChangeLog(spark, tempfile.mkdtemp() + "/t", ["icao24"]), tempfile.mkdtemp() + "/c"
    for i, rows in enumerate(feeds):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        S.run_changes(S.latest_positions_stream(S.stream_files(spark, str(src), schema), forget_seconds=600, delay="10 minutes"), log, ck)
        got = {r.icao24: r for r in log.read().collect()}
        if i == 1:
            assert {k: r.event_id for k, r in got.items()} == {"a": 1, "b": 2, "c": 4}
            assert got["a"].altitude is None and got["c"].altitude != got["c"].altitude
    assert set(got) == {"d"}  # the others have been silent for more than ten minutes


def test_traffic_counts_stream_equals_batch(spark):
    src = _live_dir(spark)
    df = spark.read.parquet(src)
    out, ck = tempfile.mkdtemp() + "/o", tempfile.mkdtemp() + "/c"
    S.run_available_now(S.traffic_counts(S.stream_files(spark, src, df.schema, max_files=1)), out, ck)
    newest = df.agg(F.max("last_contact_ts")).first()[0]
    closed = S.traffic_counts_batch(df).where(F.col("window_end") <= F.lit(newest) - F.expr("INTERVAL 10 MINUTE"))
    key = lambda d: sorted(tuple(r) for r in d.select("window_start", "origin_country", "aircraft").collect())
    assert key(spark.read.parquet(out)) == key(closed)


def test_expire_positions_does_not_depend_on_batches(spark):
    got = []
    for parts in (2, 5):
        src = _live_dir(spark, parts)
        schema = spark.read.parquet(src).schema
        out, ck = tempfile.mkdtemp() + "/o", tempfile.mkdtemp() + "/c"

        def write(batch, epoch, out=out):
            batch.write.mode("append").parquet(out)
        S.run_available_now(S.expire_positions_stream(S.stream_files(spark, src, schema, max_files=1), 300), None, ck,
                            foreach_batch=write)
        res = spark.read.parquet(out)
        assert {r.event_id for r in res.where("status = 'live'").collect()} == \
            {r.event_id for r in spark.read.parquet(src).collect()}
        got.append(sorted((r.icao24, r.event_id) for r in res.where("status = 'gone'").distinct().collect()))
    assert got[0] == got[1] and got[0]


def test_last_messages_of_each_session(spark):
    src = Path(tempfile.mkdtemp())
    schema = "session_id string, turn int, content string"
    log, ck = S.ChangeLog(spark, tempfile.mkdtemp() + "/t", ["session_id", "turn"]), tempfile.mkdtemp() + "/c"
    for rows in ([("s", 1, "a"), ("s", 2, "b"), ("t", 1, "x")], [("s", 3, "c"), ("s", 2, "B")], [("t", 2, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        S.run_changes(S.last_messages_stream(S.stream_files(spark, str(src), schema), 2), log, ck)
    assert sorted(tuple(r) for r in log.read().select("session_id", "turn", "content").collect()) == \
        [("s", 2, "B"), ("s", 3, "c"), ("t", 1, "x"), ("t", 2, None)]
    # the last batch touched one session: it wrote that session's change only
    assert log.changes().where("epoch = 2").count() == 1


def test_feed_reads_its_table_once_whatever_the_files(spark):
    """Every file of the feed was a read of the whole table, and every file a micro-batch."""
    from skydelay.plans import queries_live as Q
    reads = spark.sparkContext.accumulator(0)

    def through(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    plain = spark.range(4000).selectExpr("id AS event_id", "timestamp_seconds(1700000000 + id * 7) AS ts", "if(id % 50 = 3, null, id) AS x")
    table = plain.mapInArrow(through, plain.schema)
    src = Q._feed(spark, table, "ts", tempfile.mkdtemp() + "/src", 10)
    assert reads.value <= 3 * 4000  # to count, to find the ranges, to write
    files = sorted(Path(src).glob("part-*.parquet"), key=lambda f: f.stat().st_mtime)
    assert len(files) == 10
    ranges = [spark.read.parquet(str(f)).agg(F.min("event_id"), F.max("event_id")).first() for f in files]
    assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    got = spark.read.parquet(src).groupBy("event_id").count()
    assert got.count() == 4000 and 0 < got.where("count = 2").count() < 800 and got.where("count > 2").count() == 0
    assert [Q._batch_files(n) for n in (3, 4, 24, 144, 10_000)] == [1, 1, 6, 8, 8]


def test_scored_micro_batches_have_a_file_for_every_task(spark, monkeypatch):
    from pathlib import Path

    from conftest import SF_SMALL
    from skydelay.plans import queries_extra, queries_ml
    from skydelay.streaming import live
    fitted = queries_ml.fitted(spark, SF_SMALL, "logreg")
    monkeypatch.setattr(queries_ml, "fitted", lambda *_: fitted)
    fed = []
    monkeypatch.setattr(live, "stream_files", lambda s, path, schema, max_files, read=live.stream_files:
                        fed.append((path, max_files)) or read(s, path, schema, max_files=max_files))
    assert queries_extra.q_j6(spark, SF_SMALL).count() == fitted[2].test.count()
    (path, at_once), tasks = fed[0], spark.sparkContext.defaultParallelism
    assert at_once == tasks and len(list(Path(path.removeprefix("file:")).glob("part-*"))) > 2 * tasks
