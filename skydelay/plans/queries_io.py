"""Registered queries: sources, sinks and catalog (survey A1-A16). Writers are checked by writing to a fresh folder
under the shared checkpoint location and reading the result back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from skydelay.operators import rows as B
from skydelay.plans.queries import KEYS, KEYS_SQL, V, query, slim
from skydelay.plans.queries_live import scratch
from skydelay.sources import io as IO


@query("A1_read_tabular", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem")
def q_a1(spark, sf):
    return IO.read_tabular(spark, f"{sf}/lineitem.parquet").select(*KEYS, "l_quantity")


@query("A1_read_tabular_csv", f"SELECT {KEYS_SQL}, ARRIVAL_DELAY FROM flights", ("flights",))
def q_a1c(spark, sf):
    path = scratch(spark, "flights-csv") + "/flights.csv"
    IO.write_tabular(V(spark, sf, "flights").select(*KEYS, "ARRIVAL_DELAY"), path)
    schema = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, ARRIVAL_DELAY double"
    return IO.read_tabular(spark, path, schema)


@query("A2_read_first_available", "SELECT count(*) AS n FROM orders")
def q_a2(spark, sf):
    df, _ = IO.read_first_available(spark, [f"{sf}/no_such_table.parquet", "", f"{sf}/orders.parquet",
                                            f"{sf}/orders.parquet"])
    return df.agg(F.count(F.lit(1)).alias("n"))


@query("A3_json_rows_from_text", "SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events "
                                 "WHERE json_valid(props) AND json_type(props) = 'OBJECT'")
def q_a3(spark, sf):
    return IO.json_rows_from_text(spark.read.parquet(f"{sf}/events.parquet"), "props", "k int")


@query("A3_read_json_rows", "SELECT event_id, event_type FROM events")
def q_a3b(spark, sf):
    path = scratch(spark, "events-json")
    spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type").write.json(path)
    return IO.read_json_rows(spark, path, "event_id long, event_type string", document=False)


@query("A4_read_airports_dat", """
SELECT IATA_CODE AS IATA, AIRPORT, NULLIF(CITY, chr(92) || 'N') AS CITY, COUNTRY FROM airports_raw""", ("airports_raw",))
def q_a4(spark, sf):
    path = scratch(spark, "airports-dat")
    raw = V(spark, sf, "airports_raw")
    cols = [F.col("src_order").cast("string"), "AIRPORT", "CITY", "COUNTRY", "IATA_CODE", F.lit("\\N"),
            F.col("LATITUDE").cast("string"), F.col("LONGITUDE").cast("string"), F.lit("0"), F.lit("0"), F.lit("U"),
            F.lit("\\N"), F.lit("airport"), F.lit("test")]
    raw.select(*[c if not isinstance(c, str) else F.col(c) for c in cols]).write.option("header", False).csv(path)
    return IO.read_airports_dat(spark, path)


@query("A5_read_flights_typed", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(YEAR AS SMALLINT) AS year, CAST(MONTH AS TINYINT) AS month,
  CAST(ARRIVAL_DELAY AS FLOAT) AS arrival_delay, airline FROM flights""", ("flights",))
def q_a5(spark, sf):
    out = IO.flights_typed(V(spark, sf, "flights"))
    return out.select(*KEYS, "year", "month", "arrival_delay", "airline")


@query("A6_scan_partitioned", """
SELECT year, month, count(*) AS n, CAST(sum(arrival_delay) AS DOUBLE) AS total_delay FROM slim
WHERE year IN (1996, 1997) AND month IN (1, 2, 12) GROUP BY 1, 2""", ("slim",))
def q_a6(spark, sf):
    path = scratch(spark, "slim-part")
    IO.write_partitioned(slim(spark, sf), path, ("year", "month"))
    scanned = IO.scan_partitioned(spark, path, {"year": [1996, 1997], "month": [1, 2, 12]},
                                  ["year", "month", "arrival_delay", "not_a_column"])
    return scanned.groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"),
                                                F.sum("arrival_delay").cast("double").alias("total_delay"))


def _csv_tree(spark, sf) -> str:
    """orders.csv, sub/customer.csv and sub/deep/nation.csv: three headers at three depths, one file each."""
    src = scratch(spark, "csv-tree")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    for table, cols, target in (("orders", ["o_orderkey", "o_custkey"], "orders"), ("customer", ["c_custkey", "c_name"], "sub/customer"),
                                ("nation", ["n_nationkey", "n_name"], "sub/deep/nation")):
        # one file per table is what the operator is given here: the writer of a single CSV file is one task
        spark.read.parquet(f"{sf}/{table}.parquet").select(*cols).coalesce(1).write.option("header", True).csv(f"{src}-parts/{table}")
        d = path(f"{src}-parts/{table}")
        fs = d.getFileSystem(conf)
        part = [s.getPath() for s in fs.listStatus(d) if s.getPath().getName().endswith(".csv")][0]
        fs.mkdirs(path(f"{src}/{target}").getParent())
        fs.rename(part, path(f"{src}/{target}.csv"))
    return src


@query("A8_convert_csv_tree", "SELECT 'orders' AS name, count(*) AS rows_in, count(*) AS rows_out FROM orders "
                              "UNION ALL SELECT 'sub/customer', count(*), count(*) FROM customer "
                              "UNION ALL SELECT 'sub/deep/nation', count(*), count(*) FROM nation")
def q_a8(spark, sf):
    out = IO.convert_csv_tree(spark, _csv_tree(spark, sf), scratch(spark, "csv-tree-out"))
    return out.select("name", F.col("rows_in").cast("long").alias("rows_in"), F.col("rows_out").cast("long").alias("rows_out"))


@query("A8_convert_csv_tree_values", """
SELECT 'orders' AS name, CAST(o_orderkey AS VARCHAR) AS a, CAST(o_custkey AS VARCHAR) AS b FROM orders
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), c_name FROM customer
UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation""")
def q_a8v(spark, sf):
    dst = scratch(spark, "csv-tree-out")
    IO.convert_csv_tree(spark, _csv_tree(spark, sf), dst)
    read = lambda p, n, a, b: spark.read.parquet(f"{dst}/{p}.parquet").select(F.lit(n).alias("name"), F.col(a).alias("a"), F.col(b).alias("b"))
    return read("orders", "orders", "o_orderkey", "o_custkey").unionByName(read("sub/customer", "customer", "c_custkey", "c_name")) \
        .unionByName(read("sub/deep/nation", "nation", "n_nationkey", "n_name"))


@query("A10_write_partitioned", """
SELECT year, month, count(*) AS rows FROM slim GROUP BY 1, 2""", ("slim",))
def q_a10(spark, sf):
    path = scratch(spark, "part-write")
    s = slim(spark, sf).withColumnRenamed("year", "YEAR").withColumnRenamed("month", "MONTH")
    IO.write_partitioned(s.where(F.col("YEAR") < 1998), path, ("YEAR", "MONTH"))
    IO.write_partitioned(s.where(F.col("YEAR") >= 1997), path, ("YEAR", "MONTH"))  # rewrites 1997 only
    back = spark.read.parquet(path)
    return back.groupBy("year", "month").agg(F.count(F.lit(1)).alias("rows"))


@query("A11_replace_dataset", "SELECT count(*) AS n FROM customer")
def q_a11(spark, sf):
    path = scratch(spark, "replace")
    IO.replace_dataset(spark.read.parquet(f"{sf}/orders.parquet"), path)
    IO.replace_dataset(spark.read.parquet(f"{sf}/customer.parquet"), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


def _catalog(spark, sf) -> str:
    """A database of its own below the shared scratch folder, with the external table flights_slim; returns its name."""
    path = scratch(spark, "catalog")
    database = "skydelay_" + path.rsplit("-", 1)[-1]
    IO.write_partitioned(slim(spark, sf), f"{path}/flights", ("year", "month"))
    defs = [{"name": "flights_slim", "columns": [("day", "INT"), ("arrival_delay", "DOUBLE"), ("is_delayed", "INT"),
                                                  ("airline_name", "STRING"), ("airline", "STRING"),
                                                  ("origin_state", "STRING")],
             "partitions": [("year", "INT"), ("month", "INT")], "location": f"{path}/flights"}]
    IO.create_tables(spark, database, defs, drop=True, location=f"{path}/database")
    return database


@query("A12_create_tables", """
SELECT * FROM (VALUES ('day', 'int'), ('arrival_delay', 'double'), ('is_delayed', 'int'), ('airline_name', 'string'),
  ('airline', 'string'), ('origin_state', 'string'), ('year', 'int'), ('month', 'int')) v(column_name, column_type),
  (SELECT count(*) AS partition_rows FROM slim)""", ("slim",))
def q_a12(spark, sf):
    table = f"{_catalog(spark, sf)}.flights_slim"
    IO.sync_partitions(spark, table)
    types = spark.createDataFrame(spark.table(table).dtypes, "column_name string, column_type string")
    return types.withColumn("partition_rows", spark.table(table).agg(F.count(F.lit(1))).scalar())


@query("A13_sync_partitions", "SELECT year, month, count(*) AS n FROM slim GROUP BY 1, 2", ("slim",))
def q_a13(spark, sf):
    table = f"{_catalog(spark, sf)}.flights_slim"
    IO.sync_partitions(spark, table, slim(spark, sf))
    return spark.table(table).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("A15_numeric_convertible", """
SELECT 'DISTANCE' AS column, bool_and(TRY_CAST(DISTANCE AS DOUBLE) IS NOT NULL) AS convertible FROM flights WHERE DISTANCE IS NOT NULL
UNION ALL SELECT 'AIRLINE', bool_and(TRY_CAST(AIRLINE AS DOUBLE) IS NOT NULL) FROM flights WHERE AIRLINE IS NOT NULL
UNION ALL SELECT 'DESTINATION_AIRPORT', bool_and(TRY_CAST(DESTINATION_AIRPORT AS DOUBLE) IS NOT NULL) FROM flights
  WHERE DESTINATION_AIRPORT IS NOT NULL
UNION ALL SELECT 'SCHEDULED_DEPARTURE', bool_and(TRY_CAST(SCHEDULED_DEPARTURE AS DOUBLE) IS NOT NULL) FROM flights
  WHERE SCHEDULED_DEPARTURE IS NOT NULL""", ("flights",))
def q_a15c(spark, sf):
    return IO.numeric_convertible(_as_text(spark, sf))


def _as_text(spark, sf):
    return V(spark, sf, "flights").select(*KEYS, *[F.col(c).cast("string").alias(c) for c in
                                                   ("DISTANCE", "AIRLINE", "DESTINATION_AIRPORT", "SCHEDULED_DEPARTURE")])


@query("A15_infer_numeric_columns", f"""
SELECT {KEYS_SQL}, CAST(DISTANCE AS DOUBLE) * 2 AS twice_distance, AIRLINE, DESTINATION_AIRPORT,
  CAST(SCHEDULED_DEPARTURE AS DOUBLE) AS SCHEDULED_DEPARTURE FROM flights""", ("flights",))
def q_a15(spark, sf):
    typed = IO.infer_numeric_columns(_as_text(spark, sf))
    numbers = [c for c, t in typed.dtypes if t == "double"]
    assert numbers == ["DISTANCE", "SCHEDULED_DEPARTURE"], numbers
    return typed.select(*KEYS, (F.col("DISTANCE") * 2).alias("twice_distance"), "AIRLINE", "DESTINATION_AIRPORT", "SCHEDULED_DEPARTURE")


@query("A16_write_run_metadata")
def q_a16(spark, sf):
    from skydelay.operators import stats as D
    from skydelay.plans.queries import enriched
    e = enriched(spark, sf)
    bal = D.class_balance(e).collect()  # two rows: one per class
    meta = IO.run_metadata(spark, {"target": "IS_DELAYED"}, {}, {str(r["class"]): int(r["count"]) for r in bal}, 0.5,
                           "2001-10-01T00:00:00")
    path = IO.write_run_metadata(meta, scratch(spark, "meta"))
    return spark.read.json(path)


@query("B10_resolve_columns", f"SELECT {KEYS_SQL}, ARRIVAL_DELAY AS arrival_delay, AIRLINE AS carrier FROM flights",
       ("flights",))
def q_b10(spark, sf):
    f = V(spark, sf, "flights")
    out = B.resolve_columns(f, {"l_orderkey": [], "l_linenumber": [], "l_partkey": [], "l_suppkey": [],
                                "arrival_delay": ["ARR_DELAY", "ARRIVAL_DELAY"], "carrier": ["AIRLINE"],
                                "optional_missing": ["NOPE"]}, required=["arrival_delay", "carrier"])
    return out


@query("I8_publish", """
SELECT YEAR AS year, MONTH AS month, count(*) AS n, CAST(sum(CAST(delay_probability AS DECIMAL(30,6))) AS DOUBLE) AS total FROM scored
GROUP BY 1, 2""", ("scored",))
def q_i8p(spark, sf):
    """Two publications, the second one broken off after its swap and repeated; the table is read back."""
    from skydelay.operators.rows import prediction_partition_frame
    rows = prediction_partition_frame(V(spark, sf, "scored").select(*KEYS, "YEAR", "MONTH", "delay_probability"))
    path, table = scratch(spark, "published"), f"{_catalog(spark, sf)}.published_{uuid.uuid4().hex[:12]}"

    def stop(step):
        if step == "swap":
            raise InterruptedError(step)
    IO.publish(rows.withColumn("delay_probability", F.lit(9.0)).where("month <= 6"), path, table, "first")
    try:
        IO.publish(rows, path, table, "second", after=stop)
    except InterruptedError:
        IO.publish(rows, path, table, "second")
    return spark.table(table).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("delay_probability").cast("decimal(30,6)")).cast("double").alias("total"))
