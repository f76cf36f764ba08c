"""Readers, writers and catalog helpers (survey §2.A).

Paths are plain Hadoop paths (local, HDFS, s3a://...); existence checks use the Hadoop FileSystem of the path, so
the same code runs against object stores. Writes are Spark writes: parallel, one file per task, atomic commit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skydelay.functions import exprs as X
from skydelay.session import cut_lineage


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


# A1 -----------------------------------------------------------------------------------------------
def read_tabular(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet by suffix (or a folder of parquet), else CSV with a header row."""
    if path.lower().rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True)
    if schema is not None:
        reader = reader.schema(schema)
    else:
        reader = reader.option("inferSchema", True)
    return reader.csv(path)


# A2 -----------------------------------------------------------------------------------------------
def read_first_available(spark: SparkSession, candidates: Iterable[str], schema=None) -> tuple[DataFrame, str]:
    """The first existing source among ordered, de-duplicated candidates; a missing ``.parquet`` also tries the
    same name with ``.csv``. The error lists every path tried."""
    seen: list[str] = []
    for c in candidates:
        c = (c or "").strip()
        if c and c not in seen:
            seen.append(c)
    tried = []
    for c in seen:
        options = [c] + ([c[: -len(".parquet")] + ".csv"] if c.lower().endswith(".parquet") else [])
        for p in options:
            tried.append(p)
            if _fs_exists(spark, p):
                return read_tabular(spark, p, schema), p
    raise FileNotFoundError("No data source found; tried: " + ", ".join(tried))


# A3 -----------------------------------------------------------------------------------------------
def read_json_rows(spark: SparkSession, path: str, schema=None, document: bool = True) -> DataFrame:
    """JSON files that are each one object or an array of objects (``document``), or JSON Lines whose lines are
    objects or arrays of objects -> one row per object."""
    reader = spark.read.option("multiLine", document)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.json(path)
    if "_corrupt_record" in df.columns and len(df.columns) == 1:
        raise ValueError("JSON input must be an object or an array of objects.")
    return df


def json_rows_from_text(df: DataFrame, col: str, schema: T.StructType | str) -> DataFrame:
    """Text column holding one object or an array of objects -> exploded typed rows (other shapes are dropped)."""
    if not isinstance(schema, T.StructType):
        schema = df.sparkSession.createDataFrame([], schema).schema
    arr = F.from_json(F.col(col), T.ArrayType(schema))
    obj = F.from_json(F.col(col), schema)
    trimmed = F.ltrim(F.col(col))
    items = F.when(trimmed.startswith("["), arr).when(trimmed.startswith("{"), F.array(obj))
    return df.select(F.explode(items).alias("r")).select("r.*")


# A4 -----------------------------------------------------------------------------------------------
AIRPORTS_DAT_COLUMNS = ["airport_id", "name", "city", "country", "iata", "icao", "latitude", "longitude", "altitude",
                        "timezone", "dst", "tz_database_time_zone", "type", "source"]  # fixed values: 14 columns


def read_airports_dat(spark: SparkSession, path: str) -> DataFrame:
    """Headerless 14-column airports file, ``\\N`` = null; keeps code, name, city, country (aliases for B15)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in AIRPORTS_DAT_COLUMNS])
    df = spark.read.csv(path, header=False, schema=schema, nullValue="\\N")
    return df.select(F.col("iata").alias("IATA"), F.col("name").alias("AIRPORT"), F.col("city").alias("CITY"),
                     F.col("country").alias("COUNTRY"))


# A5 -----------------------------------------------------------------------------------------------
COMPACT_TYPES = {  # fixed values: known flight columns -> compact storage type (text columns stay as they are)
    "YEAR": "short", "MONTH": "byte", "DAY": "byte", "DAY_OF_WEEK": "byte", "FLIGHT_NUMBER": "int",
    "SCHEDULED_DEPARTURE": "int", "DEPARTURE_TIME": "float", "DEPARTURE_DELAY": "float", "TAXI_OUT": "float",
    "WHEELS_OFF": "float", "SCHEDULED_TIME": "float", "ELAPSED_TIME": "float", "AIR_TIME": "float", "DISTANCE": "float",
    "WHEELS_ON": "float", "TAXI_IN": "float", "SCHEDULED_ARRIVAL": "int", "ARRIVAL_TIME": "float",
    "ARRIVAL_DELAY": "float", "DIVERTED": "byte", "CANCELLED": "byte", "AIR_SYSTEM_DELAY": "float",
    "SECURITY_DELAY": "float", "AIRLINE_DELAY": "float", "LATE_AIRCRAFT_DELAY": "float", "WEATHER_DELAY": "float",
    "ORIGIN_LATITUDE": "float", "ORIGIN_LONGITUDE": "float", "DESTINATION_LATITUDE": "float",
    "DESTINATION_LONGITUDE": "float", "IS_HOLIDAY": "byte", "IS_DELAYED": "byte", "ORIGIN_DELAY_RATE": "float",
    "DEST_DELAY_RATE": "float", "CARRIER_DELAY_RATE": "float", "ROUTE_DELAY_RATE": "float",
    "CARRIER_DELAY_RATE_DOW": "float",
}


def flights_typed(df: DataFrame) -> DataFrame:
    """Explicit compact types for the known columns only (unparseable -> null); every name lower-cased."""
    cols = []
    for c in df.columns:
        t = COMPACT_TYPES.get(c.upper())
        v = (X.text_to_double(F.col(c)).cast(t) if t else F.col(c)) if dict(df.dtypes)[c] == "string" else \
            (F.col(c).cast(t) if t else F.col(c))
        cols.append(v.alias(c.lower()))
    return df.select(*cols)


def read_flights_typed(spark: SparkSession, path: str) -> DataFrame:
    return flights_typed(read_tabular(spark, path))


# A6 -----------------------------------------------------------------------------------------------
def scan_partitioned(spark: SparkSession, path: str, filters: dict[str, Sequence] | None = None,
                     columns: Sequence[str] | None = None) -> DataFrame:
    """Hive-partitioned scan: IN-list filters on partition/data columns (pruned / pushed down) and only the requested
    columns that exist."""
    df = spark.read.parquet(path)
    for c, vals in (filters or {}).items():
        if vals:
            df = df.where(F.col(c).isin(list(vals)))
    if columns:
        keep = [c for c in columns if c in df.columns]
        df = df.select(*keep) if keep else df
    return df


# A8 -----------------------------------------------------------------------------------------------
def _csv_files(spark: SparkSession, src: str) -> list[tuple[str, str, str]]:
    """(path, path below ``src`` without suffix, header line) of every CSV file under ``src``: one line per file is read
    on the driver, nothing of the data."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(src)
    fs = root.getFileSystem(conf)
    base = fs.makeQualified(root).toString().rstrip("/") + "/"
    found, walk = [], fs.listFiles(root, True)
    while walk.hasNext():
        path = walk.next().getPath()
        name = path.toString()
        if name.lower().endswith(".csv"):
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(path), "UTF-8"))
            header = reader.readLine()
            reader.close()
            found.append((name, name.removeprefix(base)[:-len(".csv")], (header or "").lstrip("\ufeff")))
    return sorted(found)


def convert_csv_tree(spark: SparkSession, src: str, dst: str) -> DataFrame:
    """Every ``*.csv`` under ``src`` -> parquet of the same name at the same place under ``dst``; returns (name,
    rows_in, rows_out) so a caller can check counts before any (separate, opt-in) source deletion.

    Files are grouped by header and each group is converted in one job with its own columns; within a job the rows of a
    file go to a folder of their own, which is then renamed to the target. An empty file becomes nothing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to_path = jvm.org.apache.hadoop.fs.Path
    fs = to_path(dst).getFileSystem(conf)
    groups: dict[str, list[tuple[str, str]]] = {}
    for path, name, header in _csv_files(spark, src):
        if header:
            groups.setdefault(header, []).append((path, name))
    counts = None
    for k, files in enumerate(groups.values()):
        names = spark.createDataFrame([(p.split("://")[-1].split(":", 1)[-1].lstrip("/"), n) for p, n in files],
                                      "__key string, __file string")
        rows = spark.read.option("header", True).csv([p for p, _ in files])
        key = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9+.-]+:/*", "")
        rows = rows.withColumn("__key", F.url_decode(key)).join(F.broadcast(names), "__key").drop("__key")
        staging = f"{dst}/_staging-{k}"
        rows.write.mode("overwrite").partitionBy("__file").parquet(staging)
        for status in fs.listStatus(to_path(staging)):
            folder = status.getPath().getName()
            if folder.startswith("__file="):
                name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(folder[len("__file="):])
                target = to_path(f"{dst}/{name}.parquet")
                fs.mkdirs(target.getParent())
                fs.delete(target, True)
                fs.rename(status.getPath(), target)
        fs.delete(to_path(staging), True)
        per = rows.groupBy(F.col("__file").alias("name")).agg(F.count(F.lit(1)).alias("rows_in"))
        counts = per if counts is None else counts.unionByName(per)
    if counts is None:
        return spark.createDataFrame([], "name string, rows_in long, rows_out long")
    written = None
    for files in groups.values():
        for _, name in files:
            if fs.exists(to_path(f"{dst}/{name}.parquet")):
                out = spark.read.parquet(f"{dst}/{name}.parquet").agg(F.count(F.lit(1)).alias("rows_out")) \
                    .select(F.lit(name).alias("name"), "rows_out")
                written = out if written is None else written.unionByName(out)
    return counts.join(written, "name", "full_outer") if written is not None else counts.withColumn("rows_out", F.lit(0))


# A9 -----------------------------------------------------------------------------------------------
def lake_name(path: str) -> str:
    """Lake targets are always parquet: a ``.csv`` name is normalized to ``.parquet``."""
    return path[: -len(".csv")] + ".parquet" if path.lower().endswith(".csv") else path


def write_tabular(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Parquet or CSV (with header) by suffix."""
    if path.lower().endswith(".csv"):
        df.write.mode(mode).option("header", True).csv(path)
    else:
        df.write.mode(mode).parquet(path)
    return path


# A10 ----------------------------------------------------------------------------------------------
def write_partitioned(df: DataFrame, path: str, cols: Sequence[str] = ("YEAR", "MONTH"),
                      mode: str = "replace_matching") -> DataFrame:
    """Snappy parquet in hive layout. Partition columns are lower-cased (only those); a missing partition column is an
    error. ``replace_matching`` rewrites only the partitions present in ``df`` (dynamic overwrite); ``append`` keeps
    everything. The rebalance hint brings the rows of a partition together so few files are written, and adaptive
    execution splits a partition that is too large for one task."""
    lower = {c: c.lower() for c in cols}
    missing = [c for c in cols if c not in df.columns and c.lower() not in df.columns]
    if missing:
        raise ValueError(f"the rows have no column {' and no '.join(missing)} to partition by")
    out = df.select(*[F.col(c).alias(lower[c]) if c in lower else F.col(c) for c in df.columns])
    parts = [lower[c] for c in cols]
    w = out.hint("rebalance", *parts).write.option("compression", "snappy").partitionBy(*parts)
    if mode == "append":
        w.mode("append").parquet(path)
    else:
        w.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return out


# A11 ----------------------------------------------------------------------------------------------
def replace_dataset(df: DataFrame, path: str) -> str:
    """Empty the target folder and write one dataset (static overwrite)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    return path


# A12 ----------------------------------------------------------------------------------------------
def table_ddl(database: str, name: str, columns: Sequence[tuple[str, str]], location: str,
              partitions: Sequence[tuple[str, str]] = (), fmt: str = "parquet") -> str:
    cols = ", ".join(f"`{c}` {t}" for c, t in columns)
    pcols = ", ".join(f"`{c}` {t}" for c, t in partitions)
    pnames = ", ".join(f"`{c}`" for c, _ in partitions)
    part = f" PARTITIONED BY ({pnames})" if partitions else ""
    opts = " OPTIONS (header 'true')" if fmt == "csv" else ""
    return (f"CREATE TABLE IF NOT EXISTS `{database}`.`{name}` ({cols}{', ' + pcols if pcols else ''}) "
            f"USING {fmt}{opts}{part} LOCATION '{location}'")


def create_tables(spark: SparkSession, database: str, defs: Sequence[dict], drop: bool = False,
                  dry_run: bool = False, location: str | None = None) -> DataFrame:
    """Create the database (at ``location`` if given) and one external table per definition (name, columns, location, partitions, format).
    ``drop`` drops first; ``dry_run`` returns the statements without running them. Result: (statement) rows."""
    at = f" LOCATION '{location}'" if location else ""
    stmts = [f"CREATE DATABASE IF NOT EXISTS `{database}`{at}"]
    for d in defs:
        if drop:
            stmts.append(f"DROP TABLE IF EXISTS `{database}`.`{d['name']}`")
        stmts.append(table_ddl(database, d["name"], d["columns"], d["location"], d.get("partitions", ()),
                               d.get("format", "parquet")))
    if not dry_run:
        for s in stmts:
            spark.sql(s)
    return spark.createDataFrame([(s,) for s in stmts], "statement string")


STATEMENT, REGISTRARS = 500, 8  # partitions of a statement, statements at a time


# A13 ----------------------------------------------------------------------------------------------
def sync_partitions(spark: SparkSession, table: str, df: DataFrame | None = None,
                    cols: Sequence[str] = ("year", "month")) -> DataFrame:
    """Registers what is missing: all partitions found under the table location, or the (year, month) pairs present in
    ``df`` that the catalog does not list (an anti-join with its own list). Statements name ``STATEMENT`` partitions each and
    are sent by several threads; new partitions are streamed to them, never held at once. Returns the partitions added
    (``df`` given) or all that are registered."""
    if df is None:
        spark.sql(f"MSCK REPAIR TABLE {table}")
        return spark.sql(f"SHOW PARTITIONS {table}")
    known = spark.sql(f"SHOW PARTITIONS {table}")
    name = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c).cast("int").cast("string")) for c in cols])
    pairs = df.where(F.col(cols[0]).isNotNull() & F.col(cols[1]).isNotNull()).select(name.alias("partition")).distinct()
    new = cut_lineage(pairs.join(known, "partition", "left_anti"))

    def register(batch: list[str]) -> None:
        parts = " ".join(f"PARTITION ({p.replace('/', ', ')})" for p in batch)
        spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {parts}")
    names = (r["partition"] for r in new.toLocalIterator())
    with ThreadPoolExecutor(REGISTRARS) as pool:
        waiting = []
        while batch := list(islice(names, STATEMENT)):
            waiting.append(pool.submit(register, batch))
            if len(waiting) > 2 * REGISTRARS:
                waiting.pop(0).result()
        for done in waiting:
            done.result()
    return new


def publish(df: DataFrame, path: str, table: str | None, run: str, cols: Sequence[str] = ("year", "month"),
            after: Callable[[str], None] = lambda step: None) -> DataFrame:
    """Puts the partitions of ``df`` in the place of the table's, in steps that can be repeated after a crash anywhere:

    stage     write ``df`` beside the table, in a folder named by ``run``; a staging that was committed is taken as it is
    check     the staged rows are counted per partition; without rows nothing is published
    swap      dynamic overwrite of the staged partitions only: Spark commits them when all are written
    register  the catalog gets the partitions that it lacks (A13)
    clear     the staging goes, last

    ``run`` names the content: another content needs another name. ``after`` is called with each step's name when it is
    done. Returns (partition columns, n) of what was published."""
    spark = df.sparkSession
    staging = f"{path.rstrip('/')}__staging/{run}"
    if not _fs_exists(spark, f"{staging}/_SUCCESS"):
        df.write.mode("overwrite").parquet(staging)
    after("stage")
    staged = spark.read.parquet(staging)
    counts = cut_lineage(staged.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")))
    if counts.isEmpty():
        raise ValueError(f"run {run} has no rows")
    if not counts.where(" OR ".join(f"{c} IS NULL" for c in cols)).isEmpty():
        raise ValueError(f"run {run} has rows without {' or '.join(cols)}")
    after("check")
    write_partitioned(staged, path, cols)
    after("swap")
    if table:
        if not spark.catalog.tableExists(table):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in staged.schema)
            spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet PARTITIONED BY ({', '.join(cols)}) LOCATION '{path}'")
        sync_partitions(spark, table, counts, cols)
        spark.sql(f"REFRESH TABLE {table}")
    after("register")
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    after("clear")
    return counts


# A15 ----------------------------------------------------------------------------------------------
def infer_numeric_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A text column becomes numeric (double) only if every non-null value converts. One aggregate decides all
    columns; the result is the same rows with the convertible columns cast."""
    cand = [c for c, t in df.dtypes if t == "string" and (columns is None or c in columns)]
    if not cand:
        return df
    stats = df.agg(*[(F.count(c) == F.count(X.text_to_double(F.col(c)))).alias(c) for c in cand]).first()
    conv = [c for c in cand if stats[c]]
    return df.withColumns({c: X.text_to_double(F.col(c)) for c in conv}) if conv else df


def numeric_convertible(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, convertible) for each text column: the decision A15 takes, as a DataFrame."""
    cand = [c for c, t in df.dtypes if t == "string" and (columns is None or c in columns)]
    agg = df.agg(*[(F.count(c) == F.count(X.text_to_double(F.col(c)))).alias(c) for c in cand])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("convertible"))
                                         for c in cand])))


# A16 ----------------------------------------------------------------------------------------------
def run_metadata(spark: SparkSession, features: dict, metrics: dict, rows: dict, threshold: float,
                 generated_at: str) -> DataFrame:
    """One-row record of a training run: features, metrics, row counts, threshold, timestamp."""
    import json
    return spark.createDataFrame([(json.dumps(features, sort_keys=True), json.dumps(metrics, sort_keys=True),
                                   json.dumps(rows, sort_keys=True), float(threshold), generated_at)],
                                 "features string, metrics string, rows string, threshold double, generated_at string")


def write_run_metadata(meta: DataFrame, path: str) -> str:
    meta.coalesce(1).write.mode("overwrite").json(path)
    return path
