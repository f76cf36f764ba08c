"""skydelay: transport-delay analytics as Spark DataFrame / SQL / ML / Structured Streaming jobs.

Sub-packages
------------
sources    readers, writers and catalog helpers (parquet / CSV / JSON, partitioned lake layout)
operators  row, join, aggregate, ranking, text-to-route and chat operators (DataFrame -> DataFrame)
functions  Column -> Column expressions, the holiday calendar and SQL function registration
plans      the test-data views, batch jobs, Spark ML jobs and the registered queries
streaming  Structured Streaming jobs over live position feeds and chat sessions
"""

from skydelay.session import get_spark, checkpoint_dir  # noqa: F401
