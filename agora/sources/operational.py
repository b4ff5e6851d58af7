"""Reading the tables straight from the operational database (SC1).

The application keeps its tables in a relational database. A Spark job can
read them in parallel over JDBC, split on the integer primary key, and cast
them to the fixed schemas. This needs a JDBC driver on the classpath and a
reachable database; neither exists in this repository's test environment,
so the tests use parquet snapshots (``Tables.from_parquet``) instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.sources.schemas import SCHEMAS
from agora.sources.tables import Tables


def read_table(spark: SparkSession, url: str, table: str, properties: dict[str, str],
               num_partitions: int, source_table: str | None = None) -> DataFrame:
    """One table over JDBC, range-partitioned on ``id`` into
    ``num_partitions`` reads (bounds from a pushed-down MIN/MAX query)."""
    name = source_table or ("conversations" if table == "mkt_conversations" else table)
    bounds = spark.read.jdbc(url, f"(SELECT MIN(id) AS lo, MAX(id) AS hi FROM {name}) b",
                             properties=properties).first()
    lo, hi = (bounds["lo"] or 0), (bounds["hi"] or 0)
    df = spark.read.jdbc(url, name, column="id", lowerBound=int(lo), upperBound=int(hi) + 1,
                         numPartitions=num_partitions, properties=properties)
    schema = SCHEMAS[table]
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_tables(spark: SparkSession, url: str, properties: dict[str, str], num_partitions: int) -> Tables:
    """All eight tables over JDBC (``password_hash`` is never selected)."""
    return Tables.from_frames({n: read_table(spark, url, n, properties, num_partitions) for n in SCHEMAS})
