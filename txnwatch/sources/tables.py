"""Batch tables: dated partitions, JDBC tables, sample files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.operators.normalize import to_canonical
from txnwatch.schemas import DEAD_LETTER_TOPIC, TOPIC_BY_TXN_TYPE, TXN_JSON


def read_dated(spark: SparkSession, path: str, schema: T.StructType | None = None, on: str | None = None,
               since: str | None = None, before: str | None = None) -> DataFrame:
    """A table partitioned by ``dt``; the day limits prune partitions before any file is opened."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    dt = F.col("dt").cast("string")
    for value, test in ((on, dt == on), (since, dt >= since), (before, dt < before)):
        if value is not None:
            df = df.filter(test)
    return df


def latest_before(df: DataFrame, day: str) -> DataFrame:
    """The rows of the newest ``dt`` earlier than ``day``."""
    earlier = df.filter(F.col("dt") < day)
    return earlier.filter(F.col("dt") == earlier.agg(F.max("dt")).scalar())


def read_jdbc_day(spark: SparkSession, url: str, dbtable: str, day: str, properties: dict[str, str] | None = None,
                  split_on: str = "created_at", splits: int = 24) -> DataFrame:
    """One day of a JDBC table, read in time slices; the slice predicates run inside the database."""
    step = max(1, 86_400 // splits)
    moment = f"TIMESTAMP '{day} 00:00:00'"
    predicates = [f"{split_on} >= {moment} + INTERVAL '{s}' SECOND AND {split_on} < {moment} + INTERVAL '{min(s + step, 86_400)}' SECOND"
                  for s in range(0, 86_400, step)]
    return spark.read.jdbc(url, dbtable, predicates=predicates, properties=properties or {})


def read_sample_transactions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array file of feed messages as canonical rows, with the topic each would arrive on."""
    rows = to_canonical(spark.read.schema(TXN_JSON).option("multiLine", True).json(path))
    topic = F.coalesce(F.create_map(*[F.lit(x) for kv in TOPIC_BY_TXN_TYPE.items() for x in kv])[F.col("txn_type")], F.lit(DEAD_LETTER_TOPIC))
    return rows.withColumn("topic", topic)
