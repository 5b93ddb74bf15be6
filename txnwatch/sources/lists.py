"""Sanctions lists and rule packs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.schemas import RULE

def read_sanctions(spark: SparkSession, path: str, list_source: str) -> DataFrame:
    """A list file, one name per line, without blank and ``#`` lines; ``pos`` follows the file order.

    A missing file is an error: an empty list would pass every name unseen.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("name"), F.monotonically_increasing_id().alias("pos"))
    kept = lines.filter((F.col("name") != "") & ~F.col("name").startswith("#"))
    return kept.select("pos", "name", F.lit(list_source).alias("list_source"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """A rule pack, one JSON rule per line."""
    return spark.read.schema(RULE).json(path)


def rules_of_version(versions: DataFrame) -> DataFrame:
    """The rules stored as a JSON array in rule versions, one row per rule."""
    from pyspark.sql import types as T

    return versions.select("version_id", F.posexplode(F.from_json("rules_json", T.ArrayType(RULE))).alias("rule_pos", "r")).select(
        "version_id", "rule_pos", "r.*")
