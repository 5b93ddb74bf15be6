"""Stream readers: raw messages from any source, JSON to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_messages(spark: SparkSession, fmt: str, options: dict[str, str], path: str | None = None,
                  schema: T.StructType | None = None) -> DataFrame:
    """Raw messages. For ``kafka``, options name servers and topics; reading starts at the latest offsets
    and lost segments do not stop the query unless the options say otherwise."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        options = {"startingOffsets": "latest", "failOnDataLoss": "false", **options}
    if schema is not None:
        reader = reader.schema(schema)
    reader = reader.options(**options)
    return reader.load(path) if path else reader.load()


def parse_json(messages: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ("topic", "ingest_ts")) -> DataFrame:
    """``value`` to typed columns; unknown fields are dropped, missing ones null, the text kept as ``raw_value``."""
    renamed = messages.withColumnRenamed("timestamp", "ingest_ts") if "timestamp" in messages.columns else messages
    kept = [c for c in keep if c in renamed.columns]
    text = F.col("value").cast("string")
    return renamed.select(F.from_json(text, schema).alias("t"), *kept, text.alias("raw_value")).select("t.*", *kept, "raw_value")


def to_messages(df: DataFrame, key: str | None = None, topic: str | None = None) -> DataFrame:
    """Rows as JSON ``value`` messages, ready for a message sink."""
    out = [F.to_json(F.struct(*df.columns)).alias("value")]
    if key is not None:
        out.insert(0, F.col(key).cast("string").alias("key"))
    if topic is not None:
        out.append(F.lit(topic).alias("topic"))
    return df.select(*out)
