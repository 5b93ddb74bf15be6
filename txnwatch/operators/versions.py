"""Rule versions in time: creation, deprecation, and the version in force at each transaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def active_versions(versions: DataFrame) -> DataFrame:
    """Active versions, newest first."""
    return versions.filter(F.col("status") == "ACTIVE").orderBy(F.col("effective_from").desc(), F.col("version_id").desc())


def effective_version(versions: DataFrame, at: Column) -> DataFrame:
    """The one active version in force at an instant."""
    return active_versions(versions.filter(F.col("effective_from") <= at)).limit(1)


def deprecate(versions: DataFrame, version_ids: DataFrame) -> DataFrame:
    gone = version_ids.select(F.col("version_id").alias("__gone")).distinct()
    status = F.when(F.col("__gone").isNotNull(), F.lit("DEPRECATED")).otherwise(F.col("status"))
    return versions.join(gone, F.col("version_id") == F.col("__gone"), "left").withColumn("status", status).drop("__gone")


def create_versions(versions: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Append versions as ACTIVE."""
    added = new.withColumns({"status": F.lit("ACTIVE"), "created_at": now})
    return versions.unionByName(added, allowMissingColumns=True)


def validity(events: list) -> list[tuple]:
    """Folds version events to (version_id, from, until): which version is in force when.

    Events (version_id, event, at, effective_from) create a version that takes effect at ``effective_from``, or deprecate
    one at ``at``; from then on the newest version that is left is in force again. Of versions that take effect at the
    same time the larger id wins. Versions are control data, written by people, and are folded by the driver; ``until``
    is None for the last interval, and times without any version in force are in no interval.
    """
    begin = {e["version_id"]: e["effective_from"] for e in events if e["event"] == "CREATE"}
    end: dict = {}
    for e in events:
        if e["event"] == "DEPRECATE":
            end[e["version_id"]] = min(e["at"], end.get(e["version_id"], e["at"]))
    cuts = sorted({*begin.values(), *(t for v, t in end.items() if v in begin)})
    found: list[tuple] = []
    for at, until in zip(cuts, [*cuts[1:], None]):
        live = [(t, v) for v, t in begin.items() if t <= at and not (v in end and end[v] <= at)]
        name = max(live)[1] if live else None
        if found and found[-1][0] == name and found[-1][2] == at:
            found[-1] = (name, found[-1][1], until)
        elif name is not None:
            found.append((name, at, until))
    return found


def with_effective_version(txn: DataFrame, versions: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds the ``version_id`` in force at each row's time (null before the first one).

    As-of join as an equi-join: each version's validity is listed by day, and a row looks up its own day
    (days after the last change share that day). A day holds its carried-in version and that day's changes,
    so the version side stays the size of the calendar whatever the number of transactions.
    """
    ordered = Window.orderBy("effective_from", "version_id")
    spans = versions.filter(F.col("status") == "ACTIVE").select(
        "version_id", "effective_from", F.lead("effective_from").over(ordered).alias("until"))
    by_day = spans.select(
        F.col("version_id").alias("__version"), F.col("effective_from").alias("__from"), F.col("until").alias("__until"),
        F.explode(F.sequence(F.to_date("effective_from"), F.to_date(F.coalesce("until", "effective_from")))).alias("__day"))
    last_day = spans.agg(F.max(F.to_date("effective_from"))).scalar()
    day = F.least(F.to_date(F.col(ts)), last_day)
    inside = (F.col(ts) >= F.col("__from")) & (F.col("__until").isNull() | (F.col(ts) < F.col("__until")))
    return (txn.join(by_day, (day == F.col("__day")) & inside, "left")
            .select(*txn.columns, F.col("__version").alias("version_id")))
