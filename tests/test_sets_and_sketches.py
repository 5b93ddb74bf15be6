"""Mergeable distinct counts, the name set under changes, and rules that change between two micro-batches."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from txnwatch.operators import normalize as norm
from txnwatch.operators import packs, rolling, rules, sanctions
from txnwatch.plans.mapping import table
from txnwatch.streaming import jobs


def test_merged_sketches_stay_within_their_bound(spark):
    rows = spark.range(200_000).select(
        F.concat(F.lit("C"), F.col("id") % 4).alias("customer_id"), F.timestamp_seconds(1_704_067_200 + F.col("id") * 7 % 86_400).alias("ts"),
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("P"), F.col("id") % 90)).when(F.col("id") % 4 == 1, F.concat(F.lit("P"), F.col("id"))).when(
            F.col("id") % 4 == 2, F.concat(F.lit("P"), F.col("id") % 9_001)).alias("counterparty_id"), F.lit(1.5).cast("decimal(18,2)").alias("amount_usd"))
    got = {r.customer_id: r for r in rolling.merged_windows(rolling.hourly_sketches(rows)).collect()}
    want = {r.customer_id: r for r in rolling.tumbling_stats(rows, "24 hours").collect()}
    bound = 3 * 1.04 / 2 ** (rolling.SKETCH_LOG2 / 2)
    for key, w in want.items():
        g = got[key]
        assert (g.txn_count, g.total_amount, g.max_amount, g.window_start) == (w.txn_count, w.total_amount, w.max_amount, w.window_start)
        assert abs(g.unique_counterparties - w.unique_counterparties) <= bound * w.unique_counterparties
    assert got["C0"].unique_counterparties == want["C0"].unique_counterparties == 45 and got["C3"].unique_counterparties == 0
    direct = {r.customer_id: r.n for r in rows.groupBy("customer_id").agg(F.hll_sketch_estimate(F.hll_sketch_agg("counterparty_id", F.lit(rolling.SKETCH_LOG2))).alias("n")).collect()}
    assert abs(direct["C1"] - got["C1"].unique_counterparties) <= 2 * bound * direct["C1"]


def plain_bits(df):
    return {(r.list_source, r.bucket): bytes(r.bits) for r in df.collect()}


def test_a_changed_set_equals_one_built_anew(spark):
    rng = random.Random(4)

    def name(i):
        return rng.choice(["{} Trading Co", "{}  trading CO.", "Ali {}", "{}"]).format(f"n{i}")
    listed = [(name(rng.randrange(60)), rng.choice(["A", "B"])) for _ in range(80)] + [(None, "A"), ("!!", "B"), ("Мир", "A")]
    frame = spark.createDataFrame(listed, "name string, list_source string")
    names = sanctions.name_set(frame)
    bits = sanctions.set_bits(names)
    held = {(r.list_source, r.norm) for r in names.collect()}
    for step in range(3):
        changes = [(name(rng.randrange(60)), rng.choice(["A", "B", "C"]), rng.choice(["ADD", "REMOVE"]), i) for i in range(25)]
        given = spark.createDataFrame(changes, "name string, list_source string, op string, seq int")
        keyed = {(r.list_source, r.norm, r.seq): r.op for r in given.select("*", sanctions.match_key(F.col("name")).alias("norm")).collect()}
        for source, key, seq in sorted(keyed, key=lambda k: k[2]):
            (held.add if keyed[source, key, seq] == "ADD" else held.discard)((source, key))
        names, bits = sanctions.change_set(names, bits, given)
        names, bits = (spark.createDataFrame(d.collect(), d.schema) for d in (names, bits))
        assert {(r.list_source, r.norm) for r in names.collect()} == held, step
        assert plain_bits(bits) == plain_bits(sanctions.set_bits(names))
    probes = [(n, i) for i, n in enumerate([n for n, _ in listed] + [f"n{i}" for i in range(60)] + ["nobody", "", None])]
    frame = spark.createDataFrame(probes, "name string, i int")
    found = {r.i for r in sanctions.set_members(frame, names, bits).collect()}
    known = {n for _, n in held}
    assert found == {r.i for r in frame.select("i", sanctions.match_key(F.col("name")).alias("norm")).collect() if r.norm in known}
    assert sanctions.set_members(frame, names.limit(0), bits.limit(0)).count() == 0


def test_a_rule_changes_between_two_batches(spark, sf_dir, tmp_path):
    txn = table(spark, sf_dir, "txn").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    txn.filter("event_id % 2 = 0").coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    def run(limit):
        pack = packs.stricter_pack("SAR-003", "amount_usd", limit)
        rules.rule_frame(spark, [r for r in pack if r["rule_id"] == "SAR-003"]).coalesce(1).write.mode("overwrite").json(str(tmp_path / "rules"))
        jobs.detect_job(spark, norm.normalize(stream), str(tmp_path / "rules"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    run(3000)
    txn.filter("event_id % 2 = 1").coalesce(1).write.mode("append").parquet(path)
    run(9000)
    found = {r[0] for r in spark.read.parquet(str(tmp_path / "out")).filter("rule_id = 'SAR-003'").select("txn_id").collect()}
    risky = norm.normalize(txn).filter(F.col("country_dst").isin(packs.HIGH_RISK_COUNTRIES) & (F.col("route_tag") == "MAIN"))
    want = {r[0] for r in risky.filter("amount_usd >= CASE event_id % 2 WHEN 0 THEN 3000 ELSE 9000 END").select("txn_id").collect()}
    assert found == want and len({r[0] for r in risky.filter("amount_usd >= 3000").select("txn_id").collect()}) > len(want)
