"""Properties that matter at scale: skewed keys, ties, nulls, lossless candidate joins, plans."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txnwatch.functions.similarity import jaro_winkler_block
from txnwatch.operators import dedup, ranking, rolling, sanctions, trace
from txnwatch.operators import normalize as norm
from txnwatch.plans.mapping import table

T0 = pd.Timestamp("2024-01-01")


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows on one key, most of them in one hour and many at one instant; null keys and values."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        key = "HOT" if hot else (None if i % 50 == 1 else f"K{rng.randrange(40)}")
        second = rng.choice([0, 0, rng.randrange(3600)]) if hot and i % 2 else rng.randrange(5 * 86_400)
        party = None if i % 17 == 0 else f"P{rng.randrange(9)}"
        rows.append((i, key, (T0 + pd.Timedelta(seconds=second)).to_pydatetime(), float(rng.randrange(1, 999)), party))
    return spark.createDataFrame(rows, "id int, k string, ts timestamp, amount double, party string").cache()


def test_rolling_equals_brute_force(spark, skewed):
    wins = {"1h": 3600, "24h": 86_400}
    got = rolling.rolling_features(
        skewed, "k", "ts", wins, sums={"total": F.col("amount").cast("decimal(18,2)")}, maxes={"top": F.col("amount")},
        distinct=("parties", F.col("party")), count="n").toPandas()
    assert sorted(got["id"]) == list(range(3000))
    t = got["ts"].to_numpy("datetime64[us]").astype("int64")
    for label, seconds in wins.items():
        for key, part in got.groupby("k", dropna=False):
            at = t[part.index]
            inside = (at[None, :] <= at[:, None]) & (at[None, :] > at[:, None] - seconds * 1_000_000)
            amounts, party = part["amount"].to_numpy(), part["party"].to_numpy(object)
            assert (inside.sum(1) == part[f"n_{label}"]).all(), key
            assert np.allclose((inside * amounts).sum(1), part[f"total_{label}"].astype(float))
            assert np.allclose(np.where(inside, amounts, 0).max(1), part[f"top_{label}"])
            parties = [len({p for p in party[m] if p is not None}) for m in inside]
            assert parties == part[f"parties_{label}"].tolist(), key


@pytest.mark.parametrize("grain", [600, 1800])
def test_rolling_does_not_depend_on_the_grain(spark, skewed, grain):
    def run(g):
        out = rolling.rolling_features(skewed, "k", "ts", {"1h": 3600}, maxes={"top": F.col("amount")},
                                       distinct=("parties", F.col("party")), count="n", grain=g)
        return sorted((r.id, r.n_1h, r.top_1h, r.parties_1h) for r in out.collect())

    assert run(grain) == run(3600)


def test_rows_without_time_keep_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", T0.to_pydatetime())], "k string, ts timestamp")
    got = sorted((r.ts is None, r.txn_count_1h) for r in rolling.rolling_features(df, "k", "ts", {"1h": 3600}).collect())
    assert got == [(False, 1), (True, None)]


def test_row_numbers_without_a_global_task(spark, skewed):
    bucket = F.date_trunc("hour", "ts")
    want = skewed.withColumn("r", F.row_number().over(Window.orderBy(bucket, "ts", "id"))).select("id", "r")
    got = ranking.scaled_row_number(skewed, [], [bucket], [F.col("ts"), F.col("id")]).select("id", F.col("rank").alias("r"))
    assert sorted(want.collect()) == sorted(got.collect())
    per_key = skewed.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(bucket, "ts", "id"))).select("id", "r")
    mine = ranking.scaled_row_number(skewed, ["k"], [bucket], [F.col("ts"), F.col("id")]).select("id", F.col("rank").alias("r"))
    assert sorted(per_key.collect()) == sorted(mine.collect())


def test_newest_n(spark, skewed):
    order = Window.partitionBy("k").orderBy(F.col("ts").desc(), F.col("id").desc())
    want = skewed.withColumn("r", F.row_number().over(order)).filter("r <= 25").select("id", "r")
    got = ranking.newest_n(skewed, "k", "ts", 25, "id").select("id", F.col("recency").alias("r"))
    assert sorted(want.collect()) == sorted(got.collect())


@pytest.mark.parametrize("block_spans", [1_000, 64, 5, 1])
def test_anchored_dedup_equals_fold(spark, block_spans):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        hot = i % 3 == 0
        at = T0 + pd.Timedelta(milliseconds=rng.randrange(3 * 86_400_000))
        rows.append((f"A{i:05}", f"T{i}", "HOT" if hot else (None if i % 40 == 1 else f"C{rng.randrange(30)}"), f"R{rng.randrange(2)}", rng.choice(["LOW", "HIGH", "CRITICAL"]),
                     "RULE", at.to_pydatetime()))
    alerts = spark.createDataFrame(rows, "alert_id string, txn_id string, customer_id string, rule_id string, severity string, alert_type string, created_at timestamp")
    want = set()
    by_key: dict = {}
    for r in rows:
        by_key.setdefault((r[2], r[3]), []).append(r)
    for key, group in by_key.items():
        group.sort(key=lambda r: (r[6], r[0]))
        first, n = None, 0
        for r in group:
            if first is None or (r[6] - first[6]) // dt.timedelta(minutes=1) > 30:
                if first is not None:
                    want.add((*key, first[0], n))
                first, n = r, 0
            n += 1
        want.add((*key, first[0], n))
    got = {(r.customer_id, r.rule_id, r.alert_id, r.alert_count) for r in dedup.dedup_anchored(alerts, block_spans=block_spans).collect()}
    assert got == want


def test_similar_pairs_lose_nothing(spark):
    """Candidate join against all pairs, on short adversarial words and on edited longer names."""
    rng = random.Random(11)
    words = {"".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 9))) for _ in range(700)}
    base = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randrange(6, 24))) for _ in range(60)]
    for b in base:
        c = list(b)
        for _ in range(rng.randrange(4)):
            i, j = rng.randrange(len(c)), rng.randrange(len(c))
            c[i], c[j] = c[j], c[i]
        words.add("".join(c))
    left, right = sorted(words)[::2], sorted(words)[1::2] + base
    right = sorted(set(right))
    a = spark.createDataFrame([(x,) for x in left], "norm string")
    b = spark.createDataFrame([(x,) for x in right], "norm string")
    for threshold in (0.85, 0.93):
        rows = sanctions.similar_pairs(a, b, threshold).collect()
        got = {(r.norm, r.listed_norm) for r in rows}
        assert len(rows) == len(got)
        x = pd.Series([p for p in left for _ in right])
        y = pd.Series([q for _ in left for q in right])
        score = jaro_winkler_block(x, y)
        assert got == {(p, q) for p, q, s in zip(x, y, score) if s >= threshold}


def test_close_spellings_lose_nothing(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(300)})
    left, right = words[::2], words[1::2]
    a = spark.createDataFrame([(x,) for x in left], "name string")
    b = spark.createDataFrame([(i, x) for i, x in enumerate(right)], "pos bigint, name string")
    got = {(r.name, r.matched_name, r.distance) for r in sanctions.close_spellings(a, b).collect()}

    def lev(s, t):
        row = list(range(len(t) + 1))
        for i, c in enumerate(s, 1):
            prev, row[0] = row[0], i
            for j, d in enumerate(t, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (c != d))
        return row[-1]

    assert got == {(x, y, lev(x, y)) for x in left for y in right if lev(x, y) <= 2}


def test_valid_and_rejects_make_the_input(spark, sf_dir):
    raw = table(spark, sf_dir, "raw_txn")
    for checks in (norm.basic_checks(), norm.strict_checks()):
        assert norm.valid_rows(raw, checks).count() + norm.rejected_rows(raw, checks).count() == raw.count()


def test_top_edges_are_cut_before_the_shuffle(spark, sf_dir):
    plan = trace.strongest_edges(table(spark, sf_dir, "txn"))._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    partial = next(i for i, line in enumerate(lines) if "WindowGroupLimit" in line and "Partial" in line)
    exchange = next(i for i, line in enumerate(lines) if "Exchange" in line)
    assert exchange < partial


def test_no_cartesian_products(spark, sf_dir):
    import __spark_entry__ as entry

    for name in ("rule_alerts", "sanction_alerts", "rules_effective_asof", "alert_timeline", "trace_forward", "reconciliation", "alert_queue", "daily_summary"):
        plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_screening_does_not_roll_again(spark, sf_dir):
    from txnwatch.plans import queries

    def windows(df):
        return df._jdf.queryExecution().optimizedPlan().toString().count("Window [")

    rows = queries._named(spark, sf_dir, queries._canonical(spark, sf_dir))
    screened = sanctions.screen(rows, table(spark, sf_dir, "sanction_name"), "counterparty_name")
    rolled = windows(queries.rule_alerts(spark, sf_dir))
    assert rolled > 0 and windows(queries.all_alerts(spark, sf_dir)) == rolled + windows(screened)


def test_workers_need_no_copy_of_the_package(tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    from txnwatch.streaming.state import RollingState

    path = tmp_path / "f.pickle"
    path.write_bytes(cloudpickle.dumps((jaro_winkler_block, dedup._block_exits(60), dedup._block_anchors(60), RollingState)))
    code = f"import pickle; f = pickle.load(open({str(path)!r}, 'rb')); import pandas as pd; print(f[0](pd.Series(['abc']), pd.Series(['abd']))[0] > 0.8)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin"}, check=False)
    assert done.stdout.strip() == "True", done.stderr


def test_equal_first_columns_use_many_ranges(spark):
    rows = spark.range(20_000).select(F.lit(1).alias("minute"), F.col("id"))
    got = ranking.range_row_number(rows, [F.col("minute"), F.col("id").desc()])
    assert got.filter(F.col("rank") != 20_000 - F.col("id")).count() == 0 and got.count() == 20_000
    assert rows.repartitionByRange(8, F.col("minute"), F.col("id").desc()).select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_timeline_lists_an_alert_in_two_slots(spark):
    from txnwatch.operators import alerts as al
    rng, hour = random.Random(2), 3_600_000_000
    begin = dt.datetime(1969, 12, 31, 12)
    times = [None, *(begin + dt.timedelta(hours=h) for h in range(0, 30, 2)), *(begin + dt.timedelta(microseconds=rng.randrange(30 * hour)) for _ in range(40))]
    at = [(f"A-{i}", rng.choice("PQ"), t) for i, t in enumerate(times)] + [("A-none", None, begin)]
    near = [(f"T-{i}", c, t + dt.timedelta(hours=h, microseconds=us) if t else None, 1.0) for i, (_, c, t) in enumerate(at) for h in (-2, 0, 2) for us in (-1, 0, 1)]
    alerts = spark.createDataFrame(at, "alert_id string, customer_id string, created_at timestamp_ntz")
    txn = spark.createDataFrame(near, "txn_id string, customer_id string, ts timestamp_ntz, amount_usd double")
    found = sorted((r["alert_id"], r["txn_id"], r["ts"], r["offset_us"]) for r in al.alert_timeline(alerts, txn, 2).collect())
    expected = sorted((a, x, t, (t - c) // dt.timedelta(microseconds=1)) for a, p, c in at for x, q, t, _ in near if p and p == q and c and t and abs(t - c) <= dt.timedelta(hours=2))
    assert expected and found == expected
    slots = al.reached_slots(F.unix_micros(F.col("created_at").cast("timestamp")), 2 * hour, 4 * hour)
    assert {r[0] for r in alerts.where("created_at IS NOT NULL").select(F.size(slots)).collect()} == {2}
