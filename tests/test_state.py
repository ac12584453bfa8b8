"""Result state as a stream: the last entry wins, late ones are refused, cells expire, and a restart goes on where it stopped."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gaugeworks.streaming import state

ENTRY = "project_id long, sample_id long, char_id long, seq long, ts timestamp, value decimal(28,12), attribute string"
START = dt.datetime(2024, 1, 1, 8)


def judged(value, attribute, char):
    if attribute:
        return "pass" if attribute == "ok" else "fail"
    if value is None:
        return "missing"
    return "not_evaluated" if char == 2 else "pass" if 10 <= value <= 60 else "fail"


def plain(rows, seen):
    """The rows of one batch, told one after the other."""
    out = []
    for p, s, c, seq, _, value, attribute in sorted(rows, key=lambda r: r[3]):
        last, told = seen.get((p, s, c), (None, None))
        is_ = judged(value, attribute, c)
        if last is not None and seq <= last:
            out.append((p, s, c, seq, told, is_, "refused"))
            continue
        if is_ != (told or "missing"):
            out.append((p, s, c, seq, told or "missing", is_, "changed"))
        seen[p, s, c] = (seq, is_)
    return out


@pytest.fixture(scope="module")
def limits(spark):
    return spark.createDataFrame([(p, c, None if c == 2 else Decimal(10), None if c == 2 else Decimal(60)) for p in range(3) for c in range(3)], "project_id long, char_id long, lower_limit decimal(28,12), upper_limit decimal(28,12)")


def run(spark, folder, limits, out, **options):
    stream = spark.readStream.schema(ENTRY).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/in")
    told = []

    def keep(batch, number):
        told.extend(tuple(r) for r in batch.collect())

    query = state.verdict_changes(stream, limits, **options).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/{out}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return told


def test_stream_restart_and_late_entries(spark, limits, tmp_path):
    for k, v in state.PROVIDER.items():
        spark.conf.set(k, v)
    rng = random.Random(1)
    batches = []
    for b in range(3):
        rows = []
        for k in range(40):
            seq = b * 100 + k if rng.random() < 0.85 else max(0, b * 100 + k - 130)
            value = rng.choice([None, Decimal(5), Decimal(10), Decimal(60), Decimal(61)])
            rows.append((rng.randrange(4), rng.randrange(2), rng.randrange(3), seq, START + dt.timedelta(minutes=b, seconds=k), value, rng.choice([None, None, None, "ok", "not_ok"])))
        batches.append(rows)
    seen, want, got = {}, [], []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, ENTRY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got += run(spark, tmp_path, limits, "checkpoint")  # each run is a restart from the checkpoint
        want += plain([r for r in rows if r[0] < 3], seen)  # project 3 has no characteristics
        assert sorted(got, key=str) == sorted(want, key=str), n
    assert {r[6] for r in want} == {"changed", "refused"}
    # told once more without stops, and against the batch's last verdicts
    assert sorted(run(spark, tmp_path, limits, "again"), key=str) == sorted(want, key=str)
    last = {}
    for r in got:
        if r[6] == "changed":
            last[r[:3]] = r[5]
    assert last == {k: v for k, (_, v) in seen.items() if k in last} and all(v == "missing" for k, (_, v) in seen.items() if k not in last)


def test_cells_expire(spark, limits, tmp_path):
    for k, v in state.PROVIDER.items():
        spark.conf.set(k, v)
    rows = [(1, 1, 1, 1, START, Decimal(20), None), (1, 2, 1, 2, START, Decimal(99), None), (1, 1, 1, 3, START + dt.timedelta(hours=5), Decimal(20), None), (1, 1, 1, 4, START + dt.timedelta(hours=6), Decimal(20), None)]
    told = []
    for r in rows:
        spark.createDataFrame([r], ENTRY).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        told += run(spark, tmp_path, limits, "checkpoint", expiry=7200.0)
    assert [r for r in told if r[1] == 2] == [(1, 2, 1, 2, "missing", "fail", "changed"), (1, 2, 1, 2, "fail", "missing", "expired")]
    assert (1, 1, 1, 1, "missing", "pass", "changed") in told


def test_odd_entries(spark, limits):
    for k, v in state.PROVIDER.items():
        spark.conf.set(k, v)
    none = spark.createDataFrame([], ENTRY)
    assert state.verdict_changes(none, limits).count() == 0
    rows = [(None, 1, 1, 1, START, None, None), (1, 1, 1, None, START, Decimal(5), None), (1, 1, 1, 2, None, Decimal(5), None), (1, 1, 1, 3, START, None, None), (1, 1, 1, 4, START, Decimal(5), None), (1, 1, 1, 4, START, Decimal(20), None)]
    df = spark.createDataFrame(rows, ENTRY).withColumn("verdict", F.lit("x")).withColumn("at", F.lit(0))
    got = {(r["seq"], r["status"]) for r in state.verdict_changes(df, limits).collect()}
    assert got == {(4, "changed"), (4, "refused")}
