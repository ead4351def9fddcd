"""Joins by counted sizes: whatever way they take, their rows are those of the plain join."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import common


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("rows,hot_rows,counted", [(1000, 5, True), (2, 5, True), (2, 10**6, True), (2, 5, False)])
def test_every_way_gives_the_same(spark, monkeypatch, how, rows, hot_rows, counted):
    """Broadcast, hot keys dealt out, no hot key, and all keys dealt out; NULL keys, repeats on both sides, clashing names."""
    monkeypatch.setattr(common, "HOT_ROWS", hot_rows)
    rng = random.Random(7)
    keys = [None, *range(12)]
    left = [(rng.choice([0, 0, 0, *keys]), rng.choice(["a", None]), i, "s", 1) for i in range(200)]
    right = [(rng.choice(keys[:9]), rng.choice(["a", None, "b"]), i) for i in range(40)]
    a = spark.createDataFrame(left, "k int, j string, v int, _salt string, _hot int").repartition(3)
    b = spark.createDataFrame(right, "k int, j string, w int").repartition(2)
    got = common.join_sized(a, b, ["k", "j"], rows, how, counted=counted)
    want = []
    for x in left:
        hits = [y for y in right if y[:2] == x[:2]]
        if how == "left_semi" or how == "left_anti":
            want += [x] if bool(hits) == (how == "left_semi") else []
        else:
            want += [(*x, y[2]) for y in hits] or ([(*x, None)] if how == "left" else [])
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_only_hot_keys_are_copied(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    monkeypatch.setattr(common, "is_small", lambda df, rows: df.columns == ["k"])  # the list of hot keys only
    a = spark.range(1000).select(F.when(F.col("id") < 100, 7).otherwise(F.col("id")).cast("long").alias("k"), F.col("id").alias("v"))
    b = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    seen = []
    real = F.explode
    monkeypatch.setattr(common.F, "explode", lambda c: seen.append(c) or real(c))
    assert common.join_sized(a, b, ["k"], 1, counted=True).count() == 1000 and len(seen) == 1
    plan = common.join_sized(a.where("k <> 7"), b, ["k"], 1, counted=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "_salt" not in plan
