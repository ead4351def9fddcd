"""Prefixes, long lists of terms, numbering without one task, and files without bytes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.functions import matching
from corpusloom.functions import text as tx
from corpusloom.operators import curate
from corpusloom.plans import flows
from corpusloom.sources import readers, sinks


@pytest.mark.parametrize("prefixes", [
    {"c4": ("a", "x"), "c44": ("b", "y")}, {"c44": ("b", "y"), "c4": ("a", "x")}, {"c44": ("b", "y"), "c": ("a", "x"), "c4431": ("d", "z"), "": ("rest", "w")}, {"zz": ("a", "x")},
])
def test_first_prefix_in_order(spark, prefixes):
    codes = [" C44.311 ", "c4", "C4.3", "i10", "c", "", None, "c44311", "C44"]
    rows = spark.createDataFrame(list(enumerate(codes)), "i int, codigo string")
    want = []
    for i, c in enumerate(codes):
        normal = None if c is None else c.strip().lower().replace(".", "")
        hit = next(((p, *v) for p, v in prefixes.items() if normal is not None and normal.startswith(p)), None)
        want += [(i, *hit)] if hit else []
    got = curate.prefix_join(rows, "codigo", prefixes)
    assert sorted((r.i, r.prefix, r.category, r.label) for r in got.collect()) == want
    table = spark.createDataFrame([(p, n, *v) for n, (p, v) in enumerate(prefixes.items()) if p], "prefix string, rank int, category string, label string")
    most = curate.prefix_match(rows.union(rows), "codigo", table).select("i", "prefix", "category", "label")
    some = {k: v for k, v in prefixes.items() if k}
    few = curate.prefix_join(rows, "codigo", some)
    assert sorted(map(tuple, most.collect())) == sorted(2 * [(r.i, r.prefix, r.category, r.label) for r in few.collect()])


def test_prefix_join_is_one_pass(spark):
    rows = spark.createDataFrame([("c44",)], "codigo string")
    plan = curate.prefix_join(rows, "codigo", config.CODE_PREFIXES)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Union" not in plan
    assert curate.prefix_match(rows, "codigo", spark.createDataFrame([], "prefix string, rank int")).count() == 0


def test_five_thousand_terms(spark, sf_dir):
    """As many substring tests would find, in a time that doesn't follow the number of terms."""
    rng = random.Random(8)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "ÉAU İstanbul")], "doc_id long, text string")).cache()
    pieces = [t[at : at + rng.randrange(4, 14)] for (t,) in docs.where("text <> ''").select("text").limit(50).collect() for at in [rng.randrange(max(1, len(t) - 14)) for _ in range(60)]]
    terms = ["".join(rng.choice("abcdefghij ") for _ in range(9)) for _ in range(3000)] + pieces
    low = {t.lower() for t in terms}
    assert len(low) > 4500
    want, every = {}, {}
    for r in docs.withColumn("low", F.lower("text")).collect():
        every[r.doc_id] = sorted(t for t in low if r.low and t in r.low)
        want[r.doc_id] = None if r.low is None else bool(every[r.doc_id])
    assert {r.doc_id: r.f for r in docs.select("doc_id", matching.contains_any(F.col("text"), terms).alias("f")).collect()} == want
    assert {r.doc_id: r.f for r in docs.select("doc_id", matching.terms_in(F.col("text"), terms).alias("f")).collect()} == every
    took = []
    for n in (100, 100, len(terms)):  # the first also starts the workers
        began = time.time()
        docs.agg(F.count_if(matching.contains_any(F.col("text"), terms[:n]))).collect()
        took.append(time.time() - began)
    assert took[2] < 10 * took[1] + 2  # fifty times the terms


def test_terms_at_the_edges(spark):
    rows = spark.createDataFrame([("abc",), ("",), (None,), ("xyz",)], "t string")
    many = [f"q{i}" for i in range(200)]
    ask = lambda terms: [r[0] for r in rows.select(matching.contains_any(F.col("t"), terms)).collect()]
    assert ask([*many, "BC"]) == [True, False, None, False] and ask(["BC"]) == [True, False, None, False]
    assert ask([*many, ""]) == [True, True, None, True]
    assert ask([]) == [False, False, False, False]
    assert matching.needed([*many, "ab", "xab", "ABC", "q1x"]) == sorted(["ab", *[f"q{i}" for i in range(10)]], key=lambda t: (len(t), t))
    assert [r[0] for r in rows.select(matching.terms_in(F.col("t"), ["", "b", "C"])).collect()] == [["b", "c"], [], [], []]
    assert [r[0] for r in rows.select(matching.terms_in(F.col("t"), [])).collect()] == [[], [], [], []]
    with pytest.raises(ValueError, match="more than 2 terms"):
        matching.terms_of(rows, "t", 2)
    assert matching.terms_of(rows, "t") == ["", "abc", "xyz"]


def test_chain_and_automaton_agree(spark, monkeypatch):
    rows = spark.createDataFrame([(t,) for t in ["Lesión PIGMENTADA", "queratosis actinica", "hemangiomas", "piel sana", "", "x" * 2000 + "melanoma"]], "t string")
    a = rows.select(matching.contains_any(F.col("t"), config.DOMAIN_TERMS)).collect()
    monkeypatch.setattr(matching, "CHAIN", 1)
    assert rows.select(matching.contains_any(F.col("t"), config.DOMAIN_TERMS)).collect() == a == rows.select(tx.contains_any(F.col("t"), config.DOMAIN_TERMS)).collect()


def test_numbering(spark):
    """Places by order over several tasks, ties in any order, NULL first, nothing for nothing."""
    rng = random.Random(9)
    rows = [(rng.randrange(300), f"s{i}", 1) for i in range(3000)] + [(None, "none", 2)] * 2
    df = spark.createDataFrame(rows, "k int, s string, _place int").repartition(6)
    with_conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, total = curate.numbered(df.drop("_place"), ["k"])
        out = sorted((r.number, r.k) for r in got.collect())
        plan = got._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_conf)
    assert total == len(rows) and [n for n, _ in out] == list(range(1, total + 1))
    assert [k for _, k in out] == [None, None] + sorted(r[0] for r in rows[:-2])
    assert "Window" not in plan and "SinglePartition" not in plan
    none, total = curate.numbered(df.limit(0), ["k"])
    assert total == 0 and none.count() == 0 and none.columns == ["k", "s", "_place", "number"]


def test_report_in_parts(spark, tmp_path):
    rows = spark.createDataFrame([(f"f{i:04}", "x", f"text {i}") for i in range(500)], "f string, l string, t string").repartition(5)
    blocks = curate.review_blocks(rows, "f", "l", "t")
    plan = blocks._jdf.queryExecution().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_report(blocks, str(tmp_path / "r"), "f")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "r").glob("part-*"))
    text = "".join(p.read_text() for p in parts)
    assert len(parts) > 2 and [line.split()[1] for line in text.split("\n") if line.startswith("CASO")] == [str(i) for i in range(1, 501)]


def test_files_without_bytes(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "empty ñ%20.txt").write_bytes(b"")
    (tmp_path / "full.txt").write_bytes(b"x\xffy\r\n")
    (tmp_path / "other.csv").write_bytes(b"")
    got = sorted(map(tuple, readers.read_documents(spark, str(tmp_path)).collect()))
    assert got == [("empty ñ%20.txt", "empty ñ%20", ""), ("full.txt", "full", "xy\n")]
    assert readers.list_files(spark, str(tmp_path), ".txt").count() == 2
    only = tmp_path / "a b"
    assert [tuple(r) for r in readers.read_documents(spark, str(only)).collect()] == [("empty ñ%20.txt", "empty ñ%20", "")]
    assert flows.filter_by_keyword(spark, str(only), "x").count() == 0


def test_scratch_is_removed(spark, tmp_path):
    from pathlib import Path

    kept = [sinks.scratch(spark, n) for n in ("a", "b")]
    spark.range(3).write.parquet(kept[0])
    sinks.remove(spark, kept[0])
    assert not Path(kept[0]).exists()
    spark.range(3).write.parquet(kept[1])
    assert sinks.remove_scratch(spark) >= 1 and not Path(kept[1]).exists() and sinks.remove_scratch(spark) == 0
