import numpy as np

from quernstone.operators import postings, search
from quernstone.storage import new_folder

ROW = "id long, weights map<string,double>"


def rows_of(n, seed=2, signed=False):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        terms = rng.zipf(1.4, int(rng.integers(0, 30))) % 500
        w = rng.pareto(2, len(terms)) + 0.1
        out.append((i, {f"t{t}": float(x * (rng.choice([-1, 1]) if signed else 1)) for t, x in zip(terms, w, strict=True)}))
    return out


def found(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 5)) for r in df.collect())


def test_equals_the_full_scan_and_skips_blocks(spark):
    rows = spark.createDataFrame([*rows_of(600), (9000, None), (9001, {})], ROW).repartition(4)
    queries = rows.where("id % 25 = 0 or id >= 9000").withColumnRenamed("id", "query_id")
    path = new_folder(spark, "postings")
    postings.write(rows, path, tile_rows=16)
    want = found(search.sparse_topk(queries, rows, 5))
    assert found(postings.search(spark, path, queries, 5)) == want and len(want) > 80
    assert found(postings.search(spark, path, queries, 5, lead=1, wave_terms=100)) == want
    report = postings.skipped(spark, path, queries, 5, lead=2).collect()
    assert sum(r["blocks_read"] for r in report) < 0.8 * sum(r["blocks"] for r in report)
    assert all(r["postings_read"] <= r["postings"] for r in report)
    assert found(postings.search(spark, path, queries, 700)) == found(search.sparse_topk(queries, rows, 700))


def test_weights_of_either_sign_and_ties(spark):
    rows = spark.createDataFrame([*rows_of(200, 5, signed=True), *[(1000 + i, {"t1": 1.0, "t2": -1.0}) for i in range(40)]], ROW)
    queries = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    path = new_folder(spark, "postings")
    postings.write(rows, path, tile_rows=10)
    assert found(postings.search(spark, path, queries, 7)) == found(search.sparse_topk(queries, rows, 7))


def test_empty(spark):
    path = new_folder(spark, "postings")
    postings.write(spark.createDataFrame([], ROW), path)
    queries = spark.createDataFrame([(1, {"a": 1.0})], ROW.replace("id", "query_id", 1))
    assert postings.search(spark, path, queries, 3).count() == 0
    path = new_folder(spark, "postings")
    postings.write(spark.createDataFrame([(1, {"a": 1.0})], ROW), path)
    assert postings.search(spark, path, queries.limit(0), 3).count() == 0 and found(postings.search(spark, path, queries, 3)) == [(1, 1, 1, 1.0)]


def test_blocks_lie_in_the_order_of_terms(spark):
    path = new_folder(spark, "postings")
    postings.write(spark.createDataFrame(rows_of(300), ROW), path, tile_rows=50)
    held = spark.read.parquet(path)
    plan = held.where(held.term == "t1").select("n")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,t1)]" in plan
    parts = [[r["term"] for r in held.where(f"_metadata.file_name = '{f}'").collect()] for f in sorted(r[0] for r in held.select("_metadata.file_name").distinct().collect())]
    assert all(p == sorted(p) for p in parts)


def test_no_pair_of_a_query_and_a_row_is_shuffled(spark):
    rows = spark.createDataFrame(rows_of(600), ROW).repartition(4)
    path = new_folder(spark, "postings")
    postings.write(rows, path, tile_rows=16)
    assert {"query_id", "id"} <= set((made := postings.search(spark, path, rows.where("id % 25 = 0").withColumnRenamed("id", "query_id"), 5)).columns)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [query_id" not in plan and "Generate explode(postings" not in plan and "MapInArrow" in plan


def test_all_tasks_share_thresholds(spark):
    rows = spark.createDataFrame(rows_of(1200, 7), ROW).repartition(4)
    queries = rows.where("id % 40 = 0").withColumnRenamed("id", "query_id")
    path = new_folder(spark, "postings")
    postings.write(rows, path, tile_rows=8)
    keys = {"spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}  # about five tiles a task
    before = {key: spark.conf.get(key) for key in keys}
    try:
        for key, value in keys.items():
            spark.conf.set(key, value)
        got, report = found(postings.search(spark, path, queries, 3)), postings.skipped(spark, path, queries, 3).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == found(search.sparse_topk(queries, rows, 3))
    assert sum(r["blocks_read"] for r in report) < 0.4 * sum(r["blocks"] for r in report)


def test_weights_of_0_and_null_have_no_postings(spark):
    path = new_folder(spark, "postings")
    postings.write(spark.createDataFrame([(1, {"a": 0.0, "b": None, "c": 2.0}), (2, None), (3, {"a": 1.0})], ROW), path)
    assert sorted((r["term"], r["n"], r["ids"]) for r in spark.read.parquet(path).collect()) == [("a", 1, [3]), ("c", 1, [1])]
