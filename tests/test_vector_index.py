import numpy as np
import pytest

from quernstone.operators import search, vector_index
from quernstone.storage import new_folder

VECTORS = "id long, vector array<float>"


def clustered(n, d=24, centres=20, seed=1):
    rng = np.random.default_rng(seed)
    mids = rng.normal(size=(centres, d))
    return (mids[rng.integers(0, centres, n)] + 0.35 * rng.normal(size=(n, d))).astype(np.float32)


def frame(spark, x, name="id"):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS.replace("id", name, 1))


def found(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 5)) for r in df.collect())


def test_recall_share_and_exact_search(spark):
    x = clustered(3000)
    rows = frame(spark, x).repartition(5)
    queries = rows.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    path = new_folder(spark, "ivf")
    vector_index.build(rows, path)
    want = found(search.dense_topk(queries, rows, 10))
    near = vector_index.search(spark, path, queries, 10)
    pairs = lambda rows: {(q, i) for q, _, i, _ in rows}
    assert len(pairs(found(near)) & pairs(want)) >= 0.9 * len(want)
    share = {r["query_id"]: r["read_share"] for r in near.collect()}
    assert len(share) == 60 and 0 < sum(share.values()) / 60 < 0.5
    exact = vector_index.search(spark, path, queries, 10, probes=1, exact=True)
    assert found(exact) == want and exact.agg({"read_share": "avg"}).first()[0] < 0.95
    assert found(vector_index.search(spark, path, queries, 10, exact=True, wave=13)) == want
    everything = vector_index.search(spark, path, queries, 10, probes=10_000)
    assert found(everything) == want and everything.agg({"read_share": "min"}).first()[0] == 1


def test_a_search_reads_only_the_folders_of_its_cells(spark):
    x = clustered(800)
    path = new_folder(spark, "ivf")
    vector_index.build(frame(spark, x), path, n_cells=16)
    lists = spark.read.parquet(f"{path}/lists")
    assert lists.count() == 800 and lists.select("cell").distinct().count() == 16
    plan = lists.where(lists.cell.isin([1, 2])).select("id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan
    manifest = spark.read.parquet(f"{path}/cells")
    assert manifest.agg({"rows": "sum"}).first()[0] == 800 and manifest.count() == 16


def test_hot_cell_zero_null_and_repeated_rows(spark):
    x = np.concatenate([np.tile(clustered(1), (300, 1)), clustered(100, seed=4), np.zeros((3, 24), np.float32)])
    rows = [(i % 390, v.tolist()) for i, v in enumerate(x)] + [(900, None)]
    rows = spark.createDataFrame(rows, VECTORS)
    queries = rows.where("id % 50 = 0 or id > 385").dropDuplicates(["id"]).withColumnRenamed("id", "query_id")
    path = new_folder(spark, "ivf")
    vector_index.build(rows, path)
    assert found(vector_index.search(spark, path, queries, 20, exact=True)) == found(search.dense_topk(queries, rows, 20))


def test_empty_and_unequal(spark):
    path = new_folder(spark, "ivf")
    vector_index.build(spark.createDataFrame([], VECTORS), path)
    assert vector_index.search(spark, path, frame(spark, clustered(3), "query_id"), 5).count() == 0
    path = new_folder(spark, "ivf")
    vector_index.build(frame(spark, clustered(30)), path)
    assert vector_index.search(spark, path, spark.createDataFrame([], VECTORS.replace("id", "query_id", 1)), 5).count() == 0
    ragged = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0])], VECTORS)
    with pytest.raises(Exception, match="numbers where"):
        vector_index.build(ragged, new_folder(spark, "ivf"))
    with pytest.raises(Exception, match="numbers where"):
        search.dense_topk(ragged.withColumnRenamed("id", "query_id").limit(1), ragged, 2).collect()
