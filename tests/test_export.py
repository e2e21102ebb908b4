import json
import os

import numpy as np
import pytest

from quernstone.sources.export import IDS, LINES, MATRIX, VECTORS, export, problems


def vectors(spark, n, d=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(f"c{i * 7919 % n:05d}é", [float(np.float32(x)) for x in rng.normal(size=d)], [i, i + 1], [0.5, float(i)]) for i in range(n)]
    return rows, spark.createDataFrame(rows, VECTORS).repartition(6)


def test_files_agree_with_the_rows_and_with_each_other(spark, tmp_path):
    rows, df = vectors(spark, 700)
    out = f"{tmp_path}/export"
    manifest = export(df, f"file://{out}", 8, "m", "s")
    want = sorted(rows)
    matrix = np.load(f"{out}/{MATRIX}", mmap_mode="r")
    assert matrix.shape == (700, 8) and matrix.dtype == np.float32 and np.array_equal(matrix, np.array([r[1] for r in want], np.float32))
    lines = [json.loads(x) for x in open(f"{out}/{LINES}", encoding="utf-8")]
    assert [(x["chunk_id"], x["indices"], x["values"]) for x in lines] == [(r[0], r[2], r[3]) for r in want] and lines[0]["model"] == "s"
    ids = spark.read.parquet(f"file://{out}/{IDS}").orderBy("row_index").collect()
    assert [(r["row_index"], r["chunk_id"]) for r in ids] == [(i, r[0]) for i, r in enumerate(want)]
    assert json.load(open(f"{out}/manifest.json")) == manifest and manifest["rows"] == 700
    assert os.listdir(tmp_path) == ["export"]
    with pytest.raises(FileExistsError):
        export(df, out, 8, "m", "s")


def test_incomplete_rows_publish_nothing(spark, tmp_path):
    _, df = vectors(spark, 20)
    odd = spark.createDataFrame([("x", None, [1], [1.0]), ("y", [1.0] * 7, None, None), ("z", [1.0] * 8, [1, 2], [1.0]), ("c00000é", [1.0] * 8, [1], [1.0]), (None, [1.0] * 8, [1], [1.0])], VECTORS)
    found = problems(df.unionByName(odd), 8)
    assert found == {"without an id": 1, "without a dense vector": 1, "with a dense vector of another size": 1, "without a sparse vector": 1, "with a sparse vector of unequal lists": 1, "with an id that comes again": 1}
    with pytest.raises(ValueError, match="1 rows without a dense vector"):
        export(df.unionByName(odd), f"{tmp_path}/export", 8, "m", "s")
    assert os.listdir(tmp_path) == [] and problems(df, 8) == {}


def test_empty(spark, tmp_path):
    export(spark.createDataFrame([], VECTORS), f"{tmp_path}/export", 4, "m", "s")
    assert np.load(f"{tmp_path}/export/{MATRIX}").shape == (0, 4) and os.path.getsize(f"{tmp_path}/export/{LINES}") == 0
    with pytest.raises(ValueError, match="no mounted folder"):
        export(spark.createDataFrame([], VECTORS), "hdfs://host/export", 4, "m", "s")
