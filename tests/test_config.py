import json

import pytest
from pyspark.sql import functions as F

from quernstone import config
from quernstone.functions.ids import relative_path
from quernstone.operators import indexing, quality, store
from quernstone.providers import RetrievalConfig
from quernstone.sources.files import kept_images


def test_settings_of_the_session(spark):
    prefix = "spark.quernstone.retrieval"
    assert config.from_session(spark, RetrievalConfig, prefix) == RetrievalConfig()
    given = {"dense_limit": "20", "route_minimum": "0.5", "sources": "a, b"}
    for k, v in given.items():
        spark.conf.set(f"{prefix}.{k}", v)
    assert config.from_session(spark, RetrievalConfig, prefix) == RetrievalConfig(dense_limit=20, route_minimum=0.5, sources=("a", "b"))
    spark.conf.set(f"{prefix}.dense_limit", "many")
    with pytest.raises(ValueError, match="dense_limit must be of type int"):
        config.from_session(spark, RetrievalConfig, prefix)
    spark.conf.set(f"{prefix}.dense_limits", "1")
    with pytest.raises(ValueError, match="has no dense_limits"):
        config.from_session(spark, RetrievalConfig, prefix)
    for k in [*given, "dense_limits"]:
        spark.conf.unset(f"{prefix}.{k}")


def test_groups():
    assert config.selected(["a", "b", "c"], only=["c", "a"], skip=["a"]) == ["c"] and config.selected(["a", "b"]) == ["a", "b"]
    with pytest.raises(ValueError, match="named x"):
        config.selected(["a"], skip=["x"])


def test_tables_are_made_and_verified(spark, tmp_path):
    spark.sql(f"CREATE DATABASE IF NOT EXISTS quern_test LOCATION 'file://{tmp_path}/db'")
    tables = {"chunks": "chunk_id string, vector array<float>", "documents": "document_id string, status string"}
    try:
        assert config.verify_tables(spark, tables, "quern_test") == {"chunks": ["no such table"], "documents": ["no such table"]}
        assert config.create_tables(spark, tables, "quern_test") == ["chunks", "documents"] and config.create_tables(spark, tables, "quern_test") == []
        assert config.verify_tables(spark, tables, "quern_test") == {}
        assert config.verify_tables(spark, {"chunks": "chunk_id long, extra int"}, "quern_test") == {"chunks": ["chunk_id: string, not bigint", "extra: missing, not int"]}
    finally:
        spark.sql("DROP DATABASE quern_test CASCADE")
    with pytest.raises(ValueError):
        config.create_tables(spark, {})


def test_kept_images_and_records(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"filename": f, "decision": d}) for f, d in (("a", "keep"), ("b", "reject"), ("c", "keep"), ("d", None))))
    assert sorted(r["filename"] for r in kept_images(spark, f"{tmp_path}/m.jsonl", "filename string, decision string").collect()) == ["a", "c"]
    rows = spark.createDataFrame([("x", 1, "d1"), ("y", 2, "d2")], "Name string, n int, document_id string")
    for _ in range(2):
        store.append_records(rows, ["name", "missing", "document_id"], f"{tmp_path}/records", "document_id")
    got = spark.read.parquet(f"{tmp_path}/records")
    assert got.count() == 4 and set(got.columns) == {"name", "missing", "document_id"} and got.where("name = 'x' and document_id = 'd1' and missing is null").count() == 2


def test_stamps(spark):
    old = spark.createDataFrame([("a", 1, "2020-01-01 00:00:00", "2020-01-01 00:00:00")], "k string, v int, c string, u string").select("k", "v", F.to_timestamp("c").alias("created_at"), F.to_timestamp("u").alias("updated_at"))
    new = spark.createDataFrame([("a", 2), ("b", 3)], "k string, v int")
    got = {r["k"]: r for r in store.upsert_stamped(old, new, ["k"], now=F.to_timestamp(F.lit("2024-05-05 00:00:00"))).collect()}
    assert (got["a"]["v"], got["a"]["created_at"].year, got["a"]["updated_at"].year) == (2, 2020, 2024) and got["b"]["created_at"].year == got["b"]["updated_at"].year == 2024


def test_small_ones(spark):
    paths = spark.createDataFrame([("/r/a/b.png",), ("\\r\\a\\c.png",), ("/other/x",), (None,)], "p string")
    assert [r[0] for r in paths.select(relative_path(F.col("p"), "/r")).collect()] == ["a/b.png", "a/c.png", None, None]
    rows = spark.createDataFrame([("b",), ("a",), ("a",), (None,)], "chunk_id string")
    assert sorted(r[0] for r in indexing.current_ids(rows).collect()) == ["a", "b"]
    assert [r[0] for r in quality.first_rows(rows.where("chunk_id is not null").distinct(), "chunk_id", 1).collect()] == ["a"] and quality.first_rows(rows, "chunk_id", None).count() == 4
