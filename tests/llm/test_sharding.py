import random
import string

import pytest
from pyspark.sql import functions as F

from quernstone.llm.sharding import CommitConflict, ShardStore, shard, shard_report
from tests.llm.helpers import DOCS, docs_of


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def test_arrivals_are_merged_to_target_size(spark, root, tmp_path):
    store = ShardStore(spark, root, target_bytes=60_000)
    parts = [docs_of(spark, [f"{k} {i} " + "xyzzy" * 20 for i in range(400)]).repartition(9) for k in range(3)]
    for p in parts:
        store.append(p)
    before = store.manifest().collect()
    assert store.version() == 3 and len(before) == 27 and sum(r["n_rows"] for r in before) == 1200
    version = store.compact(parts[0].schema)
    after = store.manifest().collect()
    assert version > 3 and len(after) < 8 and sum(r["n_rows"] for r in after) == 1200
    assert store.plan(store.manifest()).count() == 0
    old = store.read(parts[0].schema, 3)
    want = sorted(tuple(r) for p in parts for r in p.collect())
    for rows in (old, store.read(parts[0].schema)):
        assert sorted(tuple(r)[:5] for r in rows.collect()) == want
    store.vacuum()
    assert len(list((tmp_path / "store" / "data").iterdir())) > 1  # all steps are young
    store.vacuum(retention=0)
    assert sorted(tuple(r)[:5] for r in store.read(parts[0].schema).collect()) == want
    assert {p.name for p in (tmp_path / "store" / "data").iterdir()} == {r["step"] for r in store.manifest().collect()}


def test_full_shards_are_left_alone(spark, root):
    store = ShardStore(spark, root, target_bytes=4000, min_runs=2)
    big = docs_of(spark, ["".join(random.Random(i).choices(string.printable, k=3000)) for i in range(30)]).repartition(3)
    store.append(big)
    first = {r["shard"] for r in store.manifest().collect()}
    store.append(docs_of(spark, ["tiny"] * 4).repartition(4))
    store.compact(big.schema)
    assert first <= {r["shard"] for r in store.manifest().collect()} and store.manifest().count() == 4


def test_second_writer_of_a_version_fails(spark, root):
    a = ShardStore(spark, root)
    a.append(docs_of(spark, ["one"]))
    base, live = a.version(), a.manifest()
    a.append(docs_of(spark, ["two"]))
    with pytest.raises(CommitConflict):
        a.commit(live, base)
    assert a.version() == 2 and a.manifest().count() == 2


def test_report_covers_every_row(spark):
    rows = [(None, None, None, None, None), (1, "", "x", None, 0), (1, "", "x", None, 0), (2, "long " * 100_000, None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"quern_shard": F.lit(1), "shard": F.lit("s"), "_metadata": F.lit(3), "step": F.lit(None).cast("int")})
    got = shard_report(df.repartition(3)).collect()
    assert sorted((r["doc_id"] for r in got), key=repr) == [1, 1, 2, None]
    assert len({(r["shard"], r["row_index"]) for r in got}) == 4


def test_empty_table(spark, root):
    store = shard(docs_of(spark, []), root)
    assert store.version() == 1 and store.manifest().count() == 0
    assert shard_report(docs_of(spark, [])).count() == 0


def test_vacuum_leaves_an_append_in_flight(spark, root):
    a = ShardStore(spark, root)
    a.append(docs_of(spark, ["one"]))
    base, step = a.version(), "arrival-inflight"
    rows = docs_of(spark, ["two"])
    rows.write.parquet(f"{root}/data/{step}")  # an append that has written and not committed yet
    ShardStore(spark, root).vacuum()
    a.commit(a.manifest(base).unionByName(a._written(step, rows.schema)), base)
    assert sorted(r["text"] for r in a.read(rows.schema).collect()) == ["one", "two"]


def test_plan_equals_a_plain_version(spark, root):
    """Lanes of one: shards of a tier in order of their names, cut where the running size passes a multiple of the target."""
    r = random.Random(2)
    store = ShardStore(spark, root, target_bytes=1000)
    live = [(f"s{i:03}", "step", r.choice((3, 10, 60, 200, 400, 700, 760, 2000)), 1) for i in range(80)]
    df = spark.createDataFrame(live, "shard string, step string, n_bytes long, n_rows long").withColumn("tier", store._tier(F.col("n_bytes")))
    tiers = {x["shard"]: x["tier"] for x in df.collect()}
    groups, upto = {}, {}
    for shard_, _, size, _ in live:
        if size < 750:
            upto[tiers[shard_]] = upto.get(tiers[shard_], 0) + size
            groups.setdefault((tiers[shard_], int((upto[tiers[shard_]] - size / 2) // 1000)), set()).add(shard_)
    got = {}
    for x in store.plan(df).collect():
        got.setdefault(x["merge"], set()).add(x["shard"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1) and len(got) > 3
    assert len(set(tiers.values())) > 3
