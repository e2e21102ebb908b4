import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from quernstone.operators import search
from quernstone.plans import catalogue


def _tables(folder):
    """Parents whose first text is null, and vectors that no document has, nearest to all queries."""
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, 12)) for _ in range(200)]
    for i in (0, 5, 10, 11, 12, 13, 14, 100):
        texts[i] = None
    pq.write_table(pa.table({"doc_id": pa.array(range(200), pa.int64()), "text": texts, "source": ["s"] * 200}), f"{folder}/documents.parquet")
    ids = [*range(0, 200, 2), 201, 202, 203, 250]
    vectors = [(rng.normal(size=8) + (3 if i >= 200 else 1)).tolist() for i in ids]
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32()))}), f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def test_null_texts_and_vectors_without_documents(spark, tmp_path):
    con = _tables(tmp_path)
    got = catalogue.queries()["retrieved_parents"](spark, str(tmp_path))
    want = con.sql(catalogue.oracle_sql()["retrieved_parents"])
    plain = lambda rows: sorted(tuple(tuple(v) if isinstance(v, list) else round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)
    assert plain(tuple(r) for r in got.select(*want.columns).collect()) == plain(want.fetchall())


def test_texts_are_weighed_once(spark, tmp_path, monkeypatch):
    _tables(tmp_path)
    pinned, weighed = search.pinned, []

    def seen(rows, name):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        weighed.append("MapInArrow" in plan and "regexp_extract_all" in plan)
        return pinned(rows, name)

    monkeypatch.setattr(search, "pinned", seen)
    monkeypatch.setattr("quernstone.plans.retrieve.pinned", seen)
    made = catalogue.queries()["retrieved_parents"](spark, str(tmp_path))
    assert sum(weighed) == 2  # queries and rows
    assert "MapInArrow" not in made._jdf.queryExecution().optimizedPlan().toString()
