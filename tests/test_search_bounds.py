import numpy as np
import pyarrow as pa

from quernstone.operators import search


def _lists(rng, n, vocabulary, sizes, scale=1.0):
    terms = [rng.choice(vocabulary, rng.integers(*sizes), replace=False).tolist() for _ in range(n)]
    return terms, [(scale * np.log1p(rng.integers(1, 9, len(t)))).tolist() for t in terms]


def _matrix(terms, weights, vocabulary):
    place = {t: i for i, t in enumerate(vocabulary)}
    out = np.zeros((len(terms), len(vocabulary)))
    for i, (t, w) in enumerate(zip(terms, weights)):
        out[i, [place[x] for x in t]] = w
    return out


def _products(shared, terms, weights, floors):
    ends = np.concatenate(([0], np.cumsum([len(t) for t in terms])))
    return shared.products(ends, shared.codes(pa.array([x for t in terms for x in t])), np.array([x for w in weights for x in w]), floors)


def test_only_pairs_near_a_floor_are_summed():
    rng, vocabulary = np.random.default_rng(5), [f"t{i}" for i in range(900)]  # 12 subjects, each with words of its own
    deal = lambda n, sizes: [sum(x, []) for x in zip(*[_lists(rng, n, vocabulary[i : i + 75], sizes) for i in range(0, 900, 75)])]
    (q_terms, q_weights), (terms, weights) = deal(25, (1, 30)), deal(40, (0, 50))
    q_weights[7] = [-w for w in q_weights[7]]
    every = _matrix(q_terms, q_weights, vocabulary) @ _matrix(terms, weights, vocabulary).T
    floors = np.sort(every, axis=1)[:, -5].copy()
    floors[[3, 299]] = 0.01  # two queries that most rows reach
    found = pa.table({"query_id": np.arange(300), "terms": q_terms, "w": q_weights}).combine_chunks()
    shared, summed, seen = search.SharedTerms(found, 1024, floors), 0, np.full(every.shape, np.nan)
    for queries, rows, sums in _products(shared, terms, weights, floors):
        summed += sums.size
        seen[np.ix_(queries, rows)] = sums
    wanted = every >= floors[:, None]
    assert np.allclose(seen[wanted], every[wanted], atol=1e-9)
    assert np.isnan(seen).sum() + summed == every.size
    assert summed < every.size / 2  # one block: before, each row that reached a floor was summed with all queries


def test_heaviest_rows_go_first(spark, monkeypatch):
    rng, vocabulary = np.random.default_rng(6), [f"t{i}" for i in range(200)]
    monkeypatch.setattr(search, "LEAD_FROM", 100)
    terms, weights = _lists(rng, 400, vocabulary, (0, 60))
    terms[17], weights[17] = None, None
    rows = spark.createDataFrame([(i, None if t is None else dict(zip(t, w))) for i, (t, w) in enumerate(zip(terms, weights))], "id long, weights map<string,double>")
    q_terms, q_weights = _lists(rng, 30, vocabulary, (0, 20))
    queries = spark.createDataFrame([(i, dict(zip(t, w))) for i, (t, w) in enumerate(zip(q_terms, q_weights))], "query_id long, weights map<string,double>")
    every = _matrix(q_terms, q_weights, vocabulary) @ _matrix([t or [] for t in terms], [w or [] for w in weights], vocabulary).T
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in search.sparse_topk(queries, rows, 4).collect()}
    expected = {}
    for q, scores in enumerate(np.round(every, 6)):
        for rank, i in enumerate([i for i in np.lexsort((np.arange(len(scores)), -scores)) if scores[i] > 0][:4], 1):
            expected[q, rank] = (int(i), float(scores[i]))
    assert got == expected


def test_a_few_of_the_heaviest_rows_go_before_the_lead(spark, monkeypatch):
    monkeypatch.setattr(search, "LEAD_FROM", 100)
    monkeypatch.setattr(search, "LEAD_ROWS", 8)
    rows = spark.range(640).selectExpr("id", "CASE WHEN id % 9 > 0 THEN CAST(id AS double) END AS mass")
    leads, rest = search._leads(rows, "mass")
    top, lead, others = (sorted(r["id"] for r in df.collect()) for df in (*leads, rest))
    assert sorted([*top, *lead, *others]) == list(range(640))  # each row once, also those without a number
    assert 0 < len(top) <= 9 and min(top) > max(lead) and 8 <= len(lead) <= 25 and max(others) < 640 and not {i for i in (*top, *lead) if i % 9 == 0}


def test_a_wave_of_many_blocks_with_and_without_floors():
    rng, vocabulary = np.random.default_rng(8), [f"t{i}" for i in range(300)]
    q_terms, q_weights = _lists(rng, 70, vocabulary, (1, 60))
    terms, weights = _lists(rng, 90, vocabulary, (0, 120))
    every = _matrix(q_terms, q_weights, vocabulary) @ _matrix(terms, weights, vocabulary).T
    floors = np.sort(every, axis=1)[:, -3].copy()
    floors[::11], floors[5] = -np.inf, np.inf  # queries that any row reaches, and one that none does
    shared = search.SharedTerms(pa.table({"query_id": np.arange(70), "terms": q_terms, "w": q_weights}).combine_chunks(), 40, floors)
    seen = np.full(every.shape, np.nan)
    for queries, rows, sums in _products(shared, terms, weights, floors):
        seen[np.ix_(np.arange(70)[queries], rows)] = sums
    wanted = (every >= floors[:, None]) & (every > 0)
    assert np.allclose(seen[wanted], every[wanted], atol=1e-9)
