import json
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.operators import chunking, elements, fusion, images, indexing, quality, search, store, survey
from quernstone.storage import numbered


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_search_is_exact_and_blocks_change_nothing(spark):
    r = np.random.default_rng(0)
    vectors = [(i, r.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)] + [(300, [0.0] * 4), (301, None)]
    rows = spark.createDataFrame(vectors, "id long, vector array<double>").repartition(5)
    queries = rows.where("id % 50 = 1").withColumnRenamed("id", "query_id")
    got = rows_of(search.dense_topk(queries, rows, 7))
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in vectors if v}
    want = []
    for q in range(1, 301, 50):
        best = sorted(((round(float(unit[q] @ v), 6) + 0.0, i) for i, v in unit.items()), key=lambda x: (-x[0], x[1]))[:7]
        want += [(q, i, s, k + 1) for k, (s, i) in enumerate(best)]
    assert got == sorted(want, key=repr) == rows_of(search.dense_topk(queries, rows, 7, block=2)) == rows_of(search.dense_topk(queries, rows, 7, wave=2))


def test_sparse_search(spark):
    texts = spark.createDataFrame([(i, w) for i, w in enumerate([["a", "a", "b"], ["b", "c"], ["d"], ["a"]])], "id long, terms array<string>")
    weights = search.sparse_vectors(texts.withColumn("text", F.lit("")).select("id", "terms"), F.col("terms"), 2)
    got = {(r["query_id"], r["id"]): r["score"] for r in search.sparse_topk(weights.withColumnRenamed("id", "query_id"), weights, 3).collect()}
    assert got[0, 3] == pytest.approx(math.log(3) * math.log(2), abs=1e-6) and (0, 2) not in got and got[1, 0] == pytest.approx(math.log(2) ** 2, abs=1e-6)


def test_term_searches_equal_brute_force(spark):
    r = np.random.default_rng(1)
    terms = {i: [f"t{t}" for t in np.unique(r.zipf(1.5, r.integers(1, 40)) % 60)] for i in range(200)} | {200: []}
    rows = spark.createDataFrame(list(terms.items()) + [(201, None)], "id long, terms array<string>").repartition(4)
    weighted = rows.withColumn("weights", F.map_from_entries(F.transform("terms", lambda t: F.struct(t, (F.length(t) * F.col("id") % 7 - 2).cast("double")))))
    w = lambda i, t: float(len(t) * i % 7 - 2)
    dot = lambda a, b: sum(w(a, t) * w(b, t) for t in set(terms[a]) & set(terms[b]))
    share = lambda a, b: round(len(set(terms[a]) & set(terms[b])) / max(1, min(len(terms[a]), len(terms[b]))), 6)
    for find, score, ids, least in ((search.sparse_topk, dot, range(200), 1e-9), (search.overlap_topk, share, range(201), 0)):
        want = []
        for q in (*range(0, 200, 10), 200):
            best = sorted((-score(q, i), i) for i in ids if score(q, i) >= least)[:5]
            want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(best)]
        given = weighted.where("id % 10 = 0").withColumnRenamed("id", "query_id")
        got = [{(q, i, s + 0.0, k) for q, i, s, k in rows_of(find(given, weighted.where("id <= 200"), 5, **more))} for more in ({}, {"block": 3}, {"wave": 4, "block": 2})]
        assert got[0] == got[1] == got[2] == {(q, i, s + 0.0, k) for q, i, s, k in want}
        assert find(given.limit(0), weighted, 5).count() == 0 and find(given, weighted.limit(0), 5).count() == 0
        assert find(given, weighted, 5).where("id = 201 AND score > 0").count() == 0


def test_rrf_prefers_what_both_lists_hold(spark):
    make = lambda ids: spark.createDataFrame([(1, i, k + 1, 1.0) for k, i in enumerate(ids)], "query_id long, id long, rank int, score double")
    got = fusion.rrf({"dense": make([5, 7]), "sparse": make([7, 9])}).orderBy("fused_rank").collect()
    assert got[0]["id"] == 7 and got[0]["sources"] == ["dense", "sparse"] and got[0]["dense_rank"] == 2
    assert got[0]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61, abs=1e-9) and [r["id"] for r in got] == [7, 5, 9]


def test_parents_are_ordered_by_their_best_child(spark):
    fused = spark.createDataFrame([(1, i, s, k + 1) for k, (i, s) in enumerate([(1, 0.9), (2, 0.7), (3, 0.2), (4, 0.1), (5, 0.05), (6, 0.5)])], "query_id long, id long, rrf_score double, fused_rank int")
    parent_of = spark.createDataFrame([(1, 10), (2, 11), (3, 10), (4, 10), (5, 10)], "id long, parent_id long")
    got = fusion.expand_parents(fused, parent_of).orderBy("parent_rank").collect()
    assert [(r["parent_id"], r["child_ids"]) for r in got] == [(10, [1, 3, 4]), (11, [2])]


def test_routing(spark):
    cases = {1: [("f", 0.5), ("l", 0.3)], 2: [("f", 0.5), ("l", 0.49), ("m", 0.1)], 3: [("f", 0.2), ("l", 0.1)], 4: [("f", 0.6)]}
    scores = spark.createDataFrame([(q, d, s) for q, v in cases.items() for d, s in v], "query_id long, domain string, score double")
    got = {r["query_id"]: (r["domains"], r["confidence"]) for r in fusion.route_domains(scores).collect()}
    assert got == {1: (["f"], "high_single_domain"), 2: (["f", "l"], "ambiguous_two_domains"), 3: (["f", "l"], "low_all_domains"), 4: (["f"], "high_single_domain")}
    rules = spark.createDataFrame([("a", ["x"], [r"\bcat\b", r"\bdog\b"]), ("b", ["x", "y"], [r"\bcat\b"]), ("c", ["y"], [r"\bfish\b"])], "file_name string, domains array<string>, patterns array<string>")
    queries = spark.createDataFrame([(1, "CAT and dog", ["x"]), (2, "cats", ["x"]), (3, "fish", ["y"]), (4, "fish", ["x"])], "query_id long, text string, domains array<string>")
    got = {r["query_id"]: (r["file_names"], r["confidence"]) for r in fusion.route_sources(queries, rules).collect()}
    assert got == {1: (["a", "b"], "multi_source"), 2: ([], "no_source_filter"), 3: (["c"], "high_single_source"), 4: ([], "no_source_filter")}


def test_word_boundaries_of_rules_are_ascii(spark):
    rules = spark.createDataFrame([("a", ["x"], [r"\bas\b"]), ("b", ["x"], [r"\\bas"])], "file_name string, domains array<string>, patterns array<string>")
    texts = ["ñAs", "asé", "gas", "as1", r"x\bas", "as"]
    queries = spark.createDataFrame([(i, t, ["x"]) for i, t in enumerate(texts)], "query_id long, text string, domains array<string>")
    got = {r["query_id"]: r["file_names"] for r in fusion.route_sources(queries, rules).collect()}
    assert got == {0: ["a"], 1: ["a"], 2: [], 3: [], 4: ["b"], 5: ["a"]}


def test_budgets(spark):
    rows = spark.createDataFrame([("q", i, n) for i, n in enumerate([70, 20, 5, 1])], "k string, i int, n long")
    assert [r["i"] for r in fusion.within_budget(rows, F.col("n"), 60, "k", order="i").collect()] == [0]
    assert [r["i"] for r in fusion.within_budget(rows, F.col("n"), 95, "k", order="i").collect()] == [0, 1, 2]
    batch = spark.createDataFrame([("q", i, 20_000) for i in range(3)], "k string, i int, n long")
    assert fusion.safe_batch(batch, F.col("n"), 64, 35_000, "k", order="i").count() == 1


def test_packing_against_loops(spark):
    r = random.Random(2)
    items = [(d, i, r.choice([0, 5, 30, 90, 400]), r.random() < 0.1) for d in range(30) for i in range(r.randint(1, 40))]
    df = spark.createDataFrame(items, "d long, i int, n int, t boolean")

    def loops(children):
        out, by = [], defaultdict(list)
        for x in items:
            by[x[0]].append(x)
        for d, xs in by.items():
            part, used, is_open = -1, 0, False
            for _, i, n, t in xs:
                joins = (is_open and not t and used + n <= 200) if children else (part >= 0 and used + n <= 200)
                part, used = (part, used + n) if joins else (part + 1, n)
                is_open = not t and used < 150
                out.append((d, i, part))
        return sorted(out)

    assert sorted(tuple(x) for x in chunking.pack(df, "d", "i", F.col("n"), 200).select("d", "i", "part").collect()) == loops(False)
    assert sorted(tuple(x) for x in chunking.pack_children(df, "d", "i", F.col("n"), F.col("t"), 200, 150).select("d", "i", "part").collect()) == loops(True)


def test_build_parents_and_expand(spark):
    body = "Some words stand here. " * 200
    rows = [("d", "s", float(i), body if i == 3 else f"text {i}", i % 2 + 1, "heading" if i == 0 else "text") for i in range(6)]
    df = spark.createDataFrame(rows, "document_id string, section string, sequence double, text string, page int, element_type string")
    big = chunking.expand_oversized(df)
    pieces = big.where("pieces > 1").orderBy("sequence").collect()
    assert len(pieces) > 1 and all(3 < p["sequence"] < 4 for p in pieces) and " ".join(p["text"] for p in pieces) == body.strip()
    parents = chunking.build_parents(big, 700).orderBy("part").collect()
    assert len(parents) > 1 and parents[0]["text"].startswith("text 1\n\ntext 2") and sum(p["n_elements"] for p in parents) == big.count() - 1
    assert len({p["parent_id"] for p in parents}) == len(parents)


def test_merge_duplicates(spark):
    rows = [("d", "f", 2, "c2", "p2", [2], ["b", "a"]), ("d", "f", 1, "c1", "p1", [1], ["a", "x", "y"]), ("d", "g", 3, "c3", "p1", [3], [])]
    df = spark.createDataFrame(rows, "document_id string, fingerprint string, seq int, chunk_id string, parent_id string, pages array<int>, images array<string>")
    got = {r["fingerprint"]: r for r in chunking.merge_duplicates(df).collect()}
    f = got["f"]
    assert (f["chunk_id"], f["occurrences"], f["pages"], f["alternate_parents"], f["images"], f["omitted_images"]) == ("c1", 2, [1, 2], ["p2"], ["a", "x", "y"], 1)
    assert got["g"]["occurrences"] == 1 and got["g"]["alternate_parents"] == []


def test_heading_stack_against_a_loop(spark):
    r = random.Random(5)
    rows = [(d, i, r.choice([None, None, 1, 2, 3, 4, 6]), f"t{i}") for d in range(20) for i in range(40)]
    df = spark.createDataFrame(rows, "d int, i int, level int, title string")
    want = []
    for d in range(20):
        stack = []
        for _, i, level, title in [x for x in rows if x[0] == d]:
            if level:
                stack = [s for s in stack if s[0] < level] + [(level, title)]
            want.append((d, i, [t for _, t in stack]))
    got = elements.section_paths(df, ["d"], "i", F.col("level"), F.col("title")).select("d", "i", "section_path")
    assert sorted(tuple(x) for x in got.collect()) == want


def test_image_rules(spark):
    cols = "width double, height double, stddev double, white double, dark double, red double, category string, name string, complex boolean"
    rows = [(50, 300, 9, 0, 0, 0, "embedded", "a", False), (1000, 110, 9, 0, 0, 0, "embedded", "a", False), (300, 300, 2, 0, 0, 0, "embedded", "a", False), (300, 300, 9, 0.9, 0.0, 0.05, "embedded", "a", False),
            (300, 300, 9, 0, 0, 0, "layout", "x_Table_1", False), (300, 300, 9, 0, 0, 0, "layout", "x", False), (300, 300, 9, 0, 0, 0, "layout", "x", True), (300, 300, 9, 0, 0, 0, "embedded", "x", False)]
    df = spark.createDataFrame([tuple(map(float, r[:6])) + r[6:] for r in rows], cols)
    got = [r["v"]["decision"] for r in df.select(images.assess(*map(F.col, ("width", "height", "stddev", "white", "dark", "red", "category", "name", "complex"))).alias("v")).collect()]
    assert got == ["reject"] * 4 + ["keep", "reject", "keep", "keep"]
    score = images.child_score(F.lit(None).cast("double"), F.lit(True), F.lit(80.0), F.lit(2.0), F.lit(0.5), F.lit(True))
    assert df.select(score.alias("s")).first()["s"] == 2 + 6 - 25 - 12


def test_upserts(spark):
    old = spark.createDataFrame([(1, "h", 1.0), (2, "h", 2.0), (3, None, 3.0)], "k int, h string, v double")
    new = spark.createDataFrame([(1, "h"), (2, "x"), (3, None), (4, "n")], "k int, h string")
    assert rows_of(store.upsert_invalidating(old, new, ["k"], "h", ["v"])) == [(1, "h", 1.0), (2, "x", None), (3, None, 3.0), (4, "n", None)]
    assert rows_of(store.upsert(old, spark.createDataFrame([(1, "z", None), (9, "y", 9.0)], "k int, h string, v double"), ["k"], keep=("v",))) == [(1, "z", 1.0), (2, "h", 2.0), (3, None, 3.0), (9, "y", 9.0)]
    twice = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k int, h string, seq int")
    assert rows_of(store.last_wins(twice, ["k"], "seq")) == [(1, "b", 2)]
    texts = spark.createDataFrame([('{"a":"1","b":"2"}',), (None,)], "j string").select(store.json_set(F.col("j"), "b", F.lit("9")).alias("j"))
    assert [r["j"] for r in texts.collect()] == ['{"a":"1","b":"9"}', '{"b":"9"}']


def test_a_key_that_is_written_twice(spark):
    schema = "k int, h string, v double"
    old, new = spark.createDataFrame([(1, "h", 1.0)], schema), spark.createDataFrame([(1, "a", 5.0), (2, "b", 6.0), (1, "c", 4.0)], schema)
    for write in (lambda **o: store.upsert(old, new, ["k"], **o), lambda **o: store.upsert_invalidating(old, new, ["k"], "h", [], **o)):
        with pytest.raises(Exception, match="hold a key twice"):
            write().collect()
        assert rows_of(write(order="v")) == [(1, "a", 5.0), (2, "b", 6.0)]
    bare = spark.createDataFrame([(1,), (1,)], "k int")
    with pytest.raises(Exception, match="hold a key twice"):
        store.upsert(bare.limit(1), bare, ["k"]).collect()


def test_percentile_is_nearest_rank_half_even(spark):
    for n in list(range(1, 12)) + [31, 200]:
        values = random.Random(n).choices(range(50), k=n)
        df = spark.createDataFrame([("g", v) for v in values], "g string, t int")
        want = sorted(values)[min(n - 1, round((n - 1) * 0.95))]
        assert quality.token_stats(df, ["g"], "t").first()["p95"] == want == df.agg(quality.percentile(F.col("t"), 0.95).alias("p")).first()["p"]


def test_metrics(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("", 0.5), (None, float("inf"))], "d string, m double")
    got = {r["key"]: (r["n"], r["m"]) for r in quality.metric_averages(df, {"m": F.col("m")}, F.col("d")).collect()}
    assert got == {"a": (2, 1.0), "unknown": (2, 0.5)}
    assert rows_of(quality.round_robin(df.withColumn("i", F.monotonically_increasing_id()), "i", 2).select("worker")) == [(0,), (0,), (1,), (1,)]


def test_survey(spark):
    cells = [("Not Available", "84", "92"), ("4", "1", ""), (None, " ", "7"), (None, "N/A", "not applicable")]
    df = spark.createDataFrame(cells, "s string, p string, m string").select(survey.row_result(F.col("s"), F.col("p"), F.col("m")).alias("r"))
    assert [tuple(r["r"]) for r in df.collect()] == [("answer percent", "84%"), ("star rating", "4"), ("linear mean", "7"), ("result", "Not available")]
    bad = spark.createDataFrame([("H_UNKNOWN",)], "m string")
    with pytest.raises(Exception, match="Unmapped"):
        bad.select(survey.measure_category(F.col("m"))).collect()
    assert bad.select(survey.measure_category(F.col("m"), strict=False).alias("c")).first()["c"] is None
    runs = survey.contiguity(spark.createDataFrame([(1, i, k) for i, k in enumerate("aabba")], "g int, i int, k string"), "k", "i", ["g"])
    assert rows_of(runs) == [(1, "a", 2), (1, "b", 1)]


def test_profiles_keep_a_measures_last_row(spark):
    assert spark.conf.get("spark.sql.mapKeyDedupPolicy") == "EXCEPTION"
    named = ("facility_name", "address", "city", "state", "zip_code", "completed_surveys", "response_rate_percent", "survey_start_date", "survey_end_date")
    rows = [("f", n, m, f"q{n}", str(n), None, None, *[f"{c}{n}" for c in named[:-2]], "7/1/2024", "06/30/2025") for n, m in ((2, "H_COMP_1_A"), (3, "H_COMP_1_A"), (4, "H_CLEAN_X"), (5, "H_COMP_1_B"))]
    cols = ["facility_id", "source_row_number", "measure_id", "question", "star_rating", "answer_percent", "linear_mean_value", *named]
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'source_row_number' else 'string'}" for c in cols))
    got = survey.profiles(df.repartition(3), "doc").collect()
    assert len(got) == 1 and got[0]["facility_name"] == "facility_name2" and got[0]["measure_count"] == 4 and got[0]["source_row_numbers"] == [2, 3, 4, 5]
    found = {c: {m: v["result"] for m, v in ms.items()} for c, ms in got[0]["category_summaries"].items()}
    assert found == {"nurse_communication": {"H_COMP_1_A": "3", "H_COMP_1_B": "5"}, "hospital_environment": {"H_CLEAN_X": "4"}}


def test_json_set_keeps_the_types_of_other_values(spark):
    texts = ['{"k": 3, "o": {"a": [1, 2]}, "b": true, "n": null, "f": 1.5, "e": "old"}', "[1]", "broken{", None, '{"a": 1, "a": 2}']
    df = spark.createDataFrame([(t,) for t in texts], "j string").select(store.json_set(F.col("j"), "e", F.lit('say "x"\n')).alias("j"))
    new = {"e": 'say "x"\n'}
    want = [{"k": 3, "o": {"a": [1, 2]}, "b": True, "n": None, "f": 1.5} | new, new, new, new, {"a": 2} | new]
    assert [json.loads(r["j"]) for r in df.collect()] == want


def test_numbers_are_whole_and_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x")).repartition(7)
    got = sorted((r["x"], r["n"]) for r in numbered(df, F.col("x"), "n", 10).collect())
    assert [n for _, n in got] == list(range(10, 5010))
    same = [r["n"] for r in numbered(spark.range(1000).select(F.lit(1).alias("x")), F.col("x"), "n").collect()]
    assert sorted(same) == list(range(1000)) and numbered(spark.range(0), F.col("id"), "n").count() == 0


def test_waiting_documents_and_pending_chunks_come_in_order(spark):
    docs = spark.createDataFrame([("b", "2", "failed", "csv"), ("a", "9", "parsing", "pdf"), (None, "1", "discovered", "pdf"), ("a", "1", "discovered", "csv"), ("a", "0", "parsed", "pdf")], "domain string, file_name string, status string, source_type string")
    assert [(r["domain"], r["file_name"]) for r in indexing.waiting_documents(docs).collect()] == [("a", "1"), ("a", "9"), ("b", "2"), (None, "1")]
    assert [r["file_name"] for r in indexing.waiting_documents(docs, "pdf").collect()] == ["9", "1"]
    cols = "domain string, source_type string, file_name string, chunk_id string, retrieval_text string, " + ", ".join(f"{k}_embedding double, {k}_model string, {k}_dimension int" for k in ("dense", "sparse"))
    state = {"d": (1.0, "m", 8, 1.0, "m", 8), "n": (None,) * 6, "o": (1.0, "old", 8, 1.0, "m", 4)}
    chunks = spark.createDataFrame([("x", "s", "f", c, t, *state[k]) for c, t, k in (("3", "t", "n"), ("1", "  ", "n"), ("2", None, "o"), ("0", "t", "d"), ("4", "t", "o"))], cols)
    ids = lambda *a: [r["chunk_id"] for r in indexing.pending_chunks(chunks, *a).collect()]
    assert ids("dense", "m", 8) == ["1", "2", "3", "4"] and ids("dense", "m", 8, 2) == ["1", "2"] and ids("sparse", "m", 8) == ["3", "4"]


def test_input_of_text_and_images(spark):
    rows = spark.createDataFrame([(100, [(5600, 1000)]), (100, [(4000, 5000), (10, 10)]), (29_999, [(100, 100)]), (40_000, None), (7, [])], "t long, images array<struct<width:long,height:long>>")
    got = rows.select(indexing.input_tokens(F.col("t"), F.col("images")), indexing.image_scale(F.col("t"), F.col("images")).alias("s"), "images").collect()
    assert [r[0] for r in got] == [10_100, 30_000, 30_000, 30_000, 7]
    assert [round(r["s"], 6) for r in got] == [1.0, round(min(math.sqrt(29_900 * 560 / 20_000_100), math.sqrt(0.8)), 6), round(math.sqrt(560 / 10_000), 6), 1.0, 1.0]
    assert rows.select(indexing.text_tokens(F.lit("abcd"), F.lit(0)).alias("a"), indexing.text_tokens(F.lit(None).cast("string"), F.lit(None).cast("int")).alias("b")).first() == (2, 1)


def test_status_follows_the_children(spark):
    docs = spark.createDataFrame([(1, "parsed"), (2, "indexed"), (3, "chunked"), (4, "failed"), (None, "parsed")], "id int, status string")
    children = spark.createDataFrame([(2, True), (2, False), (3, False), (3, None), (4, False)], "id int, waits boolean")
    got = {r["id"]: r["status"] for r in indexing.document_status(docs, children, "id", F.col("waits")).collect()}
    assert got == {1: "parsed", 2: "chunked", 3: "indexed", 4: "failed", None: "parsed"}


def test_running_sums_of_groups_of_any_size(spark):
    from quernstone.storage import running

    r = random.Random(6)
    rows = [(r.choice([None, "hot", "hot", "hot", "a", "b"]), i, r.randint(0, 9)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, n int").repartition(7)
    got = {(x["g"], x["i"]): (x["s"], x["nth"]) for x in running(df, ["g"], "i", {"s": F.col("n"), "nth": F.lit(1)}).collect()}
    want, sums = {}, defaultdict(lambda: (0, 0))
    for g, i, n in rows:
        want[g, i] = sums[g] = (sums[g][0] + n, sums[g][1] + 1)
    assert got == want
    kept = fusion.prefix_within(df, F.col("n"), 20, "g", order="i", most_rows=5).collect()
    assert {(x["g"], x["i"]) for x in kept} == {k for k, (s, nth) in want.items() if nth <= 5 and (nth == 1 or s <= 20)}
    assert running(df.limit(0), ["g"], "i", {"s": F.col("n")}).count() == 0


def test_rows_that_go_first_leave_the_result_as_it_is(spark, monkeypatch):
    rng = np.random.default_rng(3)
    weights = [(i, {f"t{t}": float(w) for t, w in zip(rng.zipf(1.3, 20) % 90, rng.integers(1, 4, 20), strict=True)}) for i in range(600)]
    rows = spark.createDataFrame(weights, "id long, weights map<string,double>").repartition(3)
    queries = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    found = lambda: sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in search.sparse_topk(queries, rows, 5, block=7).collect())
    passed = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    plain = found()
    monkeypatch.setattr(search, "LEAD_FROM", 1)
    assert found() == plain and len(plain) == 150 and passed(search.sparse_topk(queries, rows, 5)) == 1
    scores = np.arange(40.0)[None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(40))], names=["id"])
    held = search.top_of(lambda b, floors: [(b.column(0).to_numpy(), slice(0, 1), scores)], np.array([7]), 5, known=np.array([37.0]))
    assert [b.column("id").to_pylist() for b in held([batch])] == [[39, 38, 37]]  # not its own best five


def test_terms_are_counted_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "b a b"), (2, None), (3, "x y z"), (4, "")], "id long, text string")
    made = search.sparse_vectors(rows, F.filter(F.split("text", " "), lambda t: t != ""), 2)
    assert {r["id"]: list(r["weights"].items()) for r in made.collect()} == {1: [("a", pytest.approx(np.log(2))), ("b", pytest.approx(np.log(3)))], 3: [("x", pytest.approx(np.log(2))), ("y", pytest.approx(np.log(2)))]}
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    twice = rows.unionByName(spark.createDataFrame([(1, "c a a")], "id long, text string"))
    got = {r["id"]: r["weights"] for r in search.sparse_vectors(twice, F.split("text", " "), 2).collect()}
    assert got[1] == {"a": pytest.approx(np.log(4)), "b": pytest.approx(np.log(3))}
