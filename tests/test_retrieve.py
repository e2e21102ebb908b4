import numpy as np
from pyspark.sql import functions as F

from quernstone.operators import images
from quernstone.plans.retrieve import context_block, prompts, retrieve
from quernstone.providers import HashedEmbedder, RetrievalConfig


def test_retrieval_of_several_queries(spark):
    texts = ["red roses grow here", "blue whales swim far", "roses need water", "trains run late", "whales sing songs"]
    e = HashedEmbedder(32)
    weigh = lambda t: {w: 1.0 for w in t.split()}
    chunks = spark.createDataFrame([(i, i // 2, "ab"[i % 2], v, weigh(t)) for i, (t, v) in enumerate(zip(texts, e.encode(texts), strict=True))], "id long, parent_id long, source string, vector array<double>, weights map<string,double>")
    parents = spark.createDataFrame([(p, " ".join(texts[2 * p : 2 * p + 2])) for p in range(3)], "parent_id long, text string")
    asked = ["water for roses", "songs of whales"]
    queries = spark.createDataFrame([(i, t, v, weigh(t)) for i, (t, v) in enumerate(zip(asked, e.encode(asked), strict=True))], "query_id long, text string, vector array<double>, weights map<string,double>")
    got = retrieve(queries, chunks, parents, RetrievalConfig.fast()).where("rank = 1").orderBy("query_id").collect()
    assert [r["parent_id"] for r in got] == [1, 2] and 2 in got[0]["child_ids"]
    only = retrieve(queries, chunks, parents, RetrievalConfig(sources=("b",))).select(F.explode("child_ids").alias("i")).collect()
    assert {r["i"] % 2 for r in only} == {1}


def test_prompt(spark):
    rows = spark.createDataFrame([(1, "q?", 1, "A" * 30, ["<t>"]), (1, "q?", 2, "B" * 30, ["<t>", "<u>"])], "query_id int, query_text string, rank int, block string, tables array<string>")
    text = prompts(rows, 40).first()["prompt"]
    assert "A" * 30 in text and "B" not in text and text.endswith("<t>\n\n---\n\n<u>") and text.startswith("User question:\nq?")
    block = context_block(*(F.lit(x) for x in ("[1] f", "d", "", "s", "parent")), F.array(F.lit("e1"), F.lit("e2")))
    assert rows.select(block.alias("b")).first()["b"] == "[1] f\nDomain: d\nSource: unknown\nSection: s\nParent context:\nparent\n\nMatched evidence:\ne1\n\ne2"


def test_image_filter(spark):
    cols = "image_id long, page int, hash string, category string, name string, area double, x double, y double, w double, h double, ok boolean"
    box = (0.0, 0.0, 200.0, 200.0)
    rows = [(1, 1, "r", "embedded", "a", 4e4, *box, True), (2, 2, "r", "embedded", "a", 4e4, *box, True), (3, 3, "r", "embedded", "a", 4e4, *box, True), (4, 4, "d", "layout", "x", 4e4, *box, True), (5, 4, "d", "embedded", "x", 4e4, *box, True),
            (6, 4, "o", "layout", "x", 4e4, 1.0, 1.0, 200.0, 200.0, True), (7, 5, "z", "embedded", "x", 4e4, *box, False)] + [(10 + i, 9, f"h{i}", "layout", "x", 4e4 + i, 300.0 * i, 0.0, 200.0, 200.0, True) for i in range(6)]
    verdict = F.struct(F.when(F.col("ok"), "keep").otherwise("reject").alias("decision"), F.lit("own").alias("reason"))
    got = {r["image_id"]: (r["decision"], r["reason"]) for r in images.filter_images(spark.createDataFrame(rows, cols), verdict).collect()}
    assert {i for i, d in got.items() if d[0] == "keep"} == {5, 12, 13, 14, 15}
    assert got[1][1].startswith("repeated") and got[4][1].startswith("duplicate") and got[6][1].startswith("layout crop") and got[7][1] == "own"


def test_pixels():
    white = images.pixel_metrics(np.full((40, 80, 3), 255))
    assert (white["width"], white["height"], white["aspect_ratio"], white["white_pixel_ratio"], white["grayscale_stddev"]) == (80, 40, 2.0, 1.0, 0.0) and len(white["perceptual_hash"]) == 32
    half = np.full((40, 40, 3), 255)
    half[:, :20] = (200, 0, 0)
    assert images.pixel_metrics(half)["red_pixel_ratio"] == 0.5 and images.pixel_metrics(half)["perceptual_hash"] != white["perceptual_hash"]


def test_features_of_a_text_are_made_once(spark):
    rows = spark.createDataFrame([(i, i // 2, "s", [1.0, float(i)], {"a": 1.0 + i}) for i in range(6)], "id long, parent_id long, source string, vector array<double>, weights map<string,double>")
    parents = spark.createDataFrame([(p, f"some words number{p}") for p in range(3)], "parent_id long, text string")
    queries = spark.createDataFrame([(9, "words number1", [1.0, 1.0], {"a": 1.0})], "query_id long, text string, vector array<double>, weights map<string,double>")
    made = retrieve(queries, rows, parents)
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert made.orderBy("rank").first()["parent_id"] == 1

    class Length:
        def relevance(self, query, text):
            return -F.abs(F.length(query) - F.length(text)).cast("double")

    assert retrieve(queries, rows, parents, reranker=Length()).count() == 3
