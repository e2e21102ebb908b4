import json

import pytest
from pyspark.sql import functions as F

from quernstone import providers
from quernstone.operators import survey
from quernstone.sources import files, html
from quernstone.streaming.embedding import current_vectors, embed_arrivals


def test_discovery(spark, tmp_path):
    (tmp_path / "in/legal/sub").mkdir(parents=True)
    for name in ("A.PDF", "b.csv", "c.txt", "sub/d.pdf"):
        (tmp_path / "in/legal" / name).write_text("x")
    (tmp_path / "in/legal/m.json").write_text(json.dumps([{"name": "n", "firecrawl_config": {"url": "https://a.b/c"}}, {"url": "https://d.e"}, {"name": "none"}]))
    got = files.discover(spark, f"file://{tmp_path}/in", ["legal"], ["legal"]).collect()
    assert [(r["source_type"], r["file_name"], r["source_location"]) for r in got] == [("csv", "b.csv", "legal/b.csv"), ("html", "m", "https://d.e"), ("html", "n", "https://a.b/c"), ("pdf", "A.PDF", "legal/A.PDF")]
    assert len({r["document_id"] for r in got}) == 4
    (tmp_path / "out/x").mkdir(parents=True)
    (tmp_path / "out/y").mkdir()
    for p, t in (("x/1", "a"), ("x/2", "b"), ("y/1", "a"), ("y/2", "")):
        (tmp_path / "out" / p).write_text(t)
    assert [r["folder"].rsplit("/", 1)[1] for r in files.outputs_complete(spark, f"file://{tmp_path}/out", 2).collect()] == ["x"]


def test_survey_file(spark, tmp_path):
    head = ["Facility ID", "Facility Name", "HCAHPS Measure ID", "HCAHPS Question", "Patient Survey Star Rating", "HCAHPS Answer Percent", "HCAHPS Linear Mean Value", "Address", "City/Town", "State", "ZIP Code",
            "Number of Completed Surveys", "Survey Response Rate Percent", "Start Date", "End Date"]
    rows = [["100001", "Example Hospital", m, "Nurse | talk", star, pct, "", "1 St", "Town", "ST", "00001", "300", "NA", "07/01/2024", "06/30/2025"] for m, star, pct in (("H_COMP_1_A_P", "4", ""), ("H_CLEAN_HSP", "Not Available", "84"))]
    path = tmp_path / "s.csv"
    path.write_text("﻿" + "\n".join(",".join(f'"{c}"' for c in r) for r in [head, *rows]), encoding="utf-8")
    na = files.read_survey(spark, f"file://{path}")
    assert {r["response_rate_percent"] for r in na.collect()} == {None}
    plain = files.numbered(files.read_survey(spark, f"file://{path}", na=False), F.monotonically_increasing_id(), "source_row_number", 2)
    docs = {r["category"]: r for r in survey.category_text(survey.category_docs(plain, "doc"), plain.dropDuplicates(["facility_id"]).drop("category")).collect()}
    assert docs["hospital_environment"]["lines"] == "- Nurse | talk: 84%" and docs["nurse_communication"]["source_row_numbers"] == [2]
    assert "| H_COMP_1_A_P | Nurse \\| talk | star rating | 4 |" in docs["nurse_communication"]["table_markdown"]
    assert "Survey response rate: NA%" in docs["nurse_communication"]["retrieval_text"]
    profile = survey.profiles(plain, "doc").first()
    assert profile["category_summaries"]["hospital_environment"]["H_CLEAN_HSP"]["result"] == "84%" and str(profile["survey_start_date"]) == "2024-07-01"


def test_json_lines_and_questions(spark, tmp_path):
    (tmp_path / "v.jsonl").write_text('{"chunk_id":"a","indices":[1],"values":[0.5],"dimension":9,"model":"m"}\n\n{"chunk_id":"a","indices":[2],"values":[0.1],"dimension":9,"model":"m"}\n')
    assert [(r["chunk_id"], r["indices"]) for r in files.read_sparse_vectors(spark, f"file://{tmp_path}/v.jsonl").collect()] == [("a", [1])]
    (tmp_path / "w.jsonl").write_text('{"chunk_id":"a","indices":[1,2],"values":[0.5],"dimension":9,"model":"m"}\n')
    with pytest.raises(Exception, match="broken sparse record"):
        files.read_sparse_vectors(spark, f"file://{tmp_path}/w.jsonl").collect()
    (tmp_path / "q.json").write_text('[{"id":"1","question":"What?"}]')
    with pytest.raises(ValueError):
        files.read_questions(spark, f"file://{tmp_path}/q.json")
    (tmp_path / "ok.json").write_text('[{"id":"1","question":"What?","reference_answer":"That"}]')
    assert files.read_questions(spark, f"file://{tmp_path}/ok.json").count() == 1
    pages = spark.createDataFrame([("d", 2, "b"), ("d", 1, "a")], "d string, i int, t string")
    assert files.combined_markdown(pages, "d", "i", "t").first()["markdown"] == "a\n\n---\n\nb"


def test_export(spark, tmp_path):
    chunks = spark.createDataFrame([("c", [1.0, 2.0]), ("a", [3.0, 4.0]), ("b", [5.0, 6.0])], "chunk_id string, v array<double>")
    manifest = files.export_vectors(chunks, f"file://{tmp_path}/v", "v", 2, ["chunk_id"])
    assert sorted((r["row_index"], r["chunk_id"]) for r in manifest.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    assert files.ids_match(manifest, spark.read.parquet(f"file://{tmp_path}/v"), "chunk_id")
    with pytest.raises(ValueError):
        files.export_vectors(chunks, f"file://{tmp_path}/w", "v", 3, ["chunk_id"])


PAGE = """<html><head><title>Root</title><style>p{}</style></head><body><p>Before</p><h1>Prescribing <b>Information</b></h1><p>Text &amp; more</p><script>x()</script>
<h2>Dosage</h2><table><tr><th>A</th><th>B|C</th></tr><tr><td>1</td></tr></table><ul><li><p>one</p></li><li>two</li></ul><img src="/i.png" alt="pic"><h1>Next</h1><p></p></body></html>"""


def test_html(spark):
    got = html.parse(1, "https://a.b/c/d.html", PAGE)
    assert [(e["tag"], e["section_path"]) for e in got] == [
        ("p", ["Root"]), ("h1", ["Prescribing Information"]), ("p", ["Prescribing Information"]), ("h2", ["Prescribing Information", "Dosage"]), ("table", ["Prescribing Information", "Dosage"]),
        ("ul", ["Prescribing Information", "Dosage"]), ("img", ["Prescribing Information", "Dosage"]), ("h1", ["Next"]),
    ]
    assert got[2]["text"] == "Text & more" and got[4]["table_markdown"] == "| A | B\\|C |\n| --- | --- |\n| 1 |  |" and got[6]["image_url"] == "https://a.b/i.png"
    assert html.parse(1, None, None) == [] and len(html.parse(1, "", PAGE, keep_empty=True)) == 9
    assert html.elements(spark.createDataFrame([(1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")).count() == 8


def test_incremental_embedding(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "ck"))
    embedder = providers.HashedEmbedder(8)
    calls = []

    def encode(rows):
        calls.append(rows.count())
        return providers.embed(rows, embedder)

    def arrive(name, *rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(dict(zip(("chunk_id", "text", "input_hash", "seq"), r, strict=True))) for r in rows))

    arrive("1.json", ("a", "one", "h1", 1), ("b", "two", "h2", 2), ("a", "one again", "h3", 3))
    embed_arrivals(spark, source, out, checkpoint, encode)
    arrive("2.json", ("b", "two", "h2", 4), ("c", "three", "h4", 5))
    embed_arrivals(spark, source, out, checkpoint, encode)
    assert calls == [2, 1]
    got = {r["chunk_id"]: r["input_hash"] for r in current_vectors(spark, out).collect()}
    assert got == {"a": "h3", "b": "h2", "c": "h4"}
    # back to an earlier text, in a later batch: its vector is the current one again
    arrive("3.json", ("a", "one", "h1", 6), ("c", "three", "h4", 7))
    embed_arrivals(spark, source, out, checkpoint, encode)
    assert calls == [2, 1, 1] and {r["chunk_id"]: r["text"] for r in current_vectors(spark, out).collect()} == {"a": "one", "b": "two", "c": "three"}


def test_a_batch_that_is_run_again_writes_all_its_rows(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    (tmp_path / "in").mkdir()
    rows = [("a", "one", "h1", 1), ("b", "two", "h2", 2)]
    (tmp_path / "in" / "1.json").write_text("\n".join(json.dumps(dict(zip(("chunk_id", "text", "input_hash", "seq"), r, strict=True))) for r in rows))
    # an attempt of batch 0 has written one of its rows, and its commit is missing
    left = spark.createDataFrame([("a", "one", "h1", 1, [0.0], 0)], "chunk_id string, text string, input_hash string, seq long, vector array<double>, batch int")
    left.write.partitionBy("batch").parquet(out)
    embed_arrivals(spark, source, out, f"{tmp_path}/ck", lambda df: providers.embed(df, providers.HashedEmbedder(8)))
    got = {r["chunk_id"]: len(r["vector"]) for r in current_vectors(spark, out).collect()}
    assert got == {"a": 8, "b": 8}


def test_providers():
    e = providers.HashedEmbedder(16)
    assert len(providers.embed_query(e, "some words")) == 16 and e.encode(["a bcd"]) == e.encode(["a bcd"])
    with pytest.raises(ValueError):
        providers.embed_query(e, " ")
    error = RuntimeError("429 RESOURCE_EXHAUSTED retryDelay: '52s'")
    tries, waits = [], []
    policy = providers.RetryPolicy(5, 65, waits.append)
    assert policy.fault(error) is providers.Fault.RATE and policy.pause(error) == 54 and policy.pause(RuntimeError("rate limit")) == 65
    assert policy.pause(TimeoutError("timed out")) == policy.pause(TimeoutError()) == 65
    assert policy.pause(RuntimeError("401 UNAUTHENTICATED, 429")) is policy.pause(RuntimeError("x")) is None

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise error
        return "done"

    assert policy.run(call) == "done" and waits == [54, 54]
    for message, n in (("invalid api key", 2), ("quota exceeded", 2 + 5)):
        with pytest.raises(RuntimeError):
            policy.run(lambda m=message: (_ for _ in ()).throw(RuntimeError(m)))
        assert len(waits) == n
    assert len(providers.ExtractiveGenerator().answer("q", "[1] a\nx\n[2] b", [f"{i}" for i in range(12)]).splitlines()) == 3 + 8
    assert providers.RetrievalConfig.fast().rerank_limit == 5


def test_pages_reach_the_parser_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10000")
    made = html.elements(spark.range(700).selectExpr("id page_id", "'http://x' url", "concat('<p>a', id, '<p>b') html").coalesce(1))
    assert int(spark.conf.get(key)) <= 256 and made.count() == 1400
