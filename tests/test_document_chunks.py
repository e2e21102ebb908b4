import json

from pyspark.sql import functions as F

from quernstone.functions.ids import stable_id
from quernstone.operators import document_chunks
from quernstone.operators.document_chunks import ELEMENT, Limits, fold

TABLE = "| Item | Value |\n| --- | --- |\n| {} | {} |"


def element(element_id, sequence, kind="text", **own):
    base = {"element_id": element_id, "document_id": "d", "domain": "finance", "source_type": "pdf", "source_name": "report", "sequence": float(sequence), "section_title": "Results", "section_path": ["Results"], "element_type": kind}
    return base | own


def chunks(spark, elements, **options):
    rows = spark.read.schema(ELEMENT).json(spark.sparkContext.parallelize([json.dumps(e) for e in elements]))
    parents, children = document_chunks.build(rows, **options)
    by_place = lambda r: (r["section_path"], r["part_number"])
    return sorted(parents.collect(), key=by_place), sorted(children.collect(), key=lambda r: (by_place(r), r["child_index"]))


def image(element_id, sequence, page, path=None, **metadata):
    return element(element_id, sequence, "image", page_number=page, image_path=f"images/{path or element_id}.png", metadata=metadata)


def box(x):
    return {"x": x, "y": x, "w": 100.0, "h": 100.0}


def test_fold_by_plain_rules():
    limits = Limits(parent=100, buffer=50, target=40)
    got = list(fold(["heading", "text", "text", "image", "table", "text", "text", "text"], [9, 20, 20, 0, 30, 30, 30, 5], [9, 20, 20, 0, 0, 30, 30, 5], limits))
    assert got == [(None, None), (1, 1), (1, 1), (1, None), (1, 2), (1, 3), (2, 1), (2, 1)]
    assert list(fold(["text"] * 3, [200, 1, 1], [200, 1, 1], limits)) == [(1, 1), (2, 1), (2, 1)]


def test_parents_children_and_provenance(spark):
    rows = [
        element("h", 1, "heading", text="Results", page_number=1), element("a", 2, text="Revenue rose.", page_number=2, source_row_numbers=[7, 3]), element("b", 3, text="Costs  fell.", page_number=1, source_row_numbers=[3]),
        element("t", 4, "table", table_markdown=TABLE.format("Old", 1), page_number=2), element("c", 5, text="End."), element("u", 6, text="Alone", section_path=[], section_title=None), element("v", 7, text="Titled", section_path=None, section_title="Notes"),
    ]
    parents, children = chunks(spark, rows)
    assert [(p["section_title"], p["child_count"], p["page_numbers"], p["element_ids"]) for p in parents] == [("Notes", 1, [], ["v"]), ("Results", 3, [1, 2], ["a", "b", "t", "c"]), ("Unsectioned", 1, [], ["u"])]
    assert parents[1]["parent_text"] == "Revenue rose.\n\nCosts  fell.\n\n" + TABLE.format("Old", 1) + "\n\nEnd."
    ours = [c for c in children if c["section_title"] == "Results"]
    assert [(c["text_content"], c["modalities"], c["page_numbers"], c["source_row_numbers"]) for c in ours] == [("Revenue rose. Costs fell.", ["text"], [1, 2], [3, 7]), ("", ["table"], [2], []), ("End.", ["text"], [], [])]
    assert ours[0]["retrieval_text"] == "Domain: finance\nSource: report\nSection: Results\n\nRevenue rose. Costs fell." and ours[1]["metadata"]["table_kept_intact"] and not ours[0]["metadata"]["table_kept_intact"]
    want = spark.range(1).select(stable_id("d", "Results", "1", "").alias("p")).first()["p"]
    assert parents[1]["parent_id"] == want and ours[1]["chunk_id"] == spark.range(1).select(stable_id(want, "2").alias("c")).first()["c"]


def test_addresses_part_sections_and_limits_part_parents(spark):
    rows = [element(f"e{i}", i, text=f"w{i} " * 30, source_url=f"http://x/{i % 2}") for i in range(8)]
    parents, children = chunks(spark, rows, limits=Limits(parent=100, buffer=40, target=1000))
    placed = sorted((p["source_urls"], p["part_number"], len(p["element_ids"])) for p in parents)
    assert placed == [([f"http://x/{k}"], n, 2) for k in (0, 1) for n in (1, 2)] and len(children) == 8
    # texts that are alike become one child of the first parent; the others are named, and go if nothing is left in them
    parents, [child] = chunks(spark, [r | {"text": "w " * 30} for r in rows], limits=Limits(parent=100, buffer=40, target=1000))
    assert child["duplicate_occurrences"] == 8 and len(child["alternate_parent_ids"]) == 3 and child["source_urls"] == ["http://x/0", "http://x/1"] and [p["child_count"] for p in parents] == [1]


def test_oversized_elements_are_split_with_their_origin(spark):
    rows = [element("long", 1, text="A sentence of some words here. " * 1000), element("table", 2, "table", table_markdown="| A | B |\n| --- | --- |\n" + "\n".join(f"| row {i} | value {i} of many |" for i in range(200)))]
    parents, children = chunks(spark, rows)
    assert len(parents) > 1 and max(p["token_count"] for p in parents) < 3300 and max(c["token_count"] for c in children) <= 700
    parts = [c["metadata"]["table_split"] for c in children if c["modalities"] == ["table"]]
    assert len(parts) > 1 and [p["part"] for p in parts] == list(range(1, len(parts) + 1)) and {(p["original_element_id"], p["count"], p["strategy"]) for p in parts} == {("table", len(parts), "markdown_rows")}
    assert not any(c["metadata"]["table_kept_intact"] for c in children)


def test_images_prefer_their_page_and_boxes(spark):
    rows = [
        element("one", 1, "table", table_markdown=TABLE.format("Old", 1), page_number=1, bbox=box(10.0)),
        image("pic", 2, 2, nearby_text_after="Current result chart") | {"bbox": box(500.0)},
        element("two", 10, "table", table_markdown=TABLE.format("Current", 2), page_number=2, bbox=box(510.0)),
    ]
    _, children = chunks(spark, rows)
    [shows] = [c for c in children if c["image_paths"]]
    assert shows["page_numbers"] == [2] and "Current" in shows["table_markdown"] and shows["modalities"] == ["table", "image"] and shows["element_ids"] == ["pic", "two"]
    assert shows["metadata"]["image_context"][0]["assignment_method"] == "weighted_geometry"


def test_images_without_a_child_on_their_page(spark):
    table = element("one", 1, "table", table_markdown=TABLE.format("Old", 1), page_number=1)
    _, children = chunks(spark, [table, image("pic", 2, 2, nearby_text_after="Page two chart evidence")])
    [shows] = [c for c in children if c["image_paths"]]
    assert shows["page_numbers"] == [2] and shows["modalities"] == ["text", "image"] and shows["text_content"] == "Page two chart evidence" and shows["child_index"] == 2
    assert shows["metadata"]["image_context"][0]["assignment_method"] == "contextual_fallback"
    _, children = chunks(spark, [table, image("pic", 2, 2)])
    assert [c["image_paths"] for c in children] == [[]]
    tiny = image("pic", 2, 1, nearby_text_after="words", selection_reason="layout chart crop") | {"bbox": {"x": 1.0, "y": 1.0, "w": 35.0, "h": 35.0}}
    assert not any(c["image_paths"] for c in chunks(spark, [table, tiny])[1])


def test_table_crops_are_never_lost(spark):
    reason = {"selection_reason": "layout table or form crop"}
    elsewhere = {"section_title": "Visual", "section_path": ["Visual"]}
    parents, children = chunks(spark, [element("t", 1, "table", table_markdown=TABLE.format("Now", 2), page_number=5), *[image(f"crop{i}", 2 + i, 5, **reason) | elsewhere for i in range(5)]])
    shows = [c for c in children if c["image_paths"]]
    table = next(c["chunk_id"] for c in children if c["modalities"] == ["table"])
    assert [c["image_paths"] for c in shows] == [[f"images/crop{i}.png"] for i in range(5)] and {c["metadata"]["matched_table_chunk_id"] for c in shows} == {table}
    assert {c["metadata"]["image_context"][0]["assignment_method"] for c in shows} == {"document_same_page_table_reference"} and [p["child_count"] for p in parents] == [1, 5]
    _, [lone] = chunks(spark, [image("crop", 1, 8, **reason)])
    assert lone["modalities"] == ["text", "image"] and lone["text_content"].startswith("Visual table crop crop.png from section Results on page 8") and lone["metadata"]["image_context"][0]["assignment_method"] == "visual_table_fallback"


def test_like_children_with_other_images_stay(spark):
    table = lambda i, at, page: element(i, at, "table", table_markdown=TABLE.format("Current", 2), page_number=page)
    _, children = chunks(spark, [table("a", 1, 1), image("one", 2, 1, nearby_text_after="Current"), table("b", 3, 2), image("two", 4, 2, nearby_text_after="Current")])
    assert sorted(p for c in children for p in c["image_paths"]) == ["images/one.png", "images/two.png"] and len(children) == 2
    _, children = chunks(spark, [table("a", 1, 1), table("b", 3, 2)])
    assert [(c["page_numbers"], c["element_ids"], c["duplicate_occurrences"], c["alternate_parent_ids"]) for c in children] == [([1, 2], ["a", "b"], 2, [])]


def test_empty_and_bare_documents(spark):
    assert chunks(spark, []) == ([], [])
    assert chunks(spark, [element("h", 1, "heading", text="Only")]) == ([], [])
    parents, children = chunks(spark, [element("e", 1, text=None), element("f", 2, text="x", element_type=None)])
    assert [c["text_content"] for c in children] == ["x"] and parents[0]["element_ids"] == ["e", "f"]


def test_a_passage_that_stands_for_a_table_gets_one(spark):
    label = {"source_name": "dailymed_ozempic_prescribing_label"}
    _, children = chunks(spark, [element("a", 1, text="Ozempic | placebo, see Table 2") | label, element("t", 2, "table", table_markdown=TABLE.format("Table 2 ozempic", 1)) | label, element("b", 3, text="Nothing of the kind.") | label])
    first, table, last = children
    assert first["modalities"] == ["text", "table"] and first["table_markdown"].splitlines()[2] == r"| Ozempic \| placebo, see Table 2 |" and first["table_html"].startswith("<table>")
    assert first["metadata"]["table_rescue_strategy"] == "dailymed_clinical_table_or_figure_text" and not first["metadata"]["table_kept_intact"]
    assert table["metadata"]["table_kept_intact"] and table["metadata"]["table_rescue_strategy"] is None and last["modalities"] == ["text"]


def test_a_section_goes_on_over_batches(spark):
    from quernstone.storage import ARROW_ROWS

    n = 3 * ARROW_ROWS + 7
    names = [f"e{i:05d}" for i in range(n)]
    words = lambda i: " ".join(["word"] * (1 + i % 13))
    values = [element(e, i // 2, "text" if i % 11 else "heading", text=words(i)) for i, e in enumerate(names)]
    split = "struct<original_element_id:string,part:int,count:int,strategy:string,row_start:int,row_end:int>"
    rows = spark.read.schema(ELEMENT).json(spark.sparkContext.parallelize([json.dumps(e) for e in values])).repartition(5).withColumn("split", F.lit(None).cast(split))
    placed = document_chunks.placed(rows, Limits(90, 40, 30))
    assert "FlatMapGroups" not in placed._jdf.queryExecution().toString()  # a group of its own in Python for each section
    got = sorted(placed.collect(), key=lambda r: r["element_id"])
    wanted = fold([r["element_type"] for r in got], [r["quern_n"] for r in got], [r["quern_text_n"] for r in got], Limits(90, 40, 30))
    assert [(r["parent"], r["child"]) for r in got] == list(wanted)
    assert {(r["first_at"], r["first_id"]) for r in got} == {(0.0, names[0])} and len(got) == n


def test_parents_without_images_are_no_groups(spark):
    from quernstone.operators import attach

    children = spark.createDataFrame([(p, f"{p}{i}", [1], 0.0, 0.0, float(i), "text", False) for p in "abc" for i in range(2)], "parent_id string, child_id string, pages array<int>, x double, y double, sequence double, text string, is_table boolean")
    images = spark.createDataFrame([("b", "i", 1, 0.0, 0.0, 1.0, "text", False)], "parent_id string, image_id string, page int, x double, y double, sequence double, context string, tiny_chart boolean")
    found = attach.attach_images(children, images)
    assert "LeftSemi" in found._jdf.queryExecution().toString()
    assert [(r["parent_id"], r["image_id"], r["child_id"]) for r in found.collect()] == [("b", "i", "b1")]
