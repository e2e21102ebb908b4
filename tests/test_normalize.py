import json

from quernstone.functions.ids import stable_id
from quernstone.operators import document_chunks, normalize, quality

DOC = "document_id string, domain string, source_name string, parsed string"
WEB = "domain string, source_name string, root_url string, parsed string"


def by_sequence(df):
    return sorted(df.collect(), key=lambda r: (r["document_id"], r["sequence"]))


def ids(spark, *parts):
    return spark.range(1).select(stable_id(*parts).alias("i")).first()["i"]


def test_pages_in_reading_order_with_sections_images_and_counts(spark):
    table = {"type": "table", "value": "a b", "md": "| a | b |", "html": "<table></table>", "bbox": [{"x": 1, "y": 50, "w": 5, "h": 5}]}
    pages = [
        {"page_number": 1, "items": [{"type": "text", "md": "", "value": "  last \n words "}, {"type": "header", "md": "head"}, {"type": "heading", "md": "One", "level": 1, "bbox": {"x": 0, "y": 1, "w": 2, "h": 2}}, {"type": "heading", "md": "Sub", "level": 2, "bbox": {"y": 2}}, table, {"type": "text", "md": " ", "bbox": {"y": 3}}]},
        {"page_number": 2, "items": [{"type": "heading", "value": "Two"}, {"md": "no type"}, {"type": "footer", "md": "x"}, {"type": "footer", "md": "y"}]},
        {"page_number": 3}, "odd", {"items": "odd"},
    ]
    docs = spark.createDataFrame([("d", "dom", "src", json.dumps({"pages": pages})), ("e", "dom", "src", "broken {"), ("f", "dom", "src", None)], DOC)
    images = spark.createDataFrame([("d", 1, "p.png", "img/p.png", (1.0, 60.0, 2.0, 2.0), "layout table or form crop", 0), ("d", 1, "top.png", "img/top.png", None, None, 1), ("d", 9, "lost.png", "img/lost.png", None, None, 0)], normalize.IMAGE)
    made = normalize.from_pages(docs, images)
    rows = by_sequence(made.elements)
    assert [(r["element_type"], r["text"], r["section_path"], r["page_number"]) for r in rows] == [
        ("heading", "One", ["One"], 1), ("heading", "Sub", ["One", "Sub"], 1), ("table", "a b", ["One", "Sub"], 1), ("image", None, ["One", "Sub"], 1), ("text", "last words", ["One", "Sub"], 1), ("image", None, ["One", "Sub"], 1),
        ("heading", "Two", ["Two"], 2), ("text", "no type", ["Two"], 2),
    ]
    assert rows[2]["table_markdown"] == "| a | b |" and rows[2]["bbox"]["y"] == 50 and rows[0]["bbox"]["w"] == 2 and rows[4]["table_markdown"] is None
    near = rows[3]["metadata"]
    assert (near["nearby_text_before"], near["nearby_text_after"], near["nearby_table_markdown"], near["selection_reason"]) == ("| a | b |", "last words", "| a | b |", "layout table or form crop")
    assert rows[3]["element_id"] == ids(spark, "d", "1", "p.png") and rows[2]["element_id"] == ids(spark, "d", "1", "3", "table") and rows[5]["metadata"]["nearby_text_after"] is None
    counts = {r["document_id"]: (r["element_counts"], r["ignored_counts"]) for r in made.counts.collect()}
    assert counts == {"d": ({"heading": 3, "image": 2, "table": 1, "text": 2}, {"footer": 2, "header": 1}), "e": ({}, {}), "f": ({}, {})}
    # elements are what chunks are built from
    parents, children = document_chunks.build(made.elements)
    assert sorted(p["section_title"] for p in parents.collect()) == ["Sub", "Two"] and children.count() == 3


def test_sections_of_web_pages_without_repeats(spark):
    element = lambda kind, **own: {"type": kind} | own
    first = {"heading": "Dosage", "section_path": ["Label", " ", "Dosage"], "elements": [
        element("heading", text="Dosage"), element("text", text="Take one."), element("text", text="take  ONE."), element("table", table_markdown="| a |", element_id="t1"), element("image", image_url="u", image_path="i.png"), element("image", image_url="u"), element("video"), element(None, text="x"),
    ]}
    second = {"heading": None, "elements": [element("table", table_markdown="| A |"), element("text", text="More.")]}
    docs = spark.createDataFrame([("med", "label", "http://x", json.dumps({"pages": [{"source_url": "http://x/1", "page_number": 1, "sections": [first]}, {"source_url": "http://x/2", "sections": [second]}]})), ("med", "other", "http://y", "[]")], WEB)
    made = normalize.from_sections(docs)
    rows = by_sequence(made.elements)
    assert [(r["element_type"], r["text"], r["section_path"], r["source_url"]) for r in rows] == [
        ("heading", "Dosage", ["Label", "Dosage"], "http://x/1"), ("text", "Take one.", ["Label", "Dosage"], "http://x/1"), ("table", None, ["Label", "Dosage"], "http://x/1"), ("image", None, ["Label", "Dosage"], "http://x/1"), ("text", "More.", [], "http://x/2"),
    ]
    assert rows[2]["element_id"] == "t1" and rows[3]["image_path"] == "i.png" and [r["sequence"] for r in rows] == [1, 2, 3, 4, 5]
    counts = sorted(((r["element_counts"], r["ignored_counts"]) for r in made.counts.collect()), key=repr)
    assert counts == sorted([({}, {}), ({"heading": 1, "image": 1, "table": 1, "text": 2}, {"duplicate_content": 2, "duplicate_image": 1, "unknown": 1, "video": 1})], key=repr)


def test_category_documents_are_chunks(spark):
    schema = "category_doc_id string, document_id string, category string, retrieval_text string, table_markdown string, source_row_numbers array<bigint>, profile_id string, facility_id string, hospital_name string, state string"
    rows = [(f"c{i}{p}", "doc", c, f"{c} text", "| t |", [i], p, f"f{p}", f"Hospital {p}", "AL") for p in "xy" for i, c in enumerate(("B care", "A nurses"))]
    from pyspark.sql import functions as F

    elements = normalize.from_categories(spark.createDataFrame(rows, schema), "survey", F.lit("medical"))
    parents, children = document_chunks.category_chunks(elements)
    got = {r["parent_id"]: r for r in parents.collect()}
    assert got["x"]["parent_text"] == "Hospital: Hospital x\nFacility ID: fx\nState: AL\nAvailable categories: A nurses, B care" and got["x"]["child_count"] == 2 and got["y"]["element_ids"] == ["c1y", "c0y"]
    kid = next(r for r in children.collect() if r["chunk_id"] == "c0x")
    assert kid["retrieval_text"] == "Domain: medical\nSource: survey\nSection: B care\n\nB care text" and kid["source_row_numbers"] == [0] and kid["section_path"] == ["Hospital x", "B care"]


def test_report_on_chunks(spark):
    from tests.test_document_chunks import TABLE, element, image

    elements = [
        element("t", 1, "table", table_markdown=TABLE.format("a", 1), page_number=1), image("i", 2, 1, nearby_text_after="words"), element("a", 3, text="same"), element("long", 4, text="A sentence of words here. " * 400),
        element("big", 5, "table", table_markdown="| A | B |\n| --- | --- |\n" + "\n".join(f"| row {i} | value {i} of many |" for i in range(200))), element("h", 6, "heading", text="x", section_path=["Bare"]), element("p", 7, "image", section_path=["Pictures"]),
    ]
    rows = spark.read.schema(document_chunks.ELEMENT).json(spark.sparkContext.parallelize([json.dumps(e) for e in elements]))
    _, children = document_chunks.build(rows)
    everyone = document_chunks.parents_of(document_chunks.placed(document_chunks.expanded(rows)))
    got = quality.chunk_report(everyone, children, images=spark.createDataFrame([("other.png",)], "image_path string")).collect()
    [r] = got
    assert r["children"] == sum(r["modalities"].values()) and set(r["modalities"]) == {"text", "table", "table+image"} and r["modalities"]["table+image"] == 1
    assert r["image_assignments"] == {"weighted_geometry": 1} and set(r["split_strategies"]) == {"markdown_rows"} and r["tables_split"] == 1
    assert (r["empty_chunks"], r["image_only_chunks"], r["duplicate_chunks"], r["over_image_limit"], r["missing_images"]) == (0, 0, 0, 0, 1)
    assert r["parents_without_children"] == 1 and r["child_most"] <= 700 and r["parent_least"] >= 0
