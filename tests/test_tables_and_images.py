import re

from quernstone.functions.text import count_tokens
from quernstone.operators import attach, tables


def test_clip():
    text = "head " + "filler " * 2000 + "middle " + "filler " * 2000 + "tail"
    out = tables.clip(text, 150)
    assert count_tokens(out) <= 150 and out.startswith("head") and out.endswith("tail") and "[middle excerpt]" in out and "[ending excerpt]" in out
    assert tables.clip(" short \n text ", 150) == "short text" and tables.clip(None, 5) == ""


def markdown(rows):
    return tables.as_markdown(["Name", "Value"], [[f"name {i}", f"value number {i} of the table"] for i in range(rows)])


def test_tables_are_split_by_rows():
    parts = tables.split_table(markdown(200), None)
    assert len(parts) > 3 and {p["strategy"] for p in parts} == {"markdown_rows"} and all(count_tokens(p["markdown"]) <= tables.PART_MAX for p in parts)
    numbers = [n for p in parts for n in range(p["row_start"], p["row_end"] + 1)]
    assert numbers == list(range(1, 201)) and all(p["markdown"].startswith("| Name | Value |") for p in parts)
    assert tables.split_table(markdown(3), None) == [] and tables.split_table(None, None) == []


def test_cascade():
    html = "<table><tr><th>A</th><th>B</th></tr>" + "".join(f"<tr><td>cell {i}</td><td>more words here {i}</td></tr>" for i in range(150)) + "</table>"
    broken = "no rows here " * 300
    assert {p["strategy"] for p in tables.split_table(broken, html)} == {"html_rows"}
    last = tables.split_table(broken, None)
    assert {p["strategy"] for p in last} == {"unstructured_last_resort"} and all(p["markdown"].startswith("| Table segment |") for p in last)
    long_row = tables.as_markdown(["A", "B"], [["x", "word " * 1500], ["y", "z"]])
    parts = tables.split_table(long_row, None)
    assert parts[0]["strategy"] == "structured_rows" and parts[-1]["strategy"] == "markdown_rows" and parts[-1]["row_start"] == 2
    assert len(re.findall("word", "".join(p["markdown"] for p in parts))) == 1500
    assert tables.parse_html("<table><tr><td>only</td></tr></table>") == ([], [["only"]]) and tables.parse_html("<p>x</p>") is None


def child(i, page, seq, text="", table=False, x=None):
    return {"child_id": i, "pages": [page], "x": x, "y": x, "sequence": seq, "text": text, "is_table": table}


def image(i, page, seq, context="", x=None, tiny=False):
    return {"image_id": i, "page": page, "x": x, "y": x, "sequence": seq, "context": context, "tiny_chart": tiny}


def test_attachment():
    children = [child("a", 1, 1, x=0.0), child("b", 2, 20, x=500.0)]
    # the page counts for more than the sequence
    assert attach.attach_one("p", children, [image("i", 2, 2, x=480.0)])[0][2:4] == ("b", "weighted_geometry")
    # none on the page: a child of its own if there is context, else nothing
    assert attach.attach_one("p", children, [image("i", 9, 2, "some context")])[0][2:4] == ("p:image:i", "contextual_fallback")
    assert attach.attach_one("p", children, [image("i", 9, 2), image("t", 1, 1, tiny=True)]) == []
    full = attach.attach_one("p", [child("a", 1, 1)], [image(str(k), 1, k, "words") for k in range(5)])
    assert [f[2] for f in full] == ["a"] * 3 + ["p:image:3"] * 2


def test_attachment_and_recovery_on_frames(spark):
    children = spark.createDataFrame([("p", "a", [1], 0.0, 0.0, 1.0, "", False), ("q", "t", [3], 0.0, 0.0, 9.0, "", True)], "parent_id string, child_id string, pages array<int>, x double, y double, sequence double, text string, is_table boolean")
    images = spark.createDataFrame([("p", "i", 1, 1.0, 1.0, 2.0, "", False), ("p", "j", None, None, None, 3.0, "ctx", False)], "parent_id string, image_id string, page int, x double, y double, sequence double, context string, tiny_chart boolean")
    got = {r["image_id"]: (r["child_id"], r["method"]) for r in attach.attach_images(children, images).collect()}
    assert got == {"i": ("a", "weighted_geometry"), "j": ("p:image:j", "contextual_fallback")}
    orphans = spark.createDataFrame([(None, "i", 1, 1.0, 1.0, 2.0, "words", False)], images.schema)
    assert attach.attach_images(children, orphans).count() == 0
    lone = spark.createDataFrame([(None, "a", [1], 0.0, 0.0, 1.0, "", False)], children.schema)
    assert attach.attach_images(lone, orphans.unionByName(images)).where("child_id = 'a' or parent_id is null").count() == 0


def test_every_crop_with_a_parent_gets_a_child(spark):
    children = spark.createDataFrame([("t", [3], 9.0, True, 0), ("full", [3], 8.0, True, 3), ("x", [4], 9.0, False, 0)], "child_id string, pages array<int>, sequence double, is_table boolean, n_images int")
    crops = [("p", f"c{i}", 3, 8.0) for i in range(5)] + [("q", "d", 4, 9.0), ("q", "e", None, 1.0), (None, "f", 3, 1.0)]
    got = attach.recovered_children(children, spark.createDataFrame(crops, "parent_id string, image_id string, page int, sequence double"))
    same = [(f"c{i}", f"p:image:c{i}", "t", "document_same_page_table_reference") for i in range(5)]
    assert sorted(tuple(r)[1:] for r in got.collect()) == same + [(i, f"q:image:{i}", None, "visual_table_fallback") for i in "de"]
