import math
import re
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quernstone.functions import ids
from quernstone.functions import text as T


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"]).select(column.alias("v")).first()["v"]


def test_ids(spark):
    assert one(spark, ids.stable_id(F.col("a"), F.col("b")), a="x", b="y") == str(uuid.uuid5(uuid.NAMESPACE_URL, "x:y"))
    same = [one(spark, ids.document_id(F.lit("d"), F.lit("pdf"), F.col("p")), p=p) for p in ("A/b.PDF", "a/B.pdf")]
    assert same[0] == same[1] != one(spark, ids.document_id(F.lit("D"), F.lit("pdf"), F.col("p")), p="a/b.pdf")
    assert ids.parser_version("pyspark") and ids.parser_version("no-such-parser") is None
    digest = lambda *i: one(spark, ids.embedding_input_hash(F.col("t"), F.array(*[F.struct(F.lit(p).alias("path"), F.lit(h).alias("sha256")) for p, h in i]), "v"), t="x")
    assert len({digest(("a", "1"), ("b", "2")), digest(("b", "2"), ("a", "1")), digest(("a", "1"), ("b", "3"))}) == 3


def test_tokens_and_cleaning(spark):
    assert one(spark, T.token_count(F.col("t")), t="abcdefghijklmnop") == 3 and one(spark, T.token_count(F.col("t")), t="a b c d e f g h i j") == 11
    assert one(spark, T.clean_text(F.col("t")), t="  a \n\t b ") == "a b" and one(spark, T.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, T.collapse_punctuation(F.col("t")), t="x" + "." * 30 + "y") == "x.y"
    for t in ("Größe, naïve_x  42!", "", "日本語テキスト。 ok"):
        assert one(spark, T.token_count(F.col("t")), t=t) == T.count_tokens(t)


def test_split_pieces(spark):
    text = " ".join(f"Sentence number {i} says something." for i in range(400)) + " " + "word " * 2000
    pieces = one(spark, T.split_pieces(F.col("t"), 520), t=text)
    assert " ".join(pieces) == re.sub(r"\s+", " ", text).strip() and len(pieces) > 5
    assert all(sum(T.count_tokens(s) for s in re.split(r"(?<=[.!?])\s+", p)) <= 520 or "word" in p for p in pieces)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=300), st.integers(1, 40))
def test_pieces_rejoin(text, limit):
    pieces = T.split_text(text, limit)
    assert " ".join(pieces) == re.sub(r" +", " ", re.sub(r"([.!?])\1{20,}", r"\1", re.sub(r"\s+", " ", text).strip())).strip() and all(pieces)


def test_tables(spark):
    rows = [("a|b", "2"), ("c",)]
    table = one(spark, T.markdown_table(F.array(F.lit("H")), F.col("r")), r=[list(r) for r in rows])
    assert table == "| H | Column 2 |\n| --- | --- |\n| a\\|b | 2 |\n| c |  |"
    parsed = one(spark, T.parse_markdown_table(F.col("t")), t=table)
    assert parsed["headers"] == ["H", "Column 2"] and parsed["rows"] == [["a|b", "2"], ["c", ""]]
    assert one(spark, T.parse_markdown_table(F.col("t")), t="no table\nat all\nhere") is None
    assert one(spark, T.html_table(F.array(F.lit("H")), F.col("r")), r=[["<x>"]]) == "<table><thead><tr><th>H</th></tr></thead><tbody><tr><td>&lt;x&gt;</td></tr></tbody></table>"
    assert one(spark, T.structured_row(F.array(*map(F.lit, "ab")), F.col("r"), F.lit(3)), r=["1", " "]) == "Row 3: a = 1"
    assert one(spark, T.one_column_table(F.col("t")), t="x | y") == "| Table segment |\n| --- |\n| x \\| y |"


def test_names_and_labels(spark):
    assert [one(spark, T.page_from_name(F.col("n")), n=n) for n in ("img_P12_3.png", "page_7_x.png", "page_7_p3_.png", "x.png")] == [12, 7, 3, None]
    assert one(spark, T.safe_name(F.col("n")), n="a/b c(1).png") == "b_c_1_.png"
    assert [one(spark, T.url_name(F.col("u")), u=u) for u in ("https://a.b/c/d.html", "https://a.b/lookup", "https://a.b.c/")] == ["d", "a_b", "a_b_c"]
    label = T.source_label(F.lit(2), F.lit("f"), F.lit(" "), F.array(F.lit(1), F.lit(3)), F.array().cast("array<bigint>"))
    assert one(spark, label) == "[2] f | pages 1, 3"
    text = T.retrieval_text(F.lit("d"), F.lit("s"), F.lit(None), F.lit("t"), F.lit("x"), F.lit(True))
    assert one(spark, text) == "Domain: d\nSource: s\n\nt"
    assert one(spark, T.is_noise_image(F.lit("http://x/Logo.png"), F.lit(None), F.lit(None))) and one(spark, T.is_navigation(F.lit("Skip to main content")))
    signal = lambda text, source=T.LABEL: one(spark, T.table_signal(F.lit(source), F.col("t")), t=text)
    assert signal("Ozempic, see  TABLE 3.") == "dailymed_clinical_table_or_figure_text" and signal("see Table 3") is None and signal("Ozempic tables 3") is None
    assert signal("N = 30 ozempic and OZEMPIC") == "dailymed_treatment_group_count_text" and signal("N = 30 ozempic") is None and signal("Ozempic, see Table 3", "other") is None and one(spark, T.table_signal(F.lit(T.LABEL), F.lit(None).cast("string")), t="x") is None


def test_overlap(spark):
    terms = T.lexical_terms(F.col("t"))
    assert one(spark, terms, t="One two-three ONE ab") == ["one", "two-three"]
    assert one(spark, T.term_overlap(F.col("a"), F.col("b")), a=["x", "y"], b=["y", "z", "w"]) == 0.5
    assert math.isclose(one(spark, T.term_overlap(F.col("a"), F.array().cast("array<string>")), a=["x"]), 0)
