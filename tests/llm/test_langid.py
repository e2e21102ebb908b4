import random
import zlib

from pyspark.sql import functions as F

from quernstone.llm.langid import UNKNOWN, accepted, fit, identify, language_report, train, training_sample
from tests.llm.helpers import DOCS, docs_of

SYLLABLES = {"aa": "ka to mi ru sen hai", "bb": "schl ung keit ver ein zu", "cc": "ция ост при мен ова ть"}


def text_of(lang, r, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choices(parts, k=r.randint(1, 4))).capitalize() for _ in range(n))


def corpus(spark, n=300):
    r = random.Random(9)
    langs = [r.choice(list(SYLLABLES)) for _ in range(n)]
    return spark.createDataFrame([(i, text_of(x, r, r.randint(3, 60)), x, "s", 0) for i, x in enumerate(langs)], DOCS)


def test_held_out_accuracy_and_no_leak(spark):
    docs = corpus(spark)
    got = {r["doc_id"]: r for r in language_report(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    held = [i for i in got if got[i]["held_out"]]
    assert len(held) > 30 and sum(got[i]["lang_pred"] == truth[i] for i in held) >= 0.97 * len(held)
    assert sum(r["rejected"] for r in got.values()) <= 3
    assert training_sample(docs).where(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).count() == 0
    # labels of the held-out fold change nothing
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz").otherwise(F.col("lang")))
    assert {r["doc_id"]: r["lang_pred"] for r in language_report(other).collect()} == {i: r["lang_pred"] for i, r in got.items()}


def test_edges(spark):
    model = fit(corpus(spark))
    rows = [(1, None, None, None, None), (2, "", "aa", None, None), (3, "123 !? ٣", "aa", "s", 1), (None, "schlungkeit verein", None, None, None), (5, "schlungkeit verein", None, None, None), (5, "schlungkeit verein", None, None, None), (6, "ung keit zu " * 400_000, None, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({"score": F.lit("x"), "lang_pred": F.lit(1), "quern_known": F.lit(2)})
    got = identify(df, model).collect()
    assert [r["lang_pred"] for r in got] == [UNKNOWN] * 3 + ["bb"] * 4 and [r["score"] for r in got[:3]] == [0, 0, 0]
    kept = accepted(df, model)
    assert kept.columns == df.columns and [r["doc_id"] for r in kept.collect()] == [None, 5, 5, 6]
    assert identify(docs_of(spark, []), model).count() == 0
    assert language_report(docs_of(spark, [])).count() == 0 and accepted(docs_of(spark, [])).count() == 0
    unlabelled = docs_of(spark, ["some text"], lang=None)
    assert [tuple(r)[2:] for r in language_report(unlabelled).collect()] == [(UNKNOWN, 0.0, True)]


def test_slices_change_nothing(monkeypatch):
    from quernstone.llm import langid

    r = random.Random(1)
    texts, labels = zip(*[(text_of(x, r, 20), x) for x in list(SYLLABLES) * 30], strict=True)
    model = train(list(texts), list(labels), [i % 5 == 0 for i in range(90)])
    whole = model.raw(text_of("aa", r, 500))
    r2 = random.Random(1)
    [text_of(x, r2, 20) for x in list(SYLLABLES) * 30]
    monkeypatch.setattr(langid, "_SLICE", 100)
    assert abs(model.raw(text_of("aa", r2, 500)) - whole).max() < 1e-9


def test_the_sample_is_bounded_in_all(spark):
    r = random.Random(3)
    langs = list(SYLLABLES)
    docs = spark.createDataFrame([(i, text_of(langs[i % 3], r, 400), langs[i % 3], "s", 0) for i in range(300)], DOCS)
    sizes = [len(x["text"]) for x in training_sample(docs, per_lang=50, most_chars=1000, most_sum=15_000).collect()]
    assert 100 < len(sizes) < 200 and max(sizes) == 100  # 150 rows are expected
    sizes = [len(x["text"]) for x in training_sample(docs, per_lang=50, most_chars=40).collect()]
    assert max(sizes) == 40
    # by default the longest texts of the most rows give 8.4 million characters, where they gave 210 million before
    whole = training_sample(docs.limit(0)).select("text", "lang", "calibrate")
    assert whole.count() == 0
    model = fit(docs, per_lang=60, most_sum=12_000)
    got = identify(docs.where("doc_id % 5 = 0"), model).collect()
    assert sum(r["lang_pred"] == langs[r["doc_id"] % 3] for r in got) >= 0.97 * len(got)
