import random
import time

import pytest
from pyspark.sql import functions as F

from quernstone.llm import pii
from quernstone.llm.pii import assign, configured_key, luhn, mentions, mod97, pii_report, rendered, replace_pii, rewritten, script_of, surrogate
from tests.llm.helpers import DOCS, docs_of

KEY = b"a key of the tests"
TEXT = (
    "Write to Jane.Doe+x@mail4.example.com or call +1 (017) 555-7713, +1 017-555-7713 from 97.51.17.173; card 4111111111111111 "
    "or 4111 1111 1111 1111, number 9807915762804490, ssn 078-05-1120, iban DE89 3704 0044 0532 0130 00. "
    "Mr John Smith and Frau Müller met Dr Smith, г-жа Иванова and MR. X."
)


def entities(text):
    return [(k, text[a:b]) for a, b, k, _ in mentions(text)]


def test_detection():
    assert entities(TEXT) == [
        ("email", "Jane.Doe+x@mail4.example.com"), ("phone", "+1 (017) 555-7713"), ("phone", "+1 017-555-7713"), ("ip", "97.51.17.173"),
        ("card", "4111111111111111"), ("card", "4111 1111 1111 1111"), ("card", "9807915762804490"), ("ssn", "078-05-1120"), ("iban", "DE89 3704 0044 0532 0130 00"),
        ("name_m", "John"), ("name_s", "Smith"), ("name_s", "Müller"), ("name_s", "Smith"), ("name_s", "Иванова"),
    ]
    assert entities("version 1.2.3 of 300.1.1.1, 12 345 and 2024-01-01, a@b, x@y.z, Sir and Mr. mister, 1.2.3.4.5") == []
    assert mentions(None) == mentions("") == []


def test_surrogates_keep_type_and_form():
    new, old = rewritten(TEXT, {}, KEY)
    found = entities(new)
    assert [k for k, _ in found] == [k for _, _, k, _ in old]
    now = [x for _, x in found]
    was = [x for _, x in entities(TEXT)]
    assert not set(now) & set(was)
    assert now[0].endswith(".com") and len(now[0]) == len(was[0]) and now[0][4] == "."
    digits = [pii._NOT_DIGIT.sub("", x) for x in now]
    assert digits[1] == digits[2] and now[1].startswith("+1 (") and now[2][6] == "-"  # one phone in two formats
    assert digits[4] == digits[5] and luhn(digits[4]) == 0 and digits[4][0] == "4" and luhn(digits[6]) != 0
    assert mod97(now[8].replace(" ", "")) == 1 and now[8][:2] == "DE" and now[8].count(" ") == 5
    assert now[10] == now[12] and now[9][-3:] in ("ron", "ten", "mar") and script_of(now[13]) == "CYRILLIC" and now[13].istitle()
    assert rendered("name_s", "abc", "SMITH") == "ABC"
    assert surrogate("email", "a@b.cc", KEY) != surrogate("email", "a@b.cc", KEY, 1) and surrogate("email", "a@b.cc", b"k") != surrogate("email", "a@b.cc", KEY)
    same = [surrogate("email", f"{x}1@mail.example.com", KEY).split("@")[1] for x in "abc"]
    assert len(set(same)) == 1  # one domain stays one


def test_distinct_entities_stay_distinct(spark):
    rows = [("email", f"{chr(97 + i)}@x.com") for i in range(26)] + [("name_m", f"name{i}") for i in range(300)] + [("ip", f"10.0.0.{i}") for i in range(200)] + [("ssn", f"{i:09}") for i in range(500)]
    got = assign(spark.createDataFrame(rows, "kind string, canon string").repartition(3), KEY).collect()
    new = {(r["kind"], r["new"]) for r in got}
    assert len(got) == len(rows) == len(new) and not new & set(rows)
    assert any(r["draw"] > 0 for r in got)
    assert {tuple(r) for r in assign(spark.createDataFrame(rows[::-1], "kind string, canon string"), KEY).collect()} == {tuple(r) for r in got}


def test_report(spark):
    letters = " ".join(f"{chr(97 + i)}@x.com" for i in range(26))
    texts = [TEXT, None, "", "nothing here", letters, letters[:40], "word " * 100_000 + "q@x.com"]
    df = docs_of(spark, texts).withColumns({"kind": F.lit(1), "text_key": F.lit("x"), "draws": F.lit(2)})
    got = {r["doc_id"]: r for r in pii_report(df, KEY).collect()}
    assert [got[i]["text"] for i in (1, 2, 3)] == texts[1:4] and got[0]["n_name"] == 5 and got[0]["n_card"] == 3
    new = got[4]["text"].split()
    assert len(set(new)) == 26 and not set(new) & set(letters.split())
    assert got[5]["text"].split()[:4] == new[:4] and got[6]["text"].split()[-1] == new[letters.split().index("q@x.com")]
    assert pii_report(docs_of(spark, []), KEY).count() == 0
    twice = spark.createDataFrame([(None, "a@x.com", None, None, None)] * 2, DOCS)
    assert len({r["text"] for r in pii_report(twice, KEY).collect()}) == 1 and pii_report(twice, KEY).count() == 2


def test_whole_names_with_any_title(spark):
    found = lambda t: [(k[-1], t[a:b]) for a, b, k, _ in mentions(t) if k.startswith("name")]
    assert found("Mr. John Fitzgerald Kennedy said. Kennedy's speech, KENNEDY and kennedy") == [("m", "John"), ("m", "Fitzgerald"), ("s", "Kennedy"), ("s", "Kennedy"), ("s", "KENNEDY")]
    assert found("Dr. Maria del Carmen Lopez, Dr. J. R. Smith I, mrs  Anna\tBell") == [("n", "Maria"), ("n", "Carmen"), ("s", "Lopez"), ("i", "J"), ("i", "R"), ("s", "Smith"), ("f", "Anna"), ("s", "Bell")]
    assert found("MR. SMITH, Mr\nSmith, Mr O'Neil's dog, Frau Prof. Dr. Müller-Lüdenscheidt; Mr van der Berg") == [
        ("s", "SMITH"), ("s", "Smith"), ("s", "O'Neil"), ("s", "Müller-Lüdenscheidt"), ("s", "Berg")]
    assert found("Dr John Smith and Mr John Brown, John went") == [("m", "John"), ("s", "Smith"), ("m", "John"), ("s", "Brown"), ("m", "John")]
    assert found("I miss Paris. Miss Paris came. MR. X. said, Mr. mister") == [("s", "Paris"), ("s", "Paris")]
    new, _ = rewritten("Mr John Smith met Smith and J. Smith", {}, KEY)
    parts = new.split()
    assert "Smith" not in new and parts[2] == parts[4] == parts[7]
    hebrew, _ = rewritten("Mr אברהם כהן and כהן", {}, KEY)
    assert "כהן" not in hebrew and all(script_of(w) == "HEBREW" for w in hebrew.split()[1:3]) and hebrew.split()[2] == hebrew.split()[4]
    mail, _ = rewritten("иван@почта.рф", {}, KEY)
    assert mail.endswith(".рф") and all(script_of(c) == "CYRILLIC" for c in mail if c.isalpha()) and mail != "иван@почта.рф"


def test_digits_of_any_script():
    arabic = "id 1: ٠١٢-٣٤-٥٦٧٨ and ٩٩٩-٨٨-٧٧٧٧, card ٠١٢٣٤٥٦٧٨٩٠١٢٣, ٠١٢-34-٥٦٧٨ is 012-34-5678"
    new, old = rewritten(arabic, {}, KEY)
    assert [k for *_, k, _ in old] == ["ssn", "ssn", "card", "ssn", "ssn"] and len(new) == len(arabic)
    a, b = new[6:17], new[22:33]
    assert a != b and pii.ascii_digits(new)[6:17] == new[-11:] and all(0x660 <= ord(c) <= 0x669 for c in a + b if c != "-")
    assert rewritten("room 7, card ٠١٢٣٤٥٦٧٨٩٠١٢٣ end", {}, KEY)[0].startswith("room 7, card ")


def test_long_words_take_linear_time():
    for t in ("a" * 1_000_000 + "@", "a" * 1_000_000, "a@" * 300_000, "x.y" * 300_000 + "@b.c", "Mr " * 300_000, "1 " * 500_000, "Mr Ab" + "-b" * 300_000, "7" * 1_000_000, "AB12" * 200_000):
        began = time.time()
        mentions(t)
        assert time.time() - began < 20, t[:10]


def test_a_full_space_ends(spark):
    full = spark.range(65536).select(F.lit("ip").alias("kind"), F.concat_ws(".", F.lit("192.168"), F.col("id") % 256, F.floor(F.col("id") / 256)).alias("canon"))
    got = assign(full, KEY)
    n, distinct = got.agg(F.count("*"), F.countDistinct("new")).first()
    assert n == distinct == 65536 and got.join(full.select(F.col("canon").alias("new")), "new").count() == 0


def test_there_is_no_default_key(spark):
    with pytest.raises(ValueError):
        replace_pii(docs_of(spark, ["a@x.com"]))
    spark.conf.set("spark.quernstone.pii.key", "secret")
    try:
        assert configured_key(spark) == b"secret" and replace_pii(docs_of(spark, ["a@x.com"])).first()["text"] != "a@x.com"
    finally:
        spark.conf.unset("spark.quernstone.pii.key")


def test_equals_what_was_planted(spark):
    """Texts built of filler and known entities: spans are where these were put, all else is as it was, and entities map one to one."""
    r = random.Random(12)
    number = lambda *sizes, sep="-": sep.join("".join(r.choices("0123456789", k=k)) for k in sizes)
    pool = {
        "email": [f"user{i}@mail{i % 3}.example.com" for i in range(40)], "ssn": [number(3, 2, 4) for _ in range(30)], "ip": [f"{r.randint(1, 255)}.{r.randint(0, 255)}.{i}.{r.randint(0, 255)}" for i in range(30)],
        "phone": [f"+49 ({number(3)}) {number(3, 4)}" for _ in range(30)], "card": [number(4, 4, 4, 4, sep=" ") for _ in range(30)],
    }
    filler = "lorem ipsum the of 12 3.4 word, end. (x) q-r \n".split(" ")
    texts, want = [], []
    for _ in range(120):
        out, spans = "", []
        for _ in range(r.randint(0, 12)):
            out += " ".join(r.choices(filler, k=r.randint(1, 6))) + " ; "
            kind = r.choice(list(pool))
            entity = r.choice(pool[kind])
            spans.append((len(out), len(out) + len(entity), kind))
            out += entity + " ; "
        texts.append(out)
        want.append(spans)
    one: dict = {}
    for row in replace_pii(docs_of(spark, texts).repartition(4), KEY).collect():
        old, spans = texts[row["doc_id"]], want[row["doc_id"]]
        assert [(m["start_at"], m["end_at"], m["kind"]) for m in row["mentions"]] == spans
        at, new_at = 0, 0
        for start, end, kind in spans:
            gap = old[at:start]
            assert row["text"][new_at : new_at + len(gap)] == gap
            new_at += len(gap)
            stop = row["text"].index(" ;", new_at)
            one.setdefault((kind, old[start:end]), set()).add(row["text"][new_at:stop])
            at, new_at = end, stop
        assert row["text"][new_at:] == old[at:]
    assert all(len(v) == 1 for v in one.values())
    new = [(k, *v) for (k, _), v in one.items()]
    assert len(set(new)) == len(new) and not {n for _, n in new} & {e for _, e in one}


def test_one_surrogate_a_name_in_all_documents_and_under_all_titles(spark):
    texts = ["Mr. John Smith came.", "Dr. John Smith left, and John stayed.", "Prof. John spoke", "Mr. Thomas", "Mr. Thomas Miller", "Frau Kim Lee", "Mr. Kim Lee", "Dr. rer. nat. Müller and Müller", "Mr. O'Brien", "Dr. Pat O’Brien met O’Brien", "no name"]
    rows = {r["doc_id"]: r["text"] for r in replace_pii(docs_of(spark, texts).repartition(4), KEY).collect()}
    new = [rows[i] for i in range(len(texts))]
    words = [t.replace(",", "").replace(".", "").split() for t in new]
    john, smith = words[0][1:3]
    assert words[1][1:3] == [john, smith] and words[1][5] == john and words[2][1] == john and john != "John"
    assert words[3][1] == words[4][1] != "Thomas" and words[4][2] != words[4][1]
    assert words[5][1:3] == words[6][1:3] and words[5][1] != "Kim"
    assert new[7].startswith("Dr. rer. nat. ") and "Müller" not in new[7] and words[7][3] == words[7][5]
    assert words[8][1] == words[9][2] == words[9][4] and "Brien" not in new[8] + new[9]
    assert new[10] == "no name"
    again = {r["doc_id"]: r["text"] for r in replace_pii(docs_of(spark, texts[::-1]), KEY).collect()}
    assert [again[len(texts) - 1 - i] for i in range(len(texts))] == new
