import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from quernstone.llm.line_dedup import NO_ID, kept_text, line_dedup, line_report, pack, unpack
from tests.llm.helpers import DOCS, docs_of, rows_of

SPACE = " \t\n\r\x0b\x0c"


def brute(rows):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE))
    firsts = defaultdict(lambda: NO_ID)
    of = lambda i: NO_ID if i is None else i
    for i, text in rows:
        for line in (text or "").split("\n"):
            firsts[key(line)] = min(firsts[key(line)], of(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or of(i) <= firsts[key(x)]]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_equals_brute_force(spark):
    r = random.Random(4)
    pool = [f"{'  ' * (i % 3)}Shared line nr {i}\t" for i in range(30)] + ["short", "", "ÉÉÉÉÉÉÉÉÉ", "ÉÉÉÉÉÉÉÉÉÉ", "A very common line", "a VERY common line\r"]
    texts = ["\n".join(r.choices(pool, k=r.randint(0, 30))) for _ in range(200)] + [None, "", "\n\n", "own long line number one\nown long line number one"]
    df = docs_of(spark, texts).repartition(6).withColumns({"doc": F.lit(1), "at": F.lit("x"), "n_lines": F.lit(None).cast("int")})
    assert rows_of(line_report(df)) == brute(list(enumerate(texts)))


def test_one_hash_over_many_partitions(spark):
    texts = ["the same line everywhere\n" * 3 + f"own line {i:05}" for i in range(500)]
    assert rows_of(line_report(docs_of(spark, texts))) == brute(list(enumerate(texts)))


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "a line that repeats\nx", "e", "s", 1)] * 2 + [(1, "y\na line that repeats", None, None, None), (None, "a line that repeats\nlast long line here", None, None, None), (None, "last long line here", None, None, None), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    assert rows_of(line_report(df)) == brute([r[:2] for r in rows])


def test_empty_table_and_bitmaps(spark):
    assert line_report(docs_of(spark, [])).count() == 0
    for n, gone in ((1, []), (1, [0]), (9, [0, 8]), (100_000, list(range(0, 100_000, 2)))):
        assert [i for i, k in enumerate(unpack(n, pack(n, gone))) if not k] == gone
    text = "one long line here\n" * 50_000
    row = line_dedup(docs_of(spark, [text, text])).orderBy("doc").collect()[1]
    assert row["n_dropped"] == 50_000 and kept_text(text, row["n_lines"], row["keep"]) == "" and len(row["keep"]) < 100
