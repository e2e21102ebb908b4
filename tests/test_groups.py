import json
import os

import pytest

from quernstone.streaming.groups import END, STATE, closed_groups

ROW = "source string, facility string, nth long, value double"


def fold(key, rows):
    return {"n": len(rows), "total": float(rows["value"].sum()), "first": int(rows["nth"].min())}


@pytest.fixture
def stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k, v in STATE.items():
        spark.conf.set(k, v)
    names = []

    def arrive(rows):
        names.append(f"{len(names):03d}.json")
        at = tmp_path / "in" / names[-1]
        at.write_text("\n".join(json.dumps(dict(zip(("source", "facility", "nth", "value"), r, strict=True))) for r in rows))
        os.utime(at, (1_700_000_000 + len(names),) * 2)  # files are taken in the order of their time

    def run(strict=True):
        rows = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        made = closed_groups(rows, "source", "facility", "nth", fold, "n long, total double, first long", strict)
        made.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["source"], r["first"], r["facility"], r["n"], r["total"], r["again"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    yield arrive, run
    for k in STATE:
        spark.conf.unset(k)


def plain(rows):
    out = []
    for source in sorted({r[0] for r in rows}):
        groups = []
        for _, key, nth, value in sorted((r for r in rows if r[0] == source), key=lambda r: r[2]):
            if key == END:
                break
            if not groups or groups[-1][0] != key:
                groups.append((key, []))
            groups[-1][1].append((nth, value))
        out += [(source, g[0][0], key, len(g), sum(v for _, v in g), False) for key, g in groups]
    return sorted(out)


def test_equal_to_the_batch_fold_over_batches_and_a_restart(stream):
    arrive, run = stream
    rows = [("s", f"f{n // 7}", n, float(n)) for n in range(60)] + [("t", "only", n, 1.0) for n in range(5)]
    ends = [("s", END, 1000, None), ("t", END, 1000, None)]
    for lo, hi in ((0, 3), (3, 20), (20, 21)):
        arrive([r for r in rows if lo <= r[2] < hi])
    assert [g[2] for g in run()] == ["f0", "f1"]  # the third is open
    arrive([r for r in rows if r[2] >= 21])
    arrive(ends)
    assert run() == plain(rows + ends)


def test_a_key_that_comes_again(stream):
    arrive, run = stream
    arrive([("s", "a", 1, 1.0), ("s", "b", 2, 1.0)])
    run()
    arrive([("s", "a", 3, 1.0), ("s", END, 4, None)])
    with pytest.raises(Exception, match="comes again"):
        run()
    assert [g[2:] for g in run(strict=False)] == [("a", 1, 1.0, False), ("b", 1, 1.0, False), ("a", 1, 1.0, True)]


def test_rows_out_of_order(stream):
    arrive, run = stream
    arrive([("s", "a", 5, 1.0)])
    run()
    arrive([("s", "b", 5, 1.0)])
    with pytest.raises(Exception, match="out of order"):
        run()
