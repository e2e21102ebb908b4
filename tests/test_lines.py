import os

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quernstone.streaming.lines import Lines, LineWriter, batches, read_lines

ROW = "chunk_id string, indices array<int>, note string"


def rows(*names):
    return iter([Row(chunk_id=n, indices=[1, 2], note="é\n") for n in names])


def ids(spark, path):
    return sorted(r["chunk_id"] for r in read_lines(spark, path, ROW).collect())


def test_commits_and_repeats(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    sink = LineWriter(path)
    assert batches(path) == {} and ids(spark, path) == []
    first = [sink.write(rows("a", "b")), sink.write(rows()), sink.write(rows("c"))]
    assert ids(spark, path) == []  # written, not committed
    sink.commit(first, 0)
    assert ids(spark, path) == ["a", "b", "c"] and batches(path) == {0: 3}
    sink.commit([sink.write(rows("a", "b", "c"))], 0)  # the batch is run again: its checkpoint was lost
    assert ids(spark, path) == ["a", "b", "c"]
    lost = [sink.write(rows("x")), None]
    sink.abort(lost, 1)
    assert os.listdir(tmp_path / "out" / "_pending") == []
    # an attempt that ended between moving its files and its marker
    half = sink.write(rows("half"))
    os.makedirs(tmp_path / "out" / "batch=1")
    os.rename(half.file, tmp_path / "out" / "batch=1" / "part-00000.jsonl")
    assert ids(spark, path) == ["a", "b", "c"]
    sink.commit([sink.write(rows("d"))], 1)
    sink.commit([sink.write(rows())], 2)
    assert ids(spark, path) == ["a", "b", "c", "d"] and batches(path) == {0: 3, 1: 1, 2: 0}
    assert read_lines(spark, path, ROW).first()["note"] == "é\n"


def test_a_task_that_fails_leaves_nothing_and_a_restart_goes_on(spark, tmp_path):
    spark.dataSource.register(Lines)
    source, out, flag = tmp_path / "in", f"file://{tmp_path}/out", str(tmp_path / "healed")
    source.mkdir()
    for n in range(4):
        spark.createDataFrame([(f"{n}-{i}", [i], "") for i in range(50)], ROW).coalesce(1).write.mode("append").parquet(str(source))

    @F.udf("string")
    def breaks(name):
        if name == "2-40" and not os.path.exists(flag):
            raise RuntimeError("the task ends in the middle of its lines")
        return name

    def run():
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 2).parquet(str(source)).withColumn("chunk_id", breaks("chunk_id"))
        stream.writeStream.format("quern_lines").option("path", out).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception, match="middle of its lines"):
        run()
    before = ids(spark, out)
    assert len(before) == len(set(before)) and len(before) % 50 == 0 and len(before) < 200
    open(flag, "w").close()
    run()
    assert ids(spark, out) == sorted(f"{n}-{i}" for n in range(4) for i in range(50))
    # those that are there need not be made again
    todo = spark.createDataFrame([("0-1",), ("new",)], "chunk_id string").join(read_lines(spark, out, ROW), "chunk_id", "left_anti")
    assert [r[0] for r in todo.collect()] == ["new"]
