"""Answers and judgements of many samples by services that limit their rate, as jobs that can stop at any time.

Samples are dealt to keys in turn. All samples of a key go through one task, one after the other, so that a key's budget is kept by
the task that uses it, however many tasks run. What a service refuses for its rate or in passing is tried again after the
pause that it asks for; any other error is the sample's result, in its own column, and leaves the others alone.

Samples are sent in waves of ``wave`` a key, and each wave is appended to a table when it is done. A later run takes only samples that are not
there yet or failed, so a stop costs a wave.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import quality
from quernstone.operators.store import last_wins
from quernstone.providers import METRICS, Generator, Judge, RetryPolicy
from quernstone.storage import checkpoint_folder, numbered

#: Calls a minute that are safe for a key, and how often a call is repeated.
SAFE_RPM, MOST_RETRIES = 13, 10


@dataclass
class Pace:
    """Calls of one key, spread so that there are at most so many a minute. Waiting is left to ``sleep``."""

    per_minute: float = SAFE_RPM
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _next: float = field(default=-math.inf, init=False)

    def wait(self) -> None:
        now = self.clock()
        if now < self._next:
            self.sleep(self._next - now)
        self._next = max(now, self._next) + 60 / self.per_minute


@dataclass
class Worker:
    """What a task calls for one key. It is made in the task, so it need not be sent there."""

    service: Generator | Judge
    policy: RetryPolicy
    pace: Pace

    def call(self, operation: Callable[[], object]) -> object:
        def paced() -> object:
            self.pace.wait()
            return operation()

        return self.policy.run(paced)


#: From the number of a key to its worker.
Factory = Callable[[int], Worker]

SAMPLE = "id string, question string, context string, contexts array<string>, images array<string>, reference_answer string"
_ANSWER = "id string, worker long, answer string, error string"
_SCORES = "id string, worker long, scores map<string,double>, errors map<string,string>"


def dealt(samples: DataFrame, keys: int) -> DataFrame:
    """Samples with their worker, in turn by id, and their wave's number among the worker's samples (from 0)."""
    placed = numbered(samples, F.col("id"), "quern_at")
    return placed.withColumns({"worker": F.pmod("quern_at", F.lit(keys)).cast("long"), "nth": F.floor(F.col("quern_at") / keys)}).drop("quern_at")


def _through_workers(rows: DataFrame, keys: int, factory: Factory, each: Callable[[Worker, dict], dict], schema: str) -> DataFrame:
    """``each`` of all rows; a worker's rows lie in one task, in order, and stream through it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        workers: dict[int, Worker] = {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                n = row["worker"]
                if n not in workers:
                    workers[n] = factory(n)
                out.append({"id": row["id"], "worker": n} | each(workers[n], row))
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kind = to_arrow_schema(StructType.fromDDL(schema))
    return rows.repartition(keys, "worker").sortWithinPartitions("worker", "nth").mapInArrow(run, schema)


def _answer(worker: Worker, row: dict) -> dict:
    try:
        return {"answer": worker.call(lambda: worker.service.answer(row["question"], row["context"] or "", row["images"] or [])), "error": None}
    except Exception as error:
        return {"answer": None, "error": str(error)}


def generate(samples: DataFrame, keys: int, factory: Factory) -> DataFrame:
    """(id, worker, answer, error) of samples with worker and nth, see ``dealt``."""
    return _through_workers(samples.select("id", "worker", "nth", "question", "context", "images"), keys, factory, _answer, _ANSWER)


def judge(samples: DataFrame, keys: int, factory: Factory, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """(id, worker, scores, errors): an error of one metric leaves the others; a score that is no finite number is null.

    samples: with answer, contexts and reference_answer. Null texts are empty.
    """

    def each(worker: Worker, row: dict) -> dict:
        scores: dict[str, float | None] = {}
        errors: dict[str, str] = {}
        for m in metrics:
            try:
                value = worker.call(lambda m=m: worker.service.score(m, row["question"] or "", row["answer"] or "", row["contexts"] or [], row["reference_answer"] or ""))
                scores[m] = value if math.isfinite(value) else None
            except Exception as error:
                errors[m] = str(error)
        return {"scores": list(scores.items()), "errors": list(errors.items())}

    return _through_workers(samples.select("id", "worker", "nth", "question", "answer", "contexts", "reference_answer"), keys, factory, each, _SCORES)


def written(spark: SparkSession, out: str, schema: str) -> DataFrame:
    """What runs have left; no rows before the first."""
    try:
        return spark.read.schema(f"{schema}, run long").parquet(out)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], f"{schema}, run long")
        raise


def _resumed(samples: DataFrame, out: str, schema: str, good: Column, keys: int, wave: int, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs ``work`` on the samples that have no good row in ``out`` yet, wave by wave; the newest row of each sample."""
    spark = samples.sparkSession
    checkpoint_folder(spark)
    have = written(spark, out, schema)
    last = have.agg(F.max("run")).first()[0] or 0
    todo = dealt(samples.join(have.where(good).select("id").distinct(), "id", "left_anti"), keys).checkpoint()
    waves = -(-(todo.agg(F.max("nth") + 1).first()[0] or 0) // wave)
    for n in range(int(waves)):
        own = todo.where((F.col("nth") >= n * wave) & (F.col("nth") < (n + 1) * wave))
        work(own).withColumn("run", F.lit(last + n + 1).cast("long")).write.mode("append").parquet(out)
    return last_wins(written(spark, out, schema), ["id"], "run")


def answers(samples: DataFrame, out: str, keys: int, factory: Factory, wave: int = 100) -> DataFrame:
    """(id, worker, answer, error, run) of all samples (columns of SAMPLE, distinct ids); those without an error in ``out`` are not asked again."""
    return _resumed(samples, out, _ANSWER, F.col("error").isNull(), keys, wave, lambda rows: generate(rows, keys, factory))


def judgements(samples: DataFrame, out: str, keys: int, factory: Factory, metrics: tuple[str, ...] = METRICS, wave: int = 100) -> DataFrame:
    """(id, worker, scores, errors, run) of all samples (SAMPLE and answer); those with every metric in ``out`` are not judged again."""
    return _resumed(samples, out, _SCORES, quality.completed(F.col("scores"), metrics), keys, wave, lambda rows: judge(rows, keys, factory, metrics))


def report(samples: DataFrame, scored: DataFrame, metrics: tuple[str, ...] = METRICS, out_of_scope: str = "out_of_scope") -> DataFrame:
    """(section, key, n, completed, a mean of each metric): all samples, those in and out of scope, and each domain.

    samples: id, domain; scored: id, scores, with no row for samples that were not judged. Blank domains are ``unknown``.
    """
    rows = samples.select("id", "domain").join(scored.select("id", "scores"), "id", "left")
    means = {m: F.col("scores")[m] for m in metrics} | {"completed": F.when(quality.completed(F.col("scores"), metrics), 1.0).otherwise(0.0)}
    inside = quality.in_scope(F.col("domain"), out_of_scope)

    def part(section: str, of: DataFrame, by: Column | None = None) -> DataFrame:
        found = quality.metric_averages(of, means, by)
        key = F.col("key") if by is not None else F.lit(None).cast("string")
        return found.select(F.lit(section).alias("section"), key.alias("key"), "n", F.round(F.col("completed") * F.col("n")).cast("long").alias("completed"), *metrics)

    parts = [part("all", rows), part("in_scope", rows.where(inside)), part("out_of_scope", rows.where(~inside)), part("domain", rows, F.col("domain"))]
    return reduce(DataFrame.unionByName, parts)


def usable_keys(keys: list[str], check: Callable[[str], None], policy: RetryPolicy, most: int | None = None) -> list[str]:
    """The distinct keys, in order, that a call with them accepts; blank ones are left out. Fails if none is left."""
    out: list[str] = []
    for key in dict.fromkeys(k.strip() for k in keys):
        if not key or (most is not None and len(out) == most):
            continue
        try:
            policy.run(lambda key=key: check(key))
        except Exception as error:
            if policy.pause(error) is None:
                continue
        out.append(key)
    if not out:
        raise ValueError("no key is accepted")
    return out
