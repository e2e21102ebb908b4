"""Queries on evaluation: answers and judgements of samples by rate-limited workers, and their report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.operators import evaluation
from quernstone.operators.evaluation import Pace, Worker
from quernstone.plans.registry import TERMS, query
from quernstone.providers import METRICS, ExtractiveGenerator, OverlapJudge, RetryPolicy
from quernstone.sources.tables import table
from quernstone.storage import new_folder

#: Keys of the offline services, and calls a minute: these have no limit.
KEYS, NO_LIMIT = 4, 1e9

_SAMPLES = r"""samples AS (
  SELECT conv_id || ':' || turn AS id, text AS question, coalesce(before, '') AS before, coalesce(after, '') AS reference,
         CASE conv_id % 4 WHEN 0 THEN 'out_of_scope' WHEN 1 THEN '' ELSE 'd' || conv_id % 3 END AS domain,
         array_to_string(list_concat([text], regexp_extract_all('[1] ' || coalesce(before, ''), '(?m)^\[\d+\].*$')), chr(10)) AS answer
  FROM (SELECT *, lag(text) OVER w AS before, lead(text) OVER w AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'
)"""
_SHARE = "len(list_intersect({0}, {1}))::DOUBLE / greatest(1, least(len({0}), len({1})))"
_SCORED = f"""terms AS (
  SELECT id, domain, answer, list_distinct({TERMS.format('question')}) AS q, list_distinct({TERMS.format('answer')}) AS a, list_distinct({TERMS.format('before')}) AS c, list_distinct({TERMS.format('reference')}) AS r FROM samples
), scored AS (
  SELECT id, domain, answer, {_SHARE.format('a', 'c')} AS faithfulness, {_SHARE.format('a', 'q')} AS answer_relevancy, {_SHARE.format('c', 'r')} AS context_precision, {_SHARE.format('r', 'c')} AS context_recall FROM terms
)"""
_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in METRICS)


def _samples(spark: SparkSession, folder: str) -> DataFrame:
    """User turns: the turn before is the context, the turn behind is the reference."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    some = lambda c: F.coalesce(c, F.lit(""))
    rows = table(spark, folder, "conversations").withColumns({"before": some(F.lag("text").over(by)), "reference_answer": some(F.lead("text").over(by))}).where("role = 'user'")
    domain = F.when(F.col("conv_id") % 4 == 0, "out_of_scope").when(F.col("conv_id") % 4 == 1, "").otherwise(F.concat(F.lit("d"), F.col("conv_id") % 3))
    return rows.select(
        F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.concat(F.lit("[1] "), "before").alias("context"), F.array("before").alias("contexts"),
        F.array().cast("array<string>").alias("images"), "reference_answer", domain.alias("domain"),
    )


def _generator(key: int) -> Worker:
    return Worker(ExtractiveGenerator(), RetryPolicy(evaluation.MOST_RETRIES), Pace(NO_LIMIT))


def _judge(key: int) -> Worker:
    return Worker(OverlapJudge(), RetryPolicy(evaluation.MOST_RETRIES), Pace(NO_LIMIT))


def _scored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    samples = _samples(spark, folder)
    answered = evaluation.answers(samples, new_folder(spark, "answers"), KEYS, _generator, wave=1_000_000)
    scored = evaluation.judgements(samples.join(answered.select("id", "answer"), "id"), new_folder(spark, "scores"), KEYS, _judge, wave=1_000_000)
    return samples, answered.select("id", "answer").join(scored.select("id", "scores"), "id")


@query(f"WITH {_SAMPLES}, {_SCORED} SELECT id, answer, {', '.join(METRICS)} FROM scored")
def sample_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Answers and metrics of each sample, by the offline services."""
    return _scored(spark, folder)[1].select("id", "answer", *[F.col("scores")[m].alias(m) for m in METRICS])


@query(f"""WITH {_SAMPLES}, {_SCORED}
SELECT 'all' AS section, NULL AS key, count(*) AS n, count(*) AS completed, {_MEANS} FROM scored
UNION ALL SELECT CASE WHEN domain = 'out_of_scope' THEN 'out_of_scope' ELSE 'in_scope' END, NULL, count(*), count(*), {_MEANS} FROM scored GROUP BY 1
UNION ALL SELECT 'domain', CASE WHEN domain = '' THEN 'unknown' ELSE domain END, count(*), count(*), {_MEANS} FROM scored GROUP BY 2""")
def evaluation_report(spark: SparkSession, folder: str) -> DataFrame:
    """Means of all samples, in and out of scope, and by domain."""
    made = evaluation.report(*_scored(spark, folder))
    return made.select("section", "key", "n", "completed", *[F.round(m, 6).alias(m) for m in METRICS])
