import pytest

from quernstone.operators import evaluation
from quernstone.operators.evaluation import SAMPLE, Pace, Worker
from quernstone.providers import METRICS, ExtractiveGenerator, OverlapJudge, RetryPolicy
from quernstone.storage import new_folder


class Service:
    """Refuses calls that come less than ``gap`` seconds of its own time after the last one, and says how long to wait."""

    def __init__(self, gap, own, broken=()):
        self.time, self.last, self.gap, self.own, self.broken, self.refused = 0.0, -1e9, gap, own, broken, 0

    def sleep(self, seconds):
        self.time += seconds

    def _taken(self):
        if self.time - self.last < self.gap:
            self.refused += 1
            assert self.refused < 2, "refused twice in a row"
            raise RuntimeError(f"429 rate limit, retry in {self.gap}")
        self.last, self.refused = self.time, 0

    def answer(self, question, context, images):
        self._taken()
        if question in self.broken:
            raise RuntimeError("this one is broken")
        return self.own.answer(question, context, images)

    def score(self, metric, question, *rest):
        self._taken()
        if question in self.broken and metric == "faithfulness":
            raise RuntimeError("401 invalid api key")
        return float("nan") if question == "nan" else self.own.score(metric, question, *rest)


def factory(own, gap=3.0, rpm=60.0, broken=()):
    def make(key):
        service = Service(gap, own, broken)
        return Worker(service, RetryPolicy(3, 65.0, service.sleep), Pace(rpm, service.sleep, lambda: service.time))

    return make


def samples(spark, n):
    return spark.createDataFrame([(f"q{i:03d}", f"question {i}", f"[1] line {i}\nmore", [f"line {i}"], [], f"line {i}") for i in range(n)], SAMPLE)


def test_every_sample_is_answered_by_its_key(spark):
    rows = samples(spark, 23)
    got = {r["id"]: r for r in evaluation.answers(rows, new_folder(spark, "answers"), 3, factory(ExtractiveGenerator()), wave=4).collect()}
    assert len(got) == 23 and [got[f"q{i:03d}"]["worker"] for i in range(6)] == [0, 1, 2, 0, 1, 2]
    assert got["q007"]["answer"] == "question 7\n[1] line 7" and {r["error"] for r in got.values()} == {None} and max(r["run"] for r in got.values()) == 2


def test_errors_stay_with_their_sample_and_are_tried_again(spark):
    out, rows = new_folder(spark, "answers"), samples(spark, 10)
    first = evaluation.answers(rows, out, 2, factory(ExtractiveGenerator(), broken=("question 4",)))
    assert {r["id"]: r["error"] for r in first.collect() if r["error"]} == {"q004": "this one is broken"}
    asked = []
    again = evaluation.answers(samples(spark, 12), out, 2, factory(ExtractiveGenerator()))
    got = {r["id"]: r for r in again.collect()}
    asked = sorted(i for i, r in got.items() if r["run"] > 1)
    assert asked == ["q004", "q010", "q011"] and len(got) == 12 and not any(r["error"] for r in got.values())
    before = evaluation.written(spark, out, evaluation._ANSWER).count()
    evaluation.answers(samples(spark, 12), out, 2, factory(ExtractiveGenerator())).collect()
    assert evaluation.written(spark, out, evaluation._ANSWER).count() == before


def test_an_interrupted_run_costs_a_wave(spark, monkeypatch):
    out, rows = new_folder(spark, "answers"), samples(spark, 12)
    real, calls = evaluation.generate, []

    def stops(own, keys, make):
        calls.append(1)
        if len(calls) == 3:
            raise KeyboardInterrupt
        return real(own, keys, make)

    monkeypatch.setattr(evaluation, "generate", stops)
    with pytest.raises(KeyboardInterrupt):
        evaluation.answers(rows, out, 2, factory(ExtractiveGenerator()), wave=2)
    assert evaluation.written(spark, out, evaluation._ANSWER).count() == 8
    assert evaluation.answers(rows, out, 2, factory(ExtractiveGenerator()), wave=2).count() == 12
    assert evaluation.written(spark, out, evaluation._ANSWER).count() == 12


def test_judgements_keep_errors_by_metric(spark):
    rows = samples(spark, 5).selectExpr("*", "question AS answer")
    odd = rows.where("id = 'q000'").selectExpr("'z' AS id", "'nan' AS question", "context", "contexts", "images", "reference_answer", "answer")
    out = new_folder(spark, "scores")
    got = {r["id"]: r for r in evaluation.judgements(rows.unionByName(odd), out, 2, factory(OverlapJudge(), gap=0.0, broken=("question 1",))).collect()}
    assert set(got["q002"]["scores"]) == set(METRICS) and got["q002"]["errors"] == {} and got["q002"]["scores"]["context_recall"] == 1.0
    assert got["q001"]["errors"] == {"faithfulness": "401 invalid api key"} and set(got["q001"]["scores"]) == set(METRICS) - {"faithfulness"}
    assert set(got["z"]["scores"].values()) == {None}
    scored = spark.createDataFrame([(i, {m: s for m in METRICS}) for i, s in (("a", 1.0), ("b", 0.5), ("c", None))], "id string, scores map<string,double>")
    traces = spark.createDataFrame([("a", "x"), ("b", "out_of_scope"), ("c", "x"), ("d", "")], "id string, domain string")
    report = {(r["section"], r["key"]): (r["n"], r["completed"], r["faithfulness"]) for r in evaluation.report(traces, scored).collect()}
    assert report == {("all", None): (4, 3, 0.75), ("in_scope", None): (3, 2, 1.0), ("out_of_scope", None): (1, 1, 0.5), ("domain", "x"): (2, 2, 1.0), ("domain", "out_of_scope"): (1, 1, 0.5), ("domain", "unknown"): (1, 0, None)}


def test_pace_and_keys():
    now, slept = [0.0], []
    pace = Pace(30, lambda s: (slept.append(s), now.__setitem__(0, now[0] + s)), lambda: now[0])
    for _ in range(4):
        pace.wait()
    assert slept == [2.0, 2.0, 2.0]
    now[0] += 100
    pace.wait()
    assert len(slept) == 3

    def check(key):
        if key == "bad":
            raise RuntimeError("401 UNAUTHENTICATED")

    policy = RetryPolicy(1, 0, lambda s: None)
    assert evaluation.usable_keys([" a", "bad", "", "a", "b"], check, policy) == ["a", "b"] and evaluation.usable_keys(["a", "b"], check, policy, 1) == ["a"]
    with pytest.raises(ValueError):
        evaluation.usable_keys(["bad"], check, policy)


def test_empty(spark):
    assert evaluation.answers(samples(spark, 0), new_folder(spark, "answers"), 2, factory(ExtractiveGenerator())).count() == 0
