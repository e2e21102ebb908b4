"""Mixing sources to target weights by balanced sampling with the cube method.

Every source has a target of words. A document of a source with target/size ratio r is
taken floor(r) times, and once more with inclusion probability r - floor(r). Which
documents get that extra turn is decided by the cube method: probabilities move in the
null space of the constraints (number of documents, number of words), which keeps both
totals as they are, until all but a few are 0 or 1 (flight). The last few are landed
on the corner with the smallest imbalance.

Flight runs in blocks of one source, so a hot source is many tasks; each block leaves at
most two documents undecided, which meet in fewer blocks in the next round, until each
source has one block. Blocks, orders and random moves come from hashes of the rows and a
seed: reruns agree, however the table is partitioned.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernstone.llm.common import materialize, n_words, release, row_hash, sized

MOST = 3
WEIGHTS = (1, 2, 3)
BLOCK = 2048
SEED = 20_240_101
EPS = 1e-9


def source_targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, weight, target).

    Weights repeat over the sources in code-point order, null last. Targets share the
    sum of all sizes by weight, none above ``most`` times its source's size. With
    c = most*size/weight, the sources of the smallest c are capped; the common level of
    the others is the first one that is at most the next c.
    """
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumns({
        "weight": F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int")),
        "size": F.col("source_size").cast("double"),
    }).withColumn("cap", most * F.col("size") / F.col("weight"))
    before = Window.orderBy("cap", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    level = (F.sum("size").over(whole) - F.coalesce(most * F.sum("size").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level)
    common = F.min(F.when(F.col("level") <= F.col("cap"), F.struct("cap", "level"))).over(whole)["level"]
    return ranked.withColumn("common", common).select(
        "source", "source_size", "weight",
        F.least(most * F.col("size"), F.coalesce(F.col("common") * F.col("weight"), most * F.col("size"))).alias("target"),
    )


def flight(sizes: np.ndarray, chances: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves chances of (0, 1) until at most two stay inside, keeping their sum and the sum of chances*sizes."""
    out = chances.copy()
    scale = max(1.0, float(np.max(sizes, initial=0)))
    left = [int(i) for i in np.flatnonzero((out > EPS) & (out < 1 - EPS))]
    draws = iter(rng.random(2 * len(left) + 2))
    held: list[int] = []
    for i in left:
        held.append(i)
        if len(held) < 3:
            continue
        x, p = [float(sizes[j]) / scale for j in held], [float(out[j]) for j in held]
        move = (x[2] - x[1], x[0] - x[2], x[1] - x[0])
        if max(map(abs, move)) < 1e-12:
            move = (1.0, -1.0, 0.0)
        up = min((1 - q) / m if m > 0 else -q / m for q, m in zip(p, move, strict=True) if abs(m) > 1e-15)
        down = min(q / m if m > 0 else (q - 1) / m for q, m in zip(p, move, strict=True) if abs(m) > 1e-15)
        step = up if next(draws) * (up + down) < down else -down
        for j, q, m in zip(held, p, move, strict=True):
            q += step * m
            out[j] = 0.0 if q <= EPS else 1.0 if q >= 1 - EPS else q
        held = [j for j in held if EPS < out[j] < 1 - EPS]
    return out


def landing(sizes: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """The corner of the undecided few with the smallest imbalance of words, then of documents."""
    out = chances.copy()
    open_at = np.flatnonzero((out > EPS) & (out < 1 - EPS))
    if len(open_at):
        words, count = float(out[open_at] @ sizes[open_at]), float(out[open_at].sum())
        corner = min(itertools.product((0.0, 1.0), repeat=len(open_at)), key=lambda c: (abs(float(np.dot(c, sizes[open_at])) - words), abs(sum(c) - count), c))
        out[open_at] = corner
    return np.rint(np.clip(out, 0, 1))


def _round(block: int, land: bool, seed: int, units: DataFrame, n: DataFrame, k: int) -> DataFrame:
    """One flight over the undecided units of every source, in blocks of about ``block``."""

    def move(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["order", "doc_id", "row", "nth"], kind="stable", na_position="last")
        sizes, chances = group["size"].to_numpy(float), group["chance"].to_numpy(float)
        moved = flight(sizes, chances, np.random.default_rng(abs(int(group["order"].iloc[0])) + seed + k))
        group["chance"] = landing(sizes, moved) if land or group["blocks"].iloc[0] == 1 else moved
        return group[["doc_id", "row", "nth", "source", "size", "base", "chance", "order"]]

    dealt = (
        units.join(n, F.col("source").eqNullSafe(F.col("n_source"))).drop("n_source")
        .withColumn("block", F.pmod(F.xxhash64("order", F.lit(seed + k)), "blocks"))
    )
    return dealt.groupBy("source", "block").applyInPandas(move, units.schema)


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, row (hash of all columns), source, size, source_size, target, copies.

    Needs columns doc_id, text and source; others take part in the row's hash only. Size
    is the number of words; a null or empty text has 0. Documents of size 0 weigh
    nothing and are taken like others of their source. A null source is a source of its
    own, the last. Repeated rows are separate documents, told apart by a running
    number. An empty table gives no rows; sources without words have target 0 and
    copies 0. A document larger than its source's target is taken or not as a whole.
    """
    rows = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), row_hash(docs).alias("row")), "sizes")
    targets = materialize(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    n_sources = targets.count()
    ratio = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    ratio = F.when(F.abs(ratio - F.round(ratio)) < EPS, F.round(ratio)).otherwise(ratio)
    base = F.floor(ratio).cast("int")
    units = (
        rows.groupBy("doc_id", "row", "source", "size").agg(F.count("*").alias("alike"))
        .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("alike").cast("int")))).drop("alike")
        .join(sized(targets.select(F.col("source").alias("t_source"), base.alias("base"), (ratio - base).alias("chance")), n_sources), F.col("source").eqNullSafe(F.col("t_source")))
        .withColumn("order", F.xxhash64("doc_id", "row", "nth", F.lit(seed)))
        .select("doc_id", "row", "nth", "source", "size", "base", "chance", "order")
    )
    units = materialize(units, "units")
    inside = (F.col("chance") > EPS) & (F.col("chance") < 1 - EPS)
    done, k = [units.where(~inside)], 0
    open_units = units.where(inside)
    while True:
        counts = open_units.groupBy("source").agg(F.count("*").alias("n"))
        blocks = materialize(counts.select(F.col("source").alias("n_source"), F.ceil(F.col("n") / block).alias("blocks")), "blocks")
        largest = blocks.agg(F.max("blocks")).first()[0] or 0
        if not largest:
            break
        moved = materialize(_round(block, largest == 1, seed, open_units, sized(blocks, n_sources), k), f"flight{k}")
        done.append(moved.where(~inside))
        open_units, k = moved.where(inside), k + 1
        release(blocks)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    result = result.join(sized(targets.select(F.col("source").alias("t_source"), "source_size", "target"), n_sources), F.col("source").eqNullSafe(F.col("t_source")))
    return result.select("doc_id", "row", "source", "size", "source_size", "target", (F.col("base") + F.rint("chance")).cast("int").alias("copies"))


def mix_report(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", F.col("size").cast("long"), F.col("source_size").cast("long"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "source")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as many times as the mix takes it, with the columns of docs.

    Null and empty texts have no words and are taken in their source's share; a null source is one of its own; of repeated rows
    as many stay as are taken in all; an empty table stays empty. Columns of docs may have any names.
    """
    from quernstone.llm.common import fresh

    key, copies, at = fresh(docs, "quern_row"), fresh(docs, "quern_copies"), fresh(docs, "quern_nth")
    taken = mix(docs, **options).groupBy(F.col("row").alias(key)).agg(F.sum("copies").cast("int").alias(copies)).where(F.col(copies) > 0)
    rows = docs.withColumn(key, row_hash(docs))
    first = Window.partitionBy(key).orderBy(key)
    return (
        rows.join(taken, key).withColumn(at, F.row_number().over(first)).where(F.col(at) == 1)
        .withColumn(at, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])
    )
