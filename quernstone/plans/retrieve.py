"""Retrieval for many queries in one plan: search, fusion, parents, rerank, cited context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.operators import fusion, search
from quernstone.providers import OverlapReranker, Reranker, RetrievalConfig
from quernstone.storage import pinned


def retrieve(queries: DataFrame, chunks: DataFrame, parents: DataFrame, config: RetrievalConfig | None = None, reranker: Reranker | None = None) -> DataFrame:
    """(query_id, parent_id, child_ids, best_score, relevance, rank): the parents that answer each query best.

    queries: query_id, text, vector, weights; chunks: id, parent_id, source, vector, weights;
    parents: parent_id, text. ``config.sources`` limits the sources; none is no limit.
    """
    config = config or RetrievalConfig()
    rows = fusion.only(chunks, "source", list(config.sources))
    lists = {
        "dense": search.dense_topk(queries.select("query_id", "vector"), rows.select("id", "vector"), config.dense_limit),
        "sparse": search.sparse_topk(queries.select("query_id", "weights"), rows.select("id", "weights"), config.sparse_limit),
    }
    return answers(lists, queries, rows, parents, config, reranker)


def answers(lists: dict[str, DataFrame], queries: DataFrame, parent_of: DataFrame, parents: DataFrame, config: RetrievalConfig | None = None, reranker: Reranker | None = None) -> DataFrame:
    """What ``retrieve`` makes of the lists (query_id, id, rank, score) of its searches, where these have run on tables of their own.

    queries: query_id, text; parent_of: id, parent_id (chunks without a parent drop out); parents: parent_id, text.
    """
    config, reranker = config or RetrievalConfig(), reranker or OverlapReranker()
    found = fusion.expand_parents(fusion.rrf(lists, config.fused_limit), parent_of.select("id", "parent_id"), config.children)
    found = pinned(found, "found")
    once = hasattr(reranker, "features")
    side = lambda df, key, name: df.select(key, (reranker.features(F.col("text")) if once else F.col("text")).alias(name))
    asked = side(queries.join(found.select("query_id").distinct(), "query_id", "left_semi"), "query_id", "query_side")
    given = side(parents.join(found.select("parent_id").distinct(), "parent_id", "left_semi"), "parent_id", "parent_side")
    if once:  # what a text gives is read for each of its pairs
        asked, given = pinned(asked, "asked"), pinned(given, "given")
    pairs = found.join(given, "parent_id").join(asked, "query_id").withColumn("id", F.col("parent_id"))
    score = (reranker.share if once else reranker.relevance)(F.col("query_side"), F.col("parent_side"))
    # the score is worked out before rows move on by query, without the texts
    scored = pairs.select("query_id", "parent_id", "id", "child_ids", "best_score", score.alias("relevance"))
    best = fusion.rerank(scored, F.col("relevance"), config.rerank_limit)
    return best.select("query_id", "parent_id", "child_ids", "best_score", "relevance", "rank")


def context_block(label: Column, domain: Column, source: Column, section: Column, parent: Column, evidence: Column) -> Column:
    """A parent as it stands in a prompt. evidence: ARRAY<STRING> of the matched children's texts."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return F.concat(
        label, F.lit("\nDomain: "), domain, F.lit("\nSource: "), known(source), F.lit("\nSection: "), known(section), F.lit("\nParent context:\n"), F.coalesce(parent, F.lit("")),
        F.lit("\n\nMatched evidence:\n"), F.array_join(F.filter(evidence, lambda e: F.coalesce(e, F.lit("")) != ""), "\n\n"),
    )


def prompts(blocks: DataFrame, limit: int = fusion.CONTEXT) -> DataFrame:
    """(query_id, prompt): the question, the blocks within the budget in order of rank, then all tables.

    blocks: query_id, query_text, rank, block, tables ARRAY<STRING>. Tables of all parents are added, also of those that the budget drops.
    """
    kept = fusion.within_budget(blocks, F.length("block"), limit, "query_id", order="rank")
    rule = "\n\n---\n\n"
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("rank", c))), lambda s: s[c])
    texts = kept.groupBy("query_id", "query_text").agg(F.array_join(ordered("block"), rule).alias("evidence"))
    tables = blocks.groupBy("query_id").agg(F.array_distinct(F.flatten(ordered("tables"))).alias("tables"))
    prompt = F.concat(F.lit("User question:\n"), "query_text", F.lit("\n\nRetrieved evidence:\n\n"), "evidence", F.when(F.size("tables") > 0, F.concat(F.lit("\n\nRetrieved table HTML:\n\n"), F.array_join("tables", rule))).otherwise(""))
    return texts.join(tables, "query_id").select("query_id", prompt.alias("prompt"))


def numbered_citations(parents: DataFrame, order: str) -> DataFrame:
    """Parents of each query numbered from 1 in order."""
    return parents.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(order)))
