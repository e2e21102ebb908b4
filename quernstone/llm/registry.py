"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quernstone.llm import collocations, decontaminate, exact_dedup, langid, line_dedup, mixing, packing, pii, ranked_search, secrets, sharding, simhash, token_output
from quernstone.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


#: Key of the registered query, which runs over invented tables. It is public, so it protects nothing: real tables need ``spark.quernstone.pii.key``.
PUBLIC_KEY = b"quernstone surrogates"


def on_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_mix": on_documents(mixing.mix_report),
        "op2_decontaminate": lambda spark, sf_dir: decontaminate.leak_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
        "op3_langid": on_documents(langid.language_report),
        "op4_exact_dedup": on_documents(exact_dedup.dedup_report),
        "op5_token_output": on_documents(token_output.token_report),
        "op6_simhash": on_documents(simhash.simhash_report),
        "op7_line_dedup": on_documents(line_dedup.line_report),
        "op8_pii": on_documents(lambda docs: pii.pii_report(docs, PUBLIC_KEY)),
        "op9_shard": on_documents(sharding.shard_report),
        "op10_secrets": on_documents(secrets.secret_report),
        "op11_collocations": on_documents(collocations.collocation_report),
        "op12_search": lambda spark, sf_dir: ranked_search.search_report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")),
        "op13_pack": on_documents(packing.packing_report),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact_dedup.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op11_collocations": collocations.ORACLE, "op12_search": ranked_search.ORACLE}
