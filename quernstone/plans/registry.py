"""A query is a function (spark, folder) -> DataFrame with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; ``sql`` is None where SQL has no such form."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


#: SQL spellings of the text patterns.
TOKENS = r"regexp_extract_all(coalesce({0}, ''), '\s*[\p{{L}}\p{{N}}_]{{1,8}}|\s*[^\p{{L}}\p{{N}}_\s]|\s+')"
COUNT = "ceil(len(" + TOKENS + ")::DOUBLE * 1.1::DOUBLE)::INT"
CLEAN = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
TERMS = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_-]+[\p{{L}}\p{{N}}_]'), lambda t: lower(t))"
UUID5 = (
    "(SELECT substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || substr('89ab', ('0x' || substr(h,17,1))::INT % 4 + 1, 1) || substr(h,18,3) || '-' || substr(h,21,12) "
    "FROM (SELECT sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({0})) AS h))"
)
