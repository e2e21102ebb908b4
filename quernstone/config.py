"""Settings of operators from the session, and the tables that a store needs."""

from __future__ import annotations

import dataclasses
import types
import typing
from typing import Any, TypeVar

from pyspark.sql import SparkSession
from pyspark.sql.types import StructType

C = TypeVar("C")


def from_session(spark: SparkSession, kind: type[C], prefix: str) -> C:
    """A dataclass of settings: each field from the session's ``prefix.field``, else its default. Values of tuples are parted by commas.

    A setting under the prefix that names no field is an error, so that a misspelt one is not passed over.
    """
    wanted = {f.name: f for f in dataclasses.fields(kind)}
    hints, found = typing.get_type_hints(kind), {}
    given = {k.removeprefix(f"{prefix}."): v for k, v in spark.conf.getAll.items() if k.startswith(f"{prefix}.")}
    unknown = sorted(set(given) - set(wanted))
    if unknown:
        raise ValueError(f"{prefix} has no {', '.join(unknown)}; it has {', '.join(sorted(wanted))}")
    for name, text in given.items():
        found[name] = _value(hints[name], name, text)
    return kind(**found)


def _value(hint: Any, name: str, text: str) -> Any:
    if typing.get_origin(hint) in (typing.Union, types.UnionType):
        if text == "":
            return None
        hint = next(h for h in typing.get_args(hint) if h is not type(None))
    if typing.get_origin(hint) is tuple:
        return tuple(t.strip() for t in text.split(",") if t.strip())
    if hint is bool:
        if text.lower() not in ("true", "false"):
            raise ValueError(f"{name} must be true or false, not {text}")
        return text.lower() == "true"
    try:
        return hint(text)
    except ValueError as e:
        raise ValueError(f"{name} must be of type {hint.__name__}, not {text}") from e


def selected(groups: list[str], only: list[str] | None = None, skip: list[str] | None = None) -> list[str]:
    """The groups to work on, in their own order: those of ``only`` if it is given, without those of ``skip``. Unknown names are an error."""
    unknown = sorted((set(only or ()) | set(skip or ())) - set(groups))
    if unknown:
        raise ValueError(f"no group is named {', '.join(unknown)}")
    return [g for g in groups if (not only or g in only) and g not in (skip or ())]


def create_tables(spark: SparkSession, tables: dict[str, str], database: str | None = None) -> list[str]:
    """Creates the tables (name: schema) that are not there, and returns them. Empty definitions are an error."""
    if not tables:
        raise ValueError("no tables are defined")
    made = []
    for name, schema in tables.items():
        full = f"{database}.{name}" if database else name
        if not spark.catalog.tableExists(full):
            spark.createDataFrame([], StructType.fromDDL(schema)).write.saveAsTable(full)
            made.append(name)
    return made


def verify_tables(spark: SparkSession, tables: dict[str, str], database: str | None = None) -> dict[str, list[str]]:
    """What is wrong with each table: columns that are missing or of another type, or the table itself. Empty if nothing is; more columns are no fault."""
    wrong: dict[str, list[str]] = {}
    for name, schema in tables.items():
        full = f"{database}.{name}" if database else name
        if not spark.catalog.tableExists(full):
            wrong[name] = ["no such table"]
            continue
        have = {f.name.lower(): f.dataType.simpleString() for f in spark.table(full).schema.fields}
        faults = [f"{f.name}: {have.get(f.name.lower(), 'missing')}, not {f.dataType.simpleString()}" for f in StructType.fromDDL(schema).fields if have.get(f.name.lower()) != f.dataType.simpleString()]
        if faults:
            wrong[name] = faults
    return wrong
