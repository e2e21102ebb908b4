"""Groups of rows that follow each other, folded as a stream: a group is closed by the first row of the next one.

Rows of a source arrive in the order of their numbers, over any number of batches. What is open, and which keys are closed, is
kept by Spark for each source, so the stream can stop and go on. The rows of the open group are state until it is closed. A key that comes again after its group was closed is an
error, since its group has been given out; ``strict=False`` gives it out as a group of its own with ``again`` set.

The last group of a source stays open until a row with ``END`` in its place of a key says that there is no more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: The key of a row behind a source's last.
END = "\u0004"

#: From the key and rows of a closed group to the values of its output.
Fold = Callable[[str, pd.DataFrame], dict[str, Any]]


class _Groups(StatefulProcessor):
    def __init__(self, source: str, key: str, order: str, rows: str, fold: Fold, strict: bool):
        self.source, self.key, self.order, self.fold, self.strict = source, key, order, fold, strict
        self.schema = StructType.fromDDL(rows)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "key string, last long")
        self.held = handle.getListState("held", self.schema)
        self.closed = handle.getMapState("closed", "key string", "n long")

    def _close(self, source: str, key: str, rows: list[pd.DataFrame]) -> dict[str, Any]:
        again = self.closed.containsKey((key,))
        if again and self.strict:
            raise ValueError(f"rows of {source} are not grouped: {key} comes again after its group was closed")
        self.closed.updateValue((key,), ((self.closed.getValue((key,))[0] if again else 0) + 1,))
        return {self.source: source, self.key: key, "again": again} | self.fold(key, pd.concat(rows, ignore_index=True))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        source, out = key[0], []
        arrived = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        names = self.schema.names
        before, last = self.open.get() if self.open.exists() else (None, None)
        if last is not None and len(arrived) and arrived[self.order].iloc[0] <= last:
            raise ValueError(f"rows of {source} arrive out of order: {arrived[self.order].iloc[0]} after {last}")
        held = [pd.DataFrame(list(self.held.get()), columns=names)] if before is not None else []
        runs = (arrived[self.key] != arrived[self.key].shift()).cumsum()
        appended = []
        for _, run in arrived.groupby(runs, sort=False):
            own = run[self.key].iloc[0]
            if before is not None and own != before:
                out.append(self._close(source, before, held))
                held, appended = [], None
            if own == END:
                before, held, appended = None, [], None
                continue
            if own == before and appended is not None:
                appended.append(run[names])
            held.append(run[names])
            before = own
        if appended is None or not self.open.exists():  # another group is open now than before this batch
            self.held.clear()
            appended = held
        for part in appended:
            self.held.appendList([tuple(r) for r in part.itertuples(index=False)])
        if before is None:
            self.open.clear()
        else:
            self.open.update((before, int(arrived[self.order].iloc[-1])))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def closed_groups(rows: DataFrame, source: str, key: str, order: str, fold: Fold, out: str, strict: bool = True) -> DataFrame:
    """(source, key, again, what ``fold`` returns) of each group as it is closed. ``rows`` is a stream; key is a string, order a whole number that grows
    within a source. ``out`` is the schema of what fold returns. The session must keep state in RocksDB, see ``STATE``.
    """
    kept = [f for f in rows.schema.fields if f.name != source]
    held = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema = f"`{source}` string, `{key}` string, again boolean, {out}"
    return rows.groupBy(source).transformWithStateInPandas(_Groups(source, key, order, held, fold, strict), schema, outputMode="append", timeMode="none")


#: The setting that a session needs for keyed state.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
