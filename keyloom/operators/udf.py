"""User operators: a request made from a parameter, a step on each shard, and a step that gathers into a result."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class UserOperator:
    """What a caller writes; all steps but ``apply`` have defaults.

    generate: parameter and state of the call to the request that every shard gets (small, pickled with the function).
    apply:    a shard's rows and the request to result rows; one argument if it needs no request.
    gather:   all shards' results and the state to the call's result.
    """

    schema: str
    apply: Callable[..., pd.DataFrame]
    gather: Callable[[DataFrame, Any], Any] = lambda rows, state: rows
    create_state: Callable[[], Any] = lambda: None
    generate: Callable[[Any, Any], Any] = lambda param, state: param
    read_only: bool = True

    def prepare(self, param: Any = None) -> Call:
        """The request is made here, once; send() may be called on any version of the table."""
        state = self.create_state()
        return Call(self, state, self.generate(param, state))

    def call(self, table: DataFrame, param: Any = None) -> Any:
        """One call of ``apply`` for each shard, which must fit in a task's memory."""
        return self.prepare(param).send(table).wait()


@dataclass
class Call:
    """A call under way."""

    operator: UserOperator
    state: Any
    request: Any
    rows: DataFrame | None = None

    def send(self, table: DataFrame) -> Call:
        apply, request = self.operator.apply, self.request
        step = apply if request is None else lambda rows: apply(rows, request)
        self.rows = table.groupBy("shard_id").applyInPandas(lambda rows: step(rows), self.operator.schema)
        return self

    def wait(self) -> Any:
        if self.rows is None:
            raise RuntimeError("the call has not been sent")
        return self.operator.gather(self.rows, self.state)


def stream_shards(table: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """The same for steps that work batch by batch, however large a shard is."""
    return table.mapInArrow(step, schema)
