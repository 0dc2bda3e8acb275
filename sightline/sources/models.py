"""A surface for models: stages that load a model once a worker, take the rows of a source file together, return typed results, and
go on when the model fails or is slow."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Models of this worker process, by stage; tasks that run one after another in it share them.
_loaded: dict[str, Any] = {}


@dataclass(frozen=True)
class Stage:
    """A model and how to run it.

    name, version: what a worker knows the model by. load: makes the model. apply: (model, list of dicts) -> list of dicts or None, one
    a row. result: the struct that comes back, as DDL. batch: rows of a call at most, all of one source. seconds: the time of a call.
    cpus, gpus: what a task needs; stages with other needs run with another profile, so one stage's model never waits for another's
    devices.
    """

    name: str
    load: Callable[[], Any]
    apply: Callable[[Any, list[dict]], list[dict | None]]
    result: str
    version: str = "1"
    batch: int = 32
    seconds: float = 60.0
    cpus: int | None = None
    gpus: float | None = None
    inputs: tuple[str, ...] = field(default=())

    def profile(self):
        """The resource profile, or None where the stage asks for nothing. Clusters with dynamic allocation heed it."""
        if self.cpus is None and self.gpus is None:
            return None
        from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

        needs = TaskResourceRequests()
        if self.cpus is not None:
            needs = needs.cpus(self.cpus)
        if self.gpus is not None:
            needs = needs.resource("gpu", self.gpus)
        return ResourceProfileBuilder().require(needs).build


class TooSlow(Exception):
    pass


def _within(seconds: float, call: Callable[[], Any]) -> Any:
    """The call's result; after ``seconds`` it is left to itself."""
    box: dict[str, Any] = {}

    def run() -> None:
        try:
            box["value"] = call()
        except BaseException as error:  # handed on to the caller
            box["error"] = error

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        raise TooSlow(f"no answer in {seconds:g} s")
    if "error" in box:
        raise box["error"]
    return box["value"]


def model_of(stage: Stage) -> Any:
    key = f"{stage.name}/{stage.version}"
    if key not in _loaded:
        _loaded[key] = stage.load()
    return _loaded[key]


def answers(stage: Stage, rows: list[dict]) -> list[tuple[dict | None, str | None]]:
    """(result, error) of each row of a call. A model that failed or hung is loaded anew for the next call."""
    try:
        found = _within(stage.seconds, lambda: stage.apply(model_of(stage), rows))
        if len(found) != len(rows):
            raise ValueError(f"{len(found)} results for {len(rows)} rows")
        return [(r, None) for r in found]
    except Exception as error:
        _loaded.pop(f"{stage.name}/{stage.version}", None)
        return [(None, f"{type(error).__name__}: {error}")] * len(rows)


def _calls(rows: Iterator[dict], key: str, size: int) -> Iterator[list[dict]]:
    """Rows that follow each other and have the same key, ``size`` at most."""
    held: list[dict] = []
    for row in rows:
        if held and (len(held) == size or held[0][key] != row[key]):
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def with_model(rows: DataFrame, stage: Stage, source: str, order: list[str] | None = None) -> DataFrame:
    """``rows`` with ``result`` (struct, null where the model gave none) and ``error`` (null if it answered).

    Rows of the same ``source`` (a clip's path) go to one task in ``order``, so a file is opened by one worker and once a call; a hot
    source's rows make several calls one after another, and hold no more than ``batch`` rows in memory. The model gets
    the columns ``stage.inputs`` (all if empty).
    """

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StringType, StructType, _parse_datatype_string

    result = _parse_datatype_string(f"struct<{stage.result}>" if not stage.result.startswith("struct") else stage.result)
    schema = StructType([*rows.schema.fields, StructField("result", result), StructField("error", StringType())])
    wanted = list(stage.inputs or rows.columns)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        target = to_arrow_schema(schema)
        each = (row for batch in batches for row in batch.to_pylist())
        for call in _calls(each, source, stage.batch):
            found = answers(stage, [{c: r[c] for c in wanted} for r in call])
            yield pa.RecordBatch.from_pylist([r | {"result": x, "error": e} for r, (x, e) in zip(call, found)], schema=target)

    placed = rows.repartition(source).sortWithinPartitions(source, *(order or []))
    profile = stage.profile()
    made = placed.mapInArrow(run, schema) if profile is None else placed.mapInArrow(run, schema, profile=profile)
    return made


def or_else(result: Column, fallback: Column) -> Column:
    """Field by field the model's answer, else the fallback's (a struct with the same fields)."""
    return F.when(result.isNull(), fallback).otherwise(result)
