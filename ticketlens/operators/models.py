"""Injected models as column expressions.

Everywhere in this package a scorer, extractor, embedder or reply generator is a
function from a Column to a Column. Built-in ones are plain SQL expressions;
:func:`model_column` makes one of any Python model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnFunction = Callable[[Column], Column]
BatchFunction = Callable[[list], list]


@dataclass(frozen=True)
class Model:
    """A model to run inside tasks.

    ``load`` is called once per task and returns a function from a list of
    inputs to a list of outputs. With ``on_error="null"`` an input the model
    fails on yields NULL; with ``"raise"`` it fails the job. A model that has failed on
    ``dead_after`` inputs of a task and on none succeeded is taken to be out of service, and fails the job too.
    """

    load: Callable[[], BatchFunction]
    version: str = "1"
    on_error: str = "null"
    dead_after: int = 8


def _arrow_type(dtype: T.DataType) -> pa.DataType:
    if isinstance(dtype, T.ArrayType):
        return pa.list_(_arrow_type(dtype.elementType))
    if isinstance(dtype, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in dtype.fields])
    simple = {
        T.StringType: pa.string(),
        T.DoubleType: pa.float64(),
        T.BooleanType: pa.bool_(),
        T.LongType: pa.int64(),
    }
    return simple[type(dtype)]


class _Task:
    """A model in one task, and how it has done there."""

    def __init__(self, model: Model):
        self.model, self.fn, self.failed, self.succeeded = model, model.load(), 0, False

    def run(self, inputs: list) -> list[tuple]:
        """(output, failed) for each input; a failing batch is halved until the bad rows are alone."""
        if not inputs:
            return []
        try:
            outputs = list(self.fn(inputs))
            if len(outputs) != len(inputs):
                raise ValueError(f"model gave {len(outputs)} outputs for {len(inputs)} inputs")
            self.succeeded = True
            return [(output, False) for output in outputs]
        except Exception:
            if self.model.on_error == "raise":
                raise
            if len(inputs) == 1:
                self.failed += 1
                if not self.succeeded and self.failed >= self.model.dead_after:
                    raise
                return [(None, True)]
            half = len(inputs) // 2
            return self.run(inputs[:half]) + self.run(inputs[half:])


@dataclass(frozen=True)
class ModelColumn:
    """A column function that runs ``model`` in Arrow batches. NULL in, NULL out.

    Only the input column travels to Python. The result is marked
    non-deterministic so that a query which both filters on it and returns it
    runs the model once per row, not twice. :meth:`checked` also tells a failure from an output of NULL.
    """

    model: Model
    dtype: T.DataType
    prepare: ColumnFunction = lambda value: value

    def __call__(self, value: Column) -> Column:
        return self._column(value, self.dtype, lambda output, _failed: output)

    def checked(self, value: Column) -> Column:
        """A struct of ``value`` and ``failed``."""
        kind = T.StructType([T.StructField("value", self.dtype), T.StructField("failed", T.BooleanType())])
        return self._column(value, kind, lambda output, failed: {"value": output, "failed": failed})

    def _column(self, value: Column, kind: T.DataType, result: Callable) -> Column:
        arrow_type, model = _arrow_type(kind), self.model

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            task = _Task(model)
            for batch in batches:
                values = batch.to_pylist()
                filled = [i for i, value in enumerate(values) if value is not None]
                outputs: list = [result(None, False)] * len(values)
                for i, output in zip(filled, task.run([values[i] for i in filled])):
                    outputs[i] = result(*output)
                yield pa.array(outputs, type=arrow_type)

        return F.arrow_udf(run, kind).asNondeterministic()(self.prepare(value))


def model_column(model: Model, dtype: T.DataType) -> ModelColumn:
    return ModelColumn(model, dtype)
