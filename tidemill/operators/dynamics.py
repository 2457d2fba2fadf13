"""Vectors moved on by a linear law: a matrix step, and its flow by the four-stage method, for batches of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def _moved(rows: DataFrame, keys: list[str], vector: str, size: int, move: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(len(keys)).to_pylist()
            fit = [i for i, v in enumerate(values) if v is not None and len(v) == size and None not in v]
            out: list = [None] * len(values)
            if fit:
                for i, z in zip(fit, move(np.array([values[i] for i in fit], np.float64)).tolist(), strict=True):
                    out[i] = z
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(out, pa.list_(pa.float64()))], names=[*keys, vector])

    return rows.select(*keys, vector).mapInArrow(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", `{vector}` array<double>")


def linear_rollout(rows: DataFrame, keys: list[str], vector: str, matrix: np.ndarray, bias: np.ndarray, steps: int) -> DataFrame:
    """(keys, vector) after steps of z = A z + b. Null vectors, and those of another length or with null components, give null."""

    def move(z: np.ndarray) -> np.ndarray:
        for _ in range(steps):
            z = z @ matrix.T + bias
        return z

    return _moved(rows, keys, vector, len(bias), move)


def linear_flow(rows: DataFrame, keys: list[str], vector: str, matrix: np.ndarray, bias: np.ndarray, span: float, steps: int) -> DataFrame:
    """(keys, vector) after the time span of dz/dt = A z + b, by the four-stage Runge-Kutta method in so many steps; nulls as in linear_rollout."""
    law, h = lambda z: z @ matrix.T + bias, span / steps

    def move(z: np.ndarray) -> np.ndarray:
        for _ in range(steps):
            one = law(z)
            two = law(z + h / 2 * one)
            three = law(z + h / 2 * two)
            z = z + h / 6 * (one + 2 * two + 2 * three + law(z + h * three))
        return z

    return _moved(rows, keys, vector, len(bias), move)
