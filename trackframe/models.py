"""Hooks for models: an ONNX file, or any function on arrays, run over batches of rows on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from trackframe.operators.smoothing import batches_of

Model = Callable[[np.ndarray], np.ndarray]


def onnx(content: bytes, providers: tuple[str, ...] = ("CPUExecutionProvider",)) -> Callable[[], Model]:
    """A loader for a model's bytes; the session is made in the worker, once."""

    def load() -> Model:
        import onnxruntime

        run = onnxruntime.InferenceSession(content, providers=list(providers))
        name = run.get_inputs()[0].name
        return lambda x: run.run(None, {name: x.astype(np.float32)})[0]

    return load


def padded(rows: list, length: int | None = None) -> np.ndarray:
    """Sequences of different lengths as one array, filled with zeros to the longest (or to ``length``)."""
    parts = [np.array([np.asarray(x, float) for x in r]) for r in rows]
    n = length or max(len(p) for p in parts)
    out = np.zeros((len(parts), n, *parts[0].shape[1:]))
    for k, p in enumerate(parts):
        out[k, : min(n, len(p))] = p[:n]
    return out


def infer(df: DataFrame, col: str, load: Callable[[], Model], out: str = "output", batch: int = 64, length: int | None = None) -> DataFrame:
    """Add a model's output (array of numbers) for a column of arrays, or of arrays of arrays (sequences, padded within a batch)."""
    kind = df.schema[col].dataType
    sequence = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType)
    names = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for part in batches_of(parts, batch):
            rows = list(part[col])
            x = padded(rows, length) if sequence else np.array([np.asarray(r, float) for r in rows])
            yield part[names].assign(**{out: np.asarray(model(x), float).reshape(len(part), -1).tolist()})

    return df.mapInPandas(run, schema)
