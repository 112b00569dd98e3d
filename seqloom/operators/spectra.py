"""Fourier transforms of rows of numbers in Arrow batches, and what they say about windows.

A batch whose arrays are of one length is one call of numpy; others go length by length. Null and empty arrays give null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length; nulls and empty rows are left out."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for n in np.unique(size[size > 0]):
        at = np.flatnonzero(size == n)
        yield at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), n)


def _mapped(df: DataFrame, key: str, values: str, make, names: tuple[str, ...]) -> DataFrame:
    schema = df.select(key).schema
    for n in names:
        schema = schema.add(n, ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[None] * batch.num_rows for _ in names]
            for at, x in _by_length(batch.column(1)):
                for k, got in enumerate(make(x)):
                    for i, row in zip(at.tolist(), got, strict=True):
                        out[k][i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(o, pa.list_(pa.float64())) for o in out)], names=[key, *names])

    return df.select(key, values).mapInArrow(run, schema)


def forward(df: DataFrame, key: str, values: str) -> DataFrame:
    """(key, re, im): the transform of n real values, its first n // 2 + 1 terms; the others are their conjugates."""
    return _mapped(df, key, values, lambda x: (lambda f: (f.real, f.imag))(np.fft.rfft(x, axis=1)), ("re", "im"))


def inverse(df: DataFrame, key: str, re: str = "re", im: str = "im", n: int | None = None) -> DataFrame:
    """(key, values): the n real values (default: twice the terms less two) that have these first terms. Unequal lengths give null."""
    schema = df.select(key).schema.add("values", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            for at, x in _by_length(batch.column(1)):
                other = batch.column(2).take(pa.array(at))
                same = np.flatnonzero(other.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == x.shape[1])
                y = other.take(pa.array(same)).flatten().to_numpy(zero_copy_only=False).reshape(len(same), x.shape[1])
                for i, row in zip(at[same].tolist(), np.fft.irfft(x[same] + 1j * y, n or 2 * (x.shape[1] - 1), axis=1), strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=[key, "values"])

    return df.select(key, re, im).mapInArrow(run, schema)


def window_figures(df: DataFrame, key: str, values: str, pad: int = 16) -> DataFrame:
    """(key, figures): of each window its coherent gain, noise bandwidth in bins, highest side lobe in dB, width of the main lobe in bins
    (between its first minima), by a transform padded to ``pad`` times its length."""

    def figures(x: np.ndarray):
        n = x.shape[1]
        gain = x.sum(axis=1) / n
        with np.errstate(divide="ignore", invalid="ignore"):
            band = n * (x * x).sum(axis=1) / x.sum(axis=1) ** 2
            power = np.abs(np.fft.rfft(x, n * pad, axis=1))
            decibels = 20 * np.log10(np.maximum(power, 1e-300) / power.max(axis=1, keepdims=True))
        rows = []
        for g, b, d in zip(gain, band, decibels, strict=True):
            rising = np.flatnonzero(np.diff(d) > 0)
            first = int(rising[0]) if len(rising) else len(d) - 1
            side = float(d[first:].max()) if len(rising) else float("-inf")
            rows.append(np.array([g, b, side, 2 * first / pad]))
        return (rows,)

    return _mapped(df, key, values, figures, ("figures",))
