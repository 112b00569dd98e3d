"""Analysis of frames of a signal: pitch, spectral envelope, aperiodicity by band; batches of frames at once in numpy inside tasks.

*Pitch* is the shortest lag whose normalised autocorrelation comes near the best one, between its neighbours by a parabola. *Envelope*: the power
spectrum through a window of three periods, smoothed over two thirds of the pitch by prefix sums, then liftered in the cepstrum so that harmonics vanish
while peaks between them stay. *Aperiodicity* of a band is what its power spectrum loses against itself one period later.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: The pitches looked for, the autocorrelation that a voiced frame has, how near to the best lag a shorter one must come.
LOW, HIGH, VOICED, NEAR = 71.0, 800.0, 0.5, 0.95
# The published lifter's weights of quefrency zero and of one period.
LIFTER = (1.18, -0.09)
#: Pitch that the envelope of frames without one is smoothed by, the least power of a bin, and frames that are worked on at once.
DEFAULT, LEAST, AT_ONCE = 500.0, 1e-16, 256


def pitches(x: np.ndarray, rate: float, low: float = LOW, high: float = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """(Hz, strength) of each row; 0 Hz where the strength is below VOICED. Lags over half the frame are not looked at."""
    rows, n = x.shape
    first, last = max(2, int(rate / high)), min(n // 2, int(np.ceil(rate / low)))
    if last - first < 2:
        return np.zeros(rows), np.zeros(rows)
    x = x - x.mean(axis=1, keepdims=True)
    size = 1 << (2 * n - 1).bit_length()
    r = np.fft.irfft(np.abs(np.fft.rfft(x, size, axis=1)) ** 2, axis=1)[:, : last + 2]
    lags = np.arange(last + 2)
    upto = np.concatenate([np.zeros((rows, 1)), np.cumsum(x * x, axis=1)], axis=1)
    ends = np.maximum(upto[:, n - lags] * (upto[:, -1:] - upto[:, lags]), 0)
    r = r / np.sqrt(np.where(ends > 1e-20, ends, np.inf))
    inner = r[:, first : last + 1]
    top = (inner >= r[:, first - 1 : last]) & (inner >= r[:, first + 1 : last + 2])
    peak = np.where(top, inner, -1.0)
    best = peak.max(axis=1)
    at = first + (peak >= NEAR * best[:, None]).argmax(axis=1)
    i = np.arange(rows)
    a, b, c = r[i, at - 1], r[i, at], r[i, at + 1]
    bend = a - 2 * b + c
    shift = np.where(np.abs(bend) > 1e-12, 0.5 * (a - c) / np.where(np.abs(bend) > 1e-12, bend, 1), 0)
    voiced = best >= VOICED
    return np.where(voiced, rate / (at + np.clip(shift, -0.5, 0.5)), 0.0), np.clip(b, 0, 1)


def _windowed(x: np.ndarray, rate: float, f0: np.ndarray, periods: float) -> np.ndarray:
    """Rows through a Hann window of so many periods around their middle, of unit energy."""
    n = x.shape[1]
    away = (np.arange(n) - (n - 1) / 2)[None, :] / (periods * rate / f0[:, None])
    w = np.where(np.abs(away) <= 0.5, 0.5 + 0.5 * np.cos(2 * np.pi * away), 0)
    return x * w / np.sqrt((w * w).sum(axis=1, keepdims=True))


def _smoothed(power: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The mean of each bin's surroundings, ``width`` bins wide, by prefix sums; the spectrum is mirrored at both ends."""
    rows, bins = power.shape
    reach = int(np.ceil(width.max() / 2)) + 2
    wide = np.pad(power, ((0, 0), (reach, reach)), mode="reflect") if reach < bins else np.pad(power, ((0, 0), (reach, reach)), mode="edge")
    upto = np.concatenate([np.zeros((rows, 1)), np.cumsum(wide, axis=1)], axis=1)

    def at(p: np.ndarray) -> np.ndarray:
        k = np.floor(p).astype(int)
        a = np.take_along_axis(upto, k, axis=1)
        return a + (np.take_along_axis(upto, k + 1, axis=1) - a) * (p - k)

    middle, half = reach + 0.5 + np.arange(bins)[None, :], width[:, None] / 2
    return (at(middle + half) - at(middle - half)) / width[:, None]


def envelopes(x: np.ndarray, rate: float, f0: np.ndarray, size: int) -> np.ndarray:
    """Log power spectra (rows, size / 2 + 1) without the harmonics of f0."""
    f0 = np.where(f0 > 0, f0, DEFAULT)
    power = np.abs(np.fft.rfft(_windowed(x, rate, f0, 3), size, axis=1)) ** 2
    power = np.maximum(_smoothed(power, np.maximum(2 * f0 / 3 * size / rate, 1.0)), LEAST)
    cepstrum = np.fft.irfft(np.log(power), axis=1)
    time = np.minimum(np.arange(size), size - np.arange(size)) / rate
    turn = f0[:, None] * time[None, :]
    return np.fft.rfft(cepstrum * np.sinc(turn) * (LIFTER[0] + 2 * LIFTER[1] * np.cos(2 * np.pi * turn)), axis=1).real


def aperiodicities(x: np.ndarray, rate: float, f0: np.ndarray, size: int, bands: int) -> np.ndarray:
    """0 to 1 for each of ``bands`` equal parts of the bins: 1 less the band's autocorrelation one period later; 1 without pitch or power.

    Autocorrelations are those of a Hann window's frame, divided by the window's own; each band takes the best of nine lags within a hundredth of the period."""
    rows, n = x.shape
    window = np.hanning(n + 2)[1:-1]
    power = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * window, 2 * size, axis=1)) ** 2
    own = np.fft.irfft(np.abs(np.fft.rfft(window, 2 * size)) ** 2)[:n]
    lag = rate / np.where(f0 > 0, f0, rate)
    edges = np.arange(bands + 1) * power.shape[1] // bands
    add = lambda v: np.add.reduceat(v, edges[:-1], axis=1)
    total, best = add(power), np.full((rows, bands), -1.0)
    turn = 2 * np.pi * np.arange(power.shape[1]) / (2 * size)
    for stretch in np.linspace(0.99, 1.01, 9):
        here = lag * stretch
        scale = np.interp(here, np.arange(n), own / own[0])
        best = np.maximum(best, add(power * np.cos(here[:, None] * turn[None, :])) / np.where(total > 1e-20, total, np.inf) / np.maximum(scale, 0.1)[:, None])
    return np.where(f0[:, None] > 0, 1 - np.clip(best, 0, 1), 1.0)


def analysed(frames: DataFrame, rate: float, size: int = 1024, bands: int = 5, samples: str = "samples") -> DataFrame:
    """frames with ``f0`` (Hz, 0 without voice), ``strength``, ``envelope`` (size / 2 + 1 log powers) and ``aperiodicity`` (one a band).

    Frames of different lengths are worked on by length; frames that are null, empty or longer than ``size`` get nulls."""
    names = frames.columns
    rows_of = ArrayType(DoubleType())
    schema = StructType([*frames.schema, StructField("f0", DoubleType()), StructField("strength", DoubleType()), StructField("envelope", rows_of), StructField("aperiodicity", rows_of)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(samples)
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(k, AT_ONCE)
                column = batch.column(at)
                lengths = np.array([len(v) if v.is_valid else 0 for v in column])
                found: list[tuple] = [(None, None, None, None)] * batch.num_rows
                for n in np.unique(lengths[(lengths > 0) & (lengths <= size)]):
                    rows = np.flatnonzero(lengths == n)
                    x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)
                    f0, strength = pitches(x, rate)
                    envelope, noise = envelopes(x, rate, f0, size), aperiodicities(x, rate, f0, size, bands)
                    for i, r in enumerate(rows):
                        found[r] = (f0[i], strength[i], envelope[i], noise[i])
                columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
                kinds = (pa.float64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[*names, "f0", "strength", "envelope", "aperiodicity"])

    return frames.mapInArrow(run, schema)
