"""Pulse synthesis: harmonics, overlap-add, whole utterances, and pitch of samples.

What is a sum over positions stays a DataFrame aggregate; what depends on the order of pulses runs for one utterance in one task, which
its own length bounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below it a sample counts as silence.
SILENT = 1e-10


def harmonics(f0: str, spectrum: str, aperiodicity: str | None = None, rate: int = 44100, fft: int = 1024, most: int = 100, least: float = 0.0) -> Column:
    """Array of (harmonic, bin, amplitude) of a voiced frame: harmonics under half the rate whose bin the spectrum has and reaches ``least``.

    The amplitude is the spectrum's, less its aperiodic part. Unvoiced frames (f0 null or not above 0) give an empty array."""
    last = f"CAST(least({most}, floor({rate / 2}D / {f0})) AS INT)"
    air = f"(1 - coalesce(try_element_at({aperiodicity}, h.bin + 1), 0D))" if aperiodicity else "1D"
    steps = f"transform(sequence(1, {last}), h -> named_struct('harmonic', h, 'bin', CAST(floor({f0} * h * {fft} / {rate}) AS INT)))"
    kept = f"filter({steps}, h -> {f0} * h.harmonic < {rate / 2}D AND h.bin < size({spectrum}) AND {spectrum}[h.bin] >= {least}D)"
    found = f"transform({kept}, h -> named_struct('harmonic', h.harmonic, 'bin', h.bin, 'amplitude', {spectrum}[h.bin] * {air}))"
    none = "CAST(array() AS ARRAY<STRUCT<harmonic: INT, bin: INT, amplitude: DOUBLE>>)"
    return F.expr(f"CASE WHEN {f0} > 0 AND {f0} <= {rate / 2}D THEN {found} ELSE {none} END")


def overlap_added(pulses: DataFrame, keys: list[str], position: str, samples: str) -> DataFrame:
    """(keys, at, x): the sum of all pulses at each sample position; partial sums meet in the shuffle, so hot positions are no harm.

    Negative positions are left out, as are null and empty pulses."""
    x = pulses.select(*keys, F.col(position).alias("_p"), F.posexplode(samples).alias("_i", "_x")).where(F.col("_p") + F.col("_i") >= 0)
    return x.groupBy(*keys, (F.col("_p") + F.col("_i")).alias("at")).agg(F.sum("_x").alias("x"))


def crossfade_add(pulses: list[np.ndarray], positions: list[int], length: int, fade: int) -> np.ndarray:
    """``length`` samples: where a pulse meets sound, its first ``fade`` samples replace it along a raised cosine and the rest is added.

    Pulses that start before 0 are left out; a fade of fewer than two samples is plain addition."""
    out = np.zeros(length)
    for pulse, at in zip(pulses, positions, strict=True):
        if not 0 <= at < length:
            continue
        here = out[at : at + len(pulse)]
        pulse = pulse[: len(here)]
        k = min(fade, len(here)) if (np.abs(here) > SILENT).any() else 0
        if k > 1:
            rise = 0.5 - 0.5 * np.cos(np.pi * np.arange(k) / (k - 1))
            here[:k] += (pulse[:k] - here[:k]) * rise
            here[k:] += pulse[k:]
        else:
            here += pulse
    return out


def pulse(f0: float, spectrum: np.ndarray, aperiodicity: np.ndarray, rate: int, fft: int, seed: int) -> np.ndarray:
    """``fft`` samples of one pulse: harmonics of zero phase under the envelope, seeded noise of a tenth of the aperiodicity, a Hann window."""
    half = fft // 2 + 1
    level = np.zeros(half)
    level[: min(half, len(spectrum))] = spectrum[:half]
    air = np.zeros(half)
    air[: min(half, len(aperiodicity))] = aperiodicity[:half]
    found = np.zeros(half, np.complex128)
    if f0 > 0:
        bins = (f0 * np.arange(1, int(rate / 2 / f0) + 1) * fft / rate).astype(int)
        bins = bins[bins < half]
        found[bins] = level[bins] * (1 - air[bins])
    turn = np.random.default_rng(seed).normal(size=half)
    found += 0.1 * air * np.exp(1j * turn)
    return np.roll(np.fft.irfft(found, fft), fft // 2) * np.hanning(fft)


def synthesised(frames: DataFrame, key: str, order: str, f0: str = "f0", spectrum: str = "spectrum", aperiodicity: str = "aperiodicity", rate: int = 44100, fft: int = 1024, hop_ms: float = 5.0, fade: int = 64) -> DataFrame:
    """(key, samples): each utterance as sound at its peak's scale of at most 1.

    Voiced pulses follow each other at the period of their frame's f0, not before the frame begins; unvoiced ones stand at their frame. The
    noise is seeded by the frame's number, so a task that runs again gives the same samples. Null f0 counts as unvoiced, null arrays as
    empty; an utterance of no frames is not in the result."""
    hop = hop_ms * rate / 1000
    types = dict(frames.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        pulses, positions, after = [], [], 0.0
        columns = (table.column(c).to_pylist() for c in (f0, spectrum, aperiodicity))
        for i, (pitch, level, air) in enumerate(zip(*columns, strict=True)):
            shape = (np.array(level or [], np.float64), np.array(air or [], np.float64))
            start, end = i * hop, (i + 1) * hop
            if pitch and pitch > 0:
                after = max(after, start)
                made = pulse(pitch, *shape, rate, fft, i)
                while after < end:
                    pulses.append(made)
                    positions.append(int(after))
                    after += rate / pitch
            else:
                pulses.append(pulse(0.0, *shape, rate, fft, i))
                positions.append(int(start))
        x = crossfade_add(pulses, positions, int(table.num_rows * hop) + fft, fade)
        top = np.abs(x).max() if len(x) else 0
        return pa.table({key: table.column(key).slice(0, 1), "samples": pa.array([(x / top if top > 1 else x).tolist()], pa.list_(pa.float64()))})

    return frames.select(key, order, f0, spectrum, aperiodicity).groupBy(key).applyInArrow(run, f"{key} {types[key]}, samples array<double>")


def pitch(frames: DataFrame, id: str, samples: str, rate: int, low: float = 71.0, high: float = 800.0, least: float = 0.3) -> DataFrame:
    """(id, f0, strength) of each frame of samples: the shortest lag among those of ``low`` to ``high`` Hz whose normalised
    autocorrelation peaks within 5 % of the highest, so that a multiple of the period doesn't take its place.

    f0 is 0 where the peak is under ``least`` and for frames that are null, empty, silent or too short."""

    def one(x: np.ndarray) -> tuple[float, float]:
        x = x - x.mean() if len(x) else x
        first, last = max(1, int(np.ceil(rate / high))), min(int(rate / low), len(x) - 2)
        energy = float(x @ x)
        if last <= first or energy <= SILENT:
            return 0.0, 0.0
        n = 1 << (2 * len(x) - 1).bit_length()
        r = np.fft.irfft(np.abs(np.fft.rfft(x, n)) ** 2, n)[: last + 2]
        sums = np.concatenate([[0.0], np.cumsum(x * x)])
        lags = np.arange(last + 2)
        r = r / np.maximum(np.sqrt((sums[len(x) - lags]) * (energy - sums[lags])), SILENT)
        inner = r[first : last + 1]
        peaks = (inner >= r[first - 1 : last]) & (inner >= r[first + 1 : last + 2]) & (inner >= 0.95 * inner.max())
        k = first + int(peaks.argmax() if peaks.any() else inner.argmax())
        bend = r[k - 1] - 2 * r[k] + r[k + 1]
        shift = 0.5 * (r[k - 1] - r[k + 1]) / bend if bend < 0 else 0.0
        return (rate / (k + float(np.clip(shift, -0.5, 0.5))), float(r[k])) if r[k] >= least else (0.0, float(r[k]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(np.array(x.as_py() or [], np.float64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f for f, _ in found], pa.float64()), pa.array([s for _, s in found], pa.float64())], names=[id, "f0", "strength"])

    return frames.select(id, samples).mapInArrow(run, f"{id} {dict(frames.dtypes)[id]}, f0 double, strength double")
