"""Frames of series, what they hold, the window that suits it, and their overlapped sum.

Frames are cut by grouping samples on (keys, frame), so a series of any length is spread; windows are a table of a few rows that depend on nothing
but their kind and size. Squares of a normalised window add up to one at every sample that all its frames reach, so what is windowed twice comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from seqloom.functions import signal

KINDS = ("hann", "blackman", "blackman_harris", "tukey", "kaiser")


def content(f0: Column, spectrum: Column, aperiodicity: Column, rate: float) -> Column:
    """What the choice looks at, from a log spectrum of n bins up to half the rate: pitch, centroid, harmonic ratio, transient factor, dynamic range, formants.

    An empty or null spectrum counts as 1000 Hz, 0.7, 0.2, 40 and no formants; without aperiodicity the harmonic ratio is 0.7. Formants are bins above
    both neighbours on each side, between 200 and 4000 Hz, in spectra of ten bins or more."""
    n, blank = F.size(spectrum), F.coalesce(F.size(spectrum) < 1, F.lit(True))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    hertz = lambda i: i * rate / (2.0 * n)
    power = total(F.transform(spectrum, F.exp))
    centroid = F.when(blank, 1000.0).when(power > 0, total(F.transform(spectrum, lambda x, i: F.exp(x) * hertz(i))) / power).otherwise(1000.0)
    noise = F.when(F.size(aperiodicity) > 0, total(aperiodicity) / F.size(aperiodicity))
    ratio = F.when(blank | noise.isNull(), 0.7).otherwise(1.0 - F.least(F.lit(1.0), noise))
    above = lambda i, k: F.get(spectrum, i) > F.get(spectrum, i + k)
    peaks = F.filter(F.sequence(F.lit(2), n - 3), lambda i: above(i, -1) & above(i, 1) & above(i, -2) & above(i, 2) & (hertz(i) > 200.0) & (hertz(i) < 4000.0))
    formants = F.when(~blank & (n >= 10), F.transform(peaks, hertz)).otherwise(F.array().cast("array<double>"))
    span = F.when(blank | (n < 2), 40.0).otherwise(F.array_max(spectrum) - F.array_min(spectrum))
    return F.struct(
        f0.alias("pitch"), centroid.alias("centroid"), ratio.alias("harmonic_ratio"), F.when(blank, 0.2).otherwise(F.least(F.lit(0.8), centroid / 4000.0)).alias("transient"), span.alias("dynamic_range"),
        formants.alias("formants"),
    )


def choice(c: Column) -> Column:
    """The kind of window for a content: by harmonics, then transients, formants, dynamic range."""
    harmonic = c["harmonic_ratio"] > 0.8
    return (
        F.when(harmonic & (c["pitch"] < 200.0), "blackman_harris").when(harmonic, "blackman").when(c["transient"] > 0.6, "tukey").when(F.size(c["formants"]) >= 2, "kaiser")
        .when(c["dynamic_range"] > 40.0, "blackman_harris").otherwise("hann")
    )


def faded(window: np.ndarray, strength: float = 0.8) -> np.ndarray:
    """A steeper rise over the first tenth, against echoes ahead of a sound, and a little more just after the middle."""
    out, n = window.copy(), len(window)
    fade = int(n * 0.1)
    if fade > 1:
        out[:fade] *= (np.arange(fade) / (fade - 1)) ** (1 + strength)
        out[n // 2 : n // 2 + fade // 2] *= 1 + 0.05 * strength
    return out


def tapered(window: np.ndarray, target_db: float = -60.0) -> np.ndarray:
    """Sine tapers at both ends, the longer the more the strongest bin beyond the first exceeds the target, up to three tenths of the length."""
    terms = np.abs(np.exp(-2j * np.pi * np.outer(np.arange(len(window) // 2), np.arange(len(window))) / len(window)) @ window)
    if len(terms) < 2 or terms[0] <= 0 or terms[1:].max() <= 0:
        return window
    over = 20 * np.log10(terms[1:].max() / terms[0]) - target_db
    length = int(len(window) * min(0.3, over / 60)) if over > 0 else 0
    out = window.copy()
    for i in range(length):
        out[[i, -1 - i]] *= np.sin(np.pi * i / (2 * length))
    return out


def normalised(window: np.ndarray, hop: int) -> np.ndarray:
    """The window divided so that its squares, shifted by multiples of the hop, add up to one; positions that no shift covers stay zero."""
    place = np.arange(len(window)) % hop
    sums = np.bincount(place, window**2, hop)[place]
    return window / np.sqrt(np.where(sums > 0, sums, 1))


def windows(spark: SparkSession, length: int, hop: int, pre_echo: float | None = 0.8, target_db: float | None = -60.0) -> DataFrame:
    """(kind, window): every kind, faded, tapered (None: not) and normalised."""
    if not 0 < hop <= length:
        raise ValueError("a hop is at least 1 and at most the length")
    plain = spark.range(1).select(*(signal.window(k, length).alias(k) for k in KINDS)).first()  # one row of a few windows
    rows = []
    for kind in KINDS:
        w = np.array(plain[kind], np.float64)
        w = w if pre_echo is None else faded(w, pre_echo)
        w = w if target_db is None else tapered(w, target_db)
        rows.append((kind, normalised(w, hop).tolist()))
    return spark.createDataFrame(rows, "kind string, window array<double>")


def cut(series: DataFrame, keys: list[str], at: str, value: str, length: int, hop: int) -> DataFrame:
    """(keys, frame, samples): frame k holds positions k * hop to k * hop + length - 1; only frames with a value at each of them. Positions of a key are distinct whole numbers."""
    p = F.col(at).cast("long")
    last, first = F.floor(p / hop), F.ceil((p - (length - 1)) / hop)
    x = series.where(F.col(value).isNotNull() & F.col(at).isNotNull()).withColumn("frame", F.explode(F.sequence(first, last)))
    x = x.groupBy(*keys, "frame").agg(F.array_sort(F.collect_list(F.struct(p.alias("p"), F.col(value).cast("double").alias("v")))).alias("s"))
    return x.where(F.size("s") == length).select(*keys, "frame", F.col("s.v").alias("samples"))


def overlapped(frames: DataFrame, keys: list[str], shapes: DataFrame, hop: int, kind: str = "kind") -> DataFrame:
    """(keys, at, value, frames): the sum of frames windowed twice (before and after what was done to them) at each position, and how many frames reach it."""
    x = frames.join(F.broadcast(shapes), kind)  # a row for each of KINDS
    x = x.select(*keys, "frame", F.posexplode(F.zip_with("samples", "window", lambda s, w: s * w * w)).alias("i", "v"))
    return x.groupBy(*keys, (F.col("frame") * hop + F.col("i")).alias("at")).agg(F.sum("v").alias("value"), F.count("*").alias("frames"))


def spectral_bands(frames: DataFrame, bands: int = 4, samples: str = "samples", out: str = "bands") -> DataFrame:
    """frames with the energy of each of ``bands`` equal parts of the bins from 0 to half the rate; together they are the frame's energy.

    One transform of a batch's frames of the same length; a band is the difference of two prefix sums over the bins."""
    names = frames.columns

    def energies(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        power = np.abs(np.fft.rfft(x, axis=1)) ** 2 / n
        power[:, 1 : (n + 1) // 2] *= 2
        upto = np.concatenate([np.zeros((len(x), 1)), np.cumsum(power, axis=1)], axis=1)
        edges = np.arange(bands + 1) * power.shape[1] // bands
        return upto[:, edges[1:]] - upto[:, edges[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(samples)
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                batch = whole.slice(k, 2048)
                column = batch.column(at)
                lengths = np.array([len(v) if v.is_valid else 0 for v in column])
                found = np.zeros((batch.num_rows, bands))
                for n in np.unique(lengths[lengths > 0]):
                    rows = np.flatnonzero(lengths == n)
                    found[rows] = energies(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found.tolist(), pa.list_(pa.float64()))], names=[*names, out])

    return frames.mapInArrow(run, StructType([*frames.schema, StructField(out, ArrayType(DoubleType()))]))


def crossings(samples: Column) -> Column:
    """Changes between negative and not negative neighbours, for each pair of neighbours; 0 for fewer than two samples."""
    pairs = F.zip_with(F.slice(samples, F.lit(1), F.size(samples) - 1), F.slice(samples, F.lit(2), F.size(samples) - 1), lambda a, b: ((a >= 0) != (b >= 0)).cast("int"))
    return F.when(F.size(samples) > 1, F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / (F.size(samples) - 1)).otherwise(0.0)


def peaks(samples: Column, regions: int = 3) -> Column:
    """The greatest square in each of ``regions`` equal parts of the samples; 0 for an empty part."""
    n = F.size(samples)
    part = lambda r: F.slice(samples, F.floor(n * r / regions).cast("int") + 1, (F.floor(n * (r + 1) / regions) - F.floor(n * r / regions)).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(regions - 1)), lambda r: F.coalesce(F.array_max(F.transform(part(r), lambda x: x * x)), F.lit(0.0)))
