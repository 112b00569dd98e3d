"""Augmented rows of pitch and value series: shifted pitch, stretched time, added noise, tilted spectrum.

Series are arrays of doubles; null arrays give null results, empty ones empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import signal

#: The ranges that settings are drawn from, and the noise level's mean, deviation and bound in dB.
PITCH, STRETCH, TILT = (-2.0, 2.0), (0.8, 1.2), (-3.0, 3.0)
NOISE_DB = (-40.0, 5.0, 10.0)
KINDS = ("original", "pitch", "time", "noise", "tilt")


def stretched(values: str, factor: float) -> Column:
    """int(n / factor) values, by linear interpolation."""
    return signal.resample(values, 1.0 / factor)


def unit(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that the keys and the seed fix, so that a task that runs again draws the same: 52 bits of a SHA-256, null as ``-``."""
    text = F.concat_ws(":", *(F.coalesce(k.cast("string"), F.lit("-")) for k in keys), F.lit(seed))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal(seed: int, *keys: Column) -> Column:
    """A standard normal number that the keys and the seed fix (Box and Muller)."""
    return F.sqrt(-2 * F.log(1 - unit(seed, *keys))) * F.cos(2 * F.pi() * unit(seed + 1, *keys))


def noisy(values: Column, decibels: Column, seed: int, *keys: Column) -> Column:
    """Each value times 1 + a normal number at a level in dB below it."""
    level = F.pow(F.lit(10.0), decibels / 20)
    return F.transform(values, lambda v, i: v * (1 + level * normal(seed, *keys, i)))


def settings(seed: int, *keys: Column) -> Column:
    """struct(pitch, stretch, tilt, noise_db) drawn for a row: uniform in their ranges, the noise normal and bounded around its mean."""
    between = lambda r, k: r[0] + unit(seed + k, *keys) * (r[1] - r[0])
    mean, deviation, most = NOISE_DB
    noise = F.lit(mean) + F.greatest(F.lit(-most), F.least(F.lit(most), deviation * normal(seed + 9, *keys)))
    return F.struct(between(PITCH, 1).alias("pitch"), between(STRETCH, 2).alias("stretch"), between(TILT, 3).alias("tilt"), noise.alias("noise_db"))


def stretched_by(values: Column, factor: Column) -> Column:
    """``stretched`` by a factor that differs from row to row; the last value is held."""
    n = F.floor(F.size(values) / factor).cast("int")

    def at(i: Column) -> Column:
        x = i * factor
        k = F.floor(x).cast("int")
        a = F.get(values, k)
        return a + (F.coalesce(F.get(values, k + 1), a) - a) * (x - k)

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), at)).otherwise(F.slice(values, 1, 0))


def pitched_by(values: Column, semitones: Column, low: float = 50.0, high: float = 1000.0) -> Column:
    """Voiced values (above 0) moved by semitones, kept from low to high; others stay."""
    up = F.pow(F.lit(2.0), semitones / 12)
    return F.transform(values, lambda v: F.when(v > 0, F.greatest(F.lit(low), F.least(F.lit(high), v * up))).otherwise(v))


def augmented(rows: DataFrame, key: str, values: str, seed: int = 42) -> DataFrame:
    """For each row five: (key, kind, values, amount), the original and one of each kind with settings that the key and the seed fix.

    A null key draws as a key of its own; rows that repeat a key draw alike."""
    k, v = F.col(key), F.col(values)
    x = rows.withColumn("_s", settings(seed, k))
    s = F.col("_s")
    tilt = F.transform(v, lambda e, i: e + F.log(F.pow(F.lit(10.0), s["tilt"] * i / F.greatest(F.size(v) - 1, F.lit(1)) / 20)))
    made = {
        "original": (v, F.lit(0.0)), "pitch": (pitched_by(v, s["pitch"]), s["pitch"]), "time": (stretched_by(v, s["stretch"]), s["stretch"]),
        "noise": (noisy(v, s["noise_db"], seed + 20, k), s["noise_db"]), "tilt": (tilt, s["tilt"]),
    }
    each = F.array(*(F.struct(F.lit(n).alias("kind"), a.alias("values"), b.alias("amount")) for n, (a, b) in made.items()))
    return x.select(key, F.inline(each))


def name(stem: Column, kind: Column, amount: Column) -> Column:
    """``stem_kind1.5.wav``; the original keeps its stem."""
    return F.when(kind == "original", F.concat(stem, F.lit(".wav"))).otherwise(F.format_string("%s_%s%.1f.wav", stem, kind, amount))
