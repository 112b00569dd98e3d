"""Flags to synthesis parameters, by kind of voice: tables of factors and arithmetic inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How far each kind of voice follows each flag.
SENSITIVITY = {
    "male_adult": {"g": 0.8, "t": 1.2, "bre": 0.9, "bri": 0.9},
    "female_adult": {"g": 1.3, "t": 0.8, "bre": 1.1, "bri": 1.1},
    "child": {"g": 0.6, "t": 0.7, "bre": 0.6, "bri": 1.2},
    "robotic": {"g": 1.5, "t": 1.5, "bre": 0.3, "bri": 1.8},
    "whisper": {"g": 0.7, "t": 0.3, "bre": 2.0, "bri": 0.5},
    "growl": {"g": 1.2, "t": 1.8, "bre": 1.3, "bri": 0.7},
}

# What each kind of voice changes afterwards. Formant and brightness factors act on the distance from 1.
ADJUSTMENT = {
    "male_adult": {"formant": 0.7, "tension": 1.2},
    "female_adult": {"formant": 1.3, "tension": 0.8},
    "child": {"formant": 0.5, "brightness": 0.8, "breath": 0.6},
    "robotic": {"emphasis": 1.5, "phase": 0.3},
    "whisper": {"emphasis": 0.3, "least_breath": 0.6, "aperiodicity": 1.5},
    "growl": {"emphasis": 1.8, "tilt": -2.0, "roughness": 0.4},
}

OUT = ["formant", "tension", "breath", "brightness", "emphasis", "tilt", "roughness", "phase", "aperiodicity"]


def _by_voice(voice: str, name: str, table: dict[str, dict[str, float]], other: float) -> Column:
    held = {kind: row[name] for kind, row in table.items() if name in row}
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in held.items() for x in pair)), F.lower(voice)), F.lit(other))


def convert(df: DataFrame, g: str = "g", t: str = "t", bre: str = "bre", bri: str = "bri", voice: str = "voice", f0: str = "f0", most_formant: float = 2.0, most_brightness: float = 3.0) -> DataFrame:
    """df with the columns of ``OUT``: flags scaled by voice, their interactions, the voice's own changes, limits, and consistency.

    Null flags count as 0, a null or unknown voice changes nothing, a null or non-positive f0 counts as 220 Hz. Input columns named like
    one of ``OUT`` are replaced."""
    flag = {n: F.coalesce(F.col(c), F.lit(0)) for n, c in (("g", g), ("t", t), ("bre", bre), ("bri", bri))}
    own = lambda name, other: _by_voice(voice, name, ADJUSTMENT, other)
    share = {n: v / 100.0 * _by_voice(voice, n, SENSITIVITY, 1.0) for n, v in flag.items() if n != "g"}
    octaves = F.log2(F.when(F.col(f0) > 0, F.col(f0)).otherwise(220.0) / 110.0)

    strained = (flag["bre"] > 50) & (flag["t"] > 40)
    formant = 1 + flag["g"] / 100.0 * 0.5 * _by_voice(voice, "g", SENSITIVITY, 1.0) * (1 + octaves * 0.2) * 0.8
    formant = formant + F.when((F.abs(flag["bri"]) > 30) & (F.abs(flag["g"]) > 20), flag["bri"] / 100.0 * (flag["g"] / 100.0) * 0.15).otherwise(0.0)
    tension = F.tanh(share["t"] * 1.5) * F.when(strained, 0.8).otherwise(1.0)
    breath = F.least(F.greatest(share["bre"] * 0.8, F.lit(0.0)), F.lit(1.0)) * F.when(strained, 0.7).otherwise(1.0)
    brightness = (1 + share["bri"] * 0.6) * F.when((flag["bre"] > 30) & (flag["bri"] != 0), 1 - flag["bre"] / 100.0 * 0.2).otherwise(1.0)
    both = (flag["g"] > 30) & (flag["t"] > 30)

    between = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    limited = {
        "formant": between(1 + (formant - 1) * own("formant", 1.0), 1 / most_formant, most_formant),
        "tension": between(tension * own("tension", 1.0), -1.0, 1.0),
        "breath": between(F.greatest(breath * own("breath", 1.0), own("least_breath", 0.0)), 0.0, 1.0),
        "brightness": between(1 + (brightness - 1) * own("brightness", 1.0), 1 / most_brightness, most_brightness),
        "emphasis": between(F.when(both, 0.2).otherwise(0.0) * own("emphasis", 1.0), -1.0, 2.0),
        "tilt": between(F.when(both, 1.0).otherwise(0.0) + own("tilt", 0.0), -10.0, 10.0),
        "roughness": own("roughness", 0.0),
        "phase": F.least(F.lit(0.8), own("phase", 0.0)),
        "aperiodicity": own("aperiodicity", 1.0),
    }
    away = F.abs(F.col("formant") - 1)
    return df.withColumns(limited).withColumns({
        "emphasis": F.when((F.col("breath") > 0.7) & (F.col("emphasis") > 0.5), F.col("emphasis") * 0.5).otherwise(F.col("emphasis")),
        "brightness": F.when(away > 0.5, F.col("brightness") * (1 - away * 0.3)).otherwise(F.col("brightness")),
    })


def kind(f0_mean: Column, centroid: Column, richness: Column) -> Column:
    """A guess of the kind of voice from mean f0, spectral centroid and harmonic richness."""
    high = F.when((f0_mean > 350) & (centroid > 3000), "child").otherwise("female_adult")
    middle = F.when(richness < 0.3, "whisper").when((richness > 0.9) & (centroid < 1500), "growl").otherwise("unknown")
    return F.when(f0_mean < 120, "male_adult").when(f0_mean > 250, high).otherwise(middle)


def pulse(spectrum: Column, aperiodicity: Column, breath: Column, scale: Column, tilt: Column, formant: Column, brightness: Column) -> Column:
    """struct(spectrum, aperiodicity, formant_shift, amplitude_scale, pitch_shift) of a pulse under a voice's parameters.

    Breath times ``scale`` is added to each aperiodicity, up to 1; the linear spectrum is tilted by ``tilt`` dB from its first bin to beyond its last. Null
    arrays stay null, empty ones empty; null parameters change nothing."""
    zero, one = F.lit(0.0), F.lit(1.0)
    more = F.coalesce(breath * scale, zero)
    slope = F.coalesce(tilt, zero)
    return F.struct(
        F.transform(spectrum, lambda x, i: x * F.pow(F.lit(10.0), slope * i / F.size(spectrum) / 20.0)).alias("spectrum"), F.transform(aperiodicity, lambda a: F.least(one, a + more)).alias("aperiodicity"),
        F.coalesce(formant, one).alias("formant_shift"), F.coalesce(brightness, one).alias("amplitude_scale"), one.alias("pitch_shift"),
    )


def engine(harmonics: Column, threshold: Column, noise_floor: Column, corrects: Column, phase: Column, emphasis: Column, breath: Column, tension: Column) -> Column:
    """struct(anti_aliasing, noise_floor, random_phase, harmonics, threshold, window, adaptive, less_pre_echo, side_lobe_db) that a voice's parameters ask of synthesis.

    Emphasis over 0.1 raises the number of harmonics (cut to whole) and lowers their threshold by half of it; much breath asks for adaptive Gaussian windows, tension for
    less pre-echo and side lobes of -70 dB. A window, flag or level that nothing asks for is null."""
    more = F.coalesce(emphasis > 0.1, F.lit(False))
    breathy, tense = F.coalesce(breath > 0.3, F.lit(False)), F.coalesce(tension > 0.5, F.lit(False))
    return F.struct(
        corrects.alias("anti_aliasing"), noise_floor.alias("noise_floor"), F.coalesce(phase > 0.1, F.lit(False)).alias("random_phase"), F.when(more, F.floor(harmonics * (1 + emphasis))).otherwise(harmonics).cast("int").alias("harmonics"),
        F.when(more, threshold * (1 - emphasis * 0.5)).otherwise(threshold).alias("threshold"), F.when(breathy, F.lit("gaussian")).alias("window"), F.when(breathy, F.lit(True)).alias("adaptive"),
        F.when(tense, F.lit(True)).alias("less_pre_echo"), F.when(tense, F.lit(-70.0)).alias("side_lobe_db"),
    )
