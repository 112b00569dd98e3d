"""Student's t as column arithmetic: p-values, critical values, pooled effects. Nothing leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lanczos' coefficients of the gamma function for g = 7.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def _let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` a value that is computed once, however often ``of`` uses it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x of 0.5 or more."""
    z = x - 1.0
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:], 1):
        total = total + c / (z + float(i))
    t = z + 7.5
    return 0.9189385332046727 + (z + 0.5) * F.ln(t) - t + F.ln(total)


def _fraction(x: Column, a: Column, b: Column, terms: int) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz' method; converges fast for x below (a + 1) / (a + b + 2)."""

    def numerator(i: Column) -> Column:
        k = F.floor((i + 1) / 2).cast("double")
        return F.when(i % 2 == 1, k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k))).otherwise(-(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1)))

    def step(s: Column, v: Column) -> Column:
        d, c = 1 / (1 + v * s["d"]), 1 + v / s["c"]
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    # the even numerators belong to k of the odd one before them
    values = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda k: F.array(numerator(2 * k - 1), numerator(2 * k))))
    first = 1 / (1 - (a + b) * x / (a + 1))
    return F.aggregate(values, F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 100) -> Column:
    """The regularised incomplete beta function of x from 0 to 1, for a and b of 0.5 or more; for either beyond some ten thousands take more terms."""
    low = x < (a + 1) / (a + b + 2)
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    turned = F.struct(low.alias("low"), x.alias("at"), front.alias("front"), F.when(low, x).otherwise(1 - x).alias("x"), F.when(low, a).otherwise(b).alias("a"), F.when(low, b).otherwise(a).alias("b"))

    def of(s: Column) -> Column:
        value = s["front"] * _fraction(s["x"], s["a"], s["b"], terms) / s["a"]
        return F.when(s["at"] <= 0, 0.0).when(s["at"] >= 1, 1.0).when(s["low"], value).otherwise(1 - value)

    return _let(turned, of)


def two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for Student's t with df degrees of freedom (whole numbers from 1); null where either is."""
    return _let(F.struct(t.alias("t"), df.cast("double").alias("df")), lambda s: incomplete_beta(s["df"] / (s["df"] + s["t"] * s["t"]), s["df"] / 2, F.lit(0.5)))


def density(t: Column, df: Column) -> Column:
    df = df.cast("double")
    return F.exp(log_gamma((df + 1) / 2) - log_gamma(df / 2)) / F.sqrt(df * F.pi()) * F.pow(1 + t * t / df, -(df + 1) / 2)


def critical(level: float, df: Column, rounds: int = 8) -> Column:
    """The t that |T| reaches with probability 1 - level: exact for 1 and 2 degrees of freedom, else Newton's steps from an expansion around the normal one."""
    beyond, z = 1 - level, NormalDist().inv_cdf((1 + level) / 2)

    def of(v: Column) -> Column:
        start = z + (z**3 + z) / 4 / v + (5 * z**5 + 16 * z**3 + 3 * z) / 96 / v**2 + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384 / v**3
        near = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, lambda t, _: t + (two_sided(t, v) - beyond) / (2 * density(t, v)))
        two = level / math.sqrt(2 * (1 - (1 + level) / 2) * (1 + level) / 2)
        return F.when(v == 1, math.tan(math.pi * level / 2)).when(v == 2, two).when(v > 2, near)

    return _let(df.cast("double"), of)


def one_sample(rows: DataFrame, keys: list[str], value: str, expected: Column | float, level: float = 0.95) -> DataFrame:
    """(keys, n, mean, sd, t, d, p, low, high): each key's mean against the expected one, Cohen's d, the two-sided p and the interval of the mean.

    Nulls are left out. Fewer than two values, or equal ones, have no t, p or interval: null."""
    x = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    x = x.withColumn("sd", F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("sd"))).withColumn("_off", F.col("mean") - (expected if isinstance(expected, Column) else F.lit(float(expected))))
    x = x.withColumn("t", F.col("_off") / (F.col("sd") / F.sqrt("n"))).withColumn("d", F.col("_off") / F.col("sd"))
    reach = F.when(F.col("sd").isNotNull(), critical(level, F.col("n") - 1) * F.col("sd") / F.sqrt("n"))
    p = F.when(F.col("t").isNotNull(), two_sided(F.col("t"), F.col("n") - 1))
    return x.withColumn("p", p).withColumn("_reach", reach).withColumns({"low": F.col("mean") - F.col("_reach"), "high": F.col("mean") + F.col("_reach")}).drop("_off", "_reach")


def two_samples(rows: DataFrame, keys: list[str], value: str, second: Column, level: float = 0.95) -> DataFrame:
    """(keys, n1, n2, difference, pooled, t, d, p, low, high): first against second sample of each key by the pooled deviation; ``second`` tells rows of the second.

    Without two values in all beyond the two means, or with values all equal, there is no t: null."""
    part = lambda f, s: f(F.when(s, F.col(value)))
    x = rows.groupBy(*keys).agg(*(part(f, s).alias(f"{n}{i}") for i, s in ((1, ~second), (2, second)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    df = F.col("n1") + F.col("n2") - 2
    spread = F.sqrt((F.coalesce(F.col("v1"), F.lit(0.0)) * F.greatest(F.col("n1") - 1, F.lit(0)) + F.coalesce(F.col("v2"), F.lit(0.0)) * F.greatest(F.col("n2") - 1, F.lit(0))) / df)
    x = x.withColumn("difference", F.col("m1") - F.col("m2")).withColumn("_df", df).withColumn("pooled", F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (df > 0) & (spread > 0), spread))
    x = x.withColumn("_error", F.col("pooled") * F.sqrt(1 / F.col("n1") + 1 / F.col("n2"))).withColumn("t", F.col("difference") / F.col("_error")).withColumn("d", F.col("difference") / F.col("pooled"))
    x = x.withColumn("p", F.when(F.col("t").isNotNull(), two_sided(F.col("t"), F.col("_df")))).withColumn("_reach", F.when(F.col("t").isNotNull(), critical(level, F.col("_df")) * F.col("_error")))
    return x.select(*keys, "n1", "n2", "difference", "pooled", "t", "d", "p", (F.col("difference") - F.col("_reach")).alias("low"), (F.col("difference") + F.col("_reach")).alias("high"))
