"""Rule tables: named conditions over a row, reported one row for each that fails, and roll-ups of what they report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def issues(df: DataFrame, keys: list[str], rules: dict[str, tuple[str, Column]]) -> DataFrame:
    """(keys, rule, severity) for each rule that a row breaks; rules: name to (severity, condition that must hold).

    A condition that is null counts as broken. One pass, no shuffle."""
    broken = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"))) for name, (severity, ok) in rules.items()))
    return df.select(*keys, F.inline(F.array_compact(broken)))


def finite(*values: Column) -> Column:
    out = F.lit(True)
    for v in values:
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return out


def timing_consistent(offset: Column, consonant: Column, blank: Column, preutterance: Column) -> Column:
    """Nothing negative, consonant or blank positive, and a preutterance of at most twice their sum."""
    total = consonant + blank
    return (offset >= 0) & (consonant >= 0) & (blank >= 0) & (total > 0) & (preutterance <= 2 * total)


def alias_kind(alias: Column) -> Column:
    """VCV for ``vowel syllable``, CV for one consonant and a vowel, V for a vowel alone, else other."""
    return F.when(alias.rlike("^[aiueo] [a-z]*[aiueo]$"), "VCV").when(alias.rlike("^[b-df-hj-np-tv-z][aiueo]$"), "CV").when(alias.rlike("^[aiueo]$"), "V").otherwise("other")


def matching(labels: DataFrame, questions: DataFrame, label: str, pattern: str, glob: bool = False) -> DataFrame:
    """labels joined with every question whose pattern occurs in the label; with ``glob``, * stands for anything.

    Questions are a model's own set, few by nature, and are sent to all tasks by a broadcast nested loop."""
    if glob:
        regex = F.concat(F.lit("^"), F.replace(F.regexp_replace(F.col(pattern), "([.+?^$(){}|\\[\\]\\\\])", "\\\\$1"), F.lit("*"), F.lit(".*")), F.lit("$"))
        return labels.join(F.broadcast(questions), F.regexp_like(F.col(label), regex))
    return labels.join(F.broadcast(questions), F.contains(F.col(label), F.col(pattern)))


def category_scores(found: DataFrame, key: str, category: str, severity: str) -> DataFrame:
    """Consistency 1 - sum of 10/5/2/1 over 100, integrity 1 - n/10, both at least 0, and how many of each category."""
    weight = F.when(F.col(severity) == "critical", 10).when(F.col(severity) == "error", 5).when(F.col(severity) == "warning", 2).otherwise(1)
    x = found.groupBy(key).agg(F.count("*").alias("n"), F.sum(weight).alias("_w"), F.countDistinct(category).alias("categories"))
    return x.select(key, "n", "categories", F.greatest(F.lit(0.0), 1 - F.col("_w") / 100).alias("consistency"), F.greatest(F.lit(0.0), 1 - F.col("n") / 10).alias("integrity"))


def feature_quality(df: DataFrame, keys: list[str], good: Column, sure: Column) -> DataFrame:
    """By key the mean of the share of good rows and the mean confidence, from 0 to 1; a null ``good`` counts as not good."""
    mean = (F.avg(F.coalesce(good, F.lit(False)).cast("double")) + F.avg(sure)) / 2
    return df.groupBy(*keys).agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)).alias("quality"))


def safe_variance(value: str) -> Column:
    """The population variance, 1e-6 at least and for groups without values."""
    return F.greatest(F.coalesce(F.var_pop(value), F.lit(1e-6)), F.lit(1e-6))
