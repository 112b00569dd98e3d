"""Window operators over ordered sequences: one shuffle by sequence key, no collection of a sequence's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def over(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def context(df: DataFrame, keys: list[str], order: list[str], label: str, width: int = 2, pad: str = "sil") -> DataFrame:
    """Columns l<k> and r<k>: the labels k places before and after, ``pad`` beyond the ends."""
    w = over(keys, order)
    left = {f"l{k}": F.lag(label, k, pad).over(w) for k in range(width, 0, -1)}
    return df.withColumns(left | {f"r{k}": F.lead(label, k, pad).over(w) for k in range(1, width + 1)})


def islands(df: DataFrame, keys: list[str], order: list[str], closes: Column, name: str = "island") -> DataFrame:
    """Groups that end after each row for which ``closes`` holds, numbered from 0."""
    before = over(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(closes.cast("long")).over(before), F.lit(0)))


def positions(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Place from the start and to the end, length, ratio, and flags of the first and last row."""
    w = over(keys, order)
    size, at = F.count("*").over(Window.partitionBy(*keys)), F.row_number().over(w)
    return df.withColumns({"from_start": at - 1, "to_end": size - at, "length": size, "ratio": (at - 1) / size, "initial": at == 1, "final": at == size})


def deltas(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """First and second dynamic features: half the central difference, the full one-sided difference at the ends."""
    w = over(keys, order)

    def of(c: str) -> Column:
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce((after - before) * 0.5, after - F.col(c), F.col(c) - before, F.lit(0.0))

    return df.withColumn("delta", of(value)).withColumn("delta2", of("delta"))


def gaps(df: DataFrame, keys: list[str], order: list[str], start: str, end: str) -> DataFrame:
    """gap: start minus the end before it; negative where two rows overlap, null for the first."""
    return df.withColumn("gap", F.col(start) - F.lag(end).over(over(keys, order)))


def smoothed(df: DataFrame, keys: list[str], order: list[str], at: str, end: str) -> DataFrame:
    """Half the own onset, a quarter each of the end before and the onset after; ends stay as they are."""
    w = over(keys, order)
    return df.withColumn("smooth", F.coalesce(0.5 * F.col(at) + 0.25 * F.lag(end).over(w) + 0.25 * F.lead(at).over(w), F.col(at).cast("double")))


def peaks(df: DataFrame, keys: list[str], order: list[str], value: str, reach: int = 2) -> DataFrame:
    """Rows greater than all neighbours within ``reach``, which must exist."""
    w, wide = over(keys, order), F.lit(True)
    for k in range(1, reach + 1):
        wide = wide & (F.col(value) > F.lag(value, k).over(w)) & (F.col(value) > F.lead(value, k).over(w))
    return df.withColumn("_peak", wide).where("_peak").drop("_peak")


def roughness(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Mean squared second difference of each sequence of three rows or more."""
    w = over(keys, order)
    d = F.lag(value).over(w) - 2 * F.col(value) + F.lead(value).over(w)
    return df.withColumn("_d", d).where("_d IS NOT NULL").groupBy(*keys).agg(F.avg(F.col("_d") * F.col("_d")).alias("roughness"))


def running(df: DataFrame, keys: list[str], order: list[str], step: Column, name: str) -> DataFrame:
    """Sum of the steps of all rows before."""
    return df.withColumn(name, F.coalesce(F.sum(step).over(over(keys, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def rolling(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int) -> DataFrame:
    w = over(keys, order).rowsBetween(-rows + 1, 0)
    return df.withColumns({"roll_mean": F.avg(value).over(w), "roll_max": F.max(value).over(w), "roll_n": F.count(value).over(w)})


def crossings(df: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """Sign changes against the row before, per sequence, and their rate over its rows."""
    x = df.withColumn("_s", value >= 0).withColumn("_c", (F.col("_s") != F.lag("_s").over(over(keys, order))).cast("long"))
    return x.groupBy(*keys).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("crossings"), (F.coalesce(F.sum("_c"), F.lit(0)) / F.count("*")).alias("rate"))


def without_outliers(df: DataFrame, keys: list[str], value: str, sigmas: float = 2.0) -> DataFrame:
    """Rows within so many sample deviations of their group's mean; groups of fewer than three rows stay whole."""
    w = Window.partitionBy(*keys)
    x = df.withColumns({"_m": F.avg(value).over(w), "_s": F.stddev_samp(value).over(w), "_n": F.count(value).over(w)})
    return x.where((F.col("_n") < 3) | (F.abs(F.col(value) - F.col("_m")) <= sigmas * F.col("_s"))).drop("_m", "_s", "_n")


def control_limits(df: DataFrame, keys: list[str], time_us: str, value: str, span_us: int, sigmas: float = 3.0) -> DataFrame:
    """Mean over the span before each row, and its group's control limits.

    Times are cut into spans; a row stands in its own and in the next, so that what a row looks back on is in one place and the work does not grow with the
    number of rows in a span: the mean comes from two running sums, of twelve decimals and thus exact. Where a value does not fit these, spans are added up row by row."""
    fixed, time = F.col(value).try_cast("decimal(26,12)"), F.col(time_us)
    own = F.floor((time - F.pmod(time, F.lit(span_us))) / span_us).cast("long")
    if df.where(F.col(value).isNotNull() & fixed.isNull()).isEmpty():
        x = df.withColumn("_f", fixed).select("*", F.posexplode(F.when(time.isNull(), F.array(own)).otherwise(F.array(own, own + 1))).alias("_i", "_b"))
        order = Window.partitionBy(*keys, "_b").orderBy(time_us)
        upto, older = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(Window.unboundedPreceding, -span_us - 1)
        old = lambda f: F.when(time.isNull(), 0).otherwise(F.coalesce(f.over(older), F.lit(0)))
        x = x.withColumns({"_s": F.sum("_f").over(upto) - old(F.sum("_f")), "_n": F.count("_f").over(upto) - old(F.count("_f"))})
        x = x.where("_i = 0").withColumn("mean_before", F.try_divide(F.col("_s").cast("double"), F.col("_n"))).drop("_f", "_i", "_b", "_s", "_n")
    else:
        x = df.withColumn("mean_before", F.avg(value).over(Window.partitionBy(*keys).orderBy(time_us).rangeBetween(-span_us, 0)))
    mean, dev = F.avg(value), F.stddev_samp(value)
    group = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg((mean + sigmas * dev).alias("upper"), (mean - sigmas * dev).alias("lower"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    x = x.join(group, same).drop(*(f"_k{i}" for i in range(len(keys))))
    return x.withColumn("out", (F.col(value) > F.col("upper")) | (F.col(value) < F.col("lower")))


def exponential_mean(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = 0.1) -> DataFrame:
    """Last exponential moving average of each sequence. The fold needs a sequence's values in one row; where sequences are unbounded use
    the streaming form."""
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_a"))
    fold = F.expr(f"aggregate(slice(_a, 2, size(_a)), _a[0]._v, (acc, x) -> {1 - alpha} * acc + {alpha} * x._v)")
    return rows.select(*keys, fold.alias("ema"))


def split_tail(df: DataFrame, keys: list[str], order: list[str], fraction: float) -> DataFrame:
    """part: 'train', or 'validation' for the last fraction of each sequence."""
    p = F.row_number().over(over(keys, order)) <= F.floor(F.count("*").over(Window.partitionBy(*keys)) * (1 - fraction))
    return df.withColumn("part", F.when(p, "train").otherwise("validation"))


def boundaries(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Runs of equal state: first and last place and length."""
    w = over(keys, order)
    x = df.withColumn("_at", F.row_number().over(w) - 1).withColumn("_new", (~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.col("_at") == 0)).cast("long"))
    x = x.withColumn("run", F.sum("_new").over(w) - 1)
    return x.groupBy(*keys, "run", state).agg(F.min("_at").alias("first"), F.max("_at").alias("last"), F.count("*").alias("frames"))


def tempo_seconds(changes: DataFrame, keys: list[str], tick: str, bpm: str, ppq: int = 480) -> DataFrame:
    """Seconds at each tempo change since the first of its sequence; every stretch counts at the tempo that held in it."""
    w = over(keys, [tick])
    stretch = (F.col(tick) - F.lag(tick, 1).over(w)) / float(ppq) * 60.0 / F.lag(bpm, 1).over(w)
    return changes.withColumn("_s", F.coalesce(stretch, F.lit(0.0))).withColumn("seconds", F.sum("_s").over(w)).drop("_s")


def by_position(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str], name: str = "i") -> DataFrame:
    """The rows of both sides that stand at the same place (from 1) of the same sequence: as many as the shorter one has.

    Ties of the order keys leave places open, so give keys that tell rows apart; a null key matches nothing."""
    place = lambda df, order: df.withColumn(name, F.row_number().over(over(keys, order)))
    return place(left, left_order).join(place(right, right_order), [*keys, name])


def number_context(df: DataFrame, keys: list[str], order: list[str], value: str, width: int = 2) -> DataFrame:
    """df with the values ``l<width>`` to ``l1`` before and ``r1`` to ``r<width>`` after each row; 0 beyond the ends and for nulls."""
    w = over(keys, order)
    found = {f"{side}{i}": F.coalesce(f(value, i).over(w), F.lit(0.0)) for side, f in (("l", F.lag), ("r", F.lead)) for i in range(1, width + 1)}
    return df.withColumns(found)


def ranked_normaliser(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """By key: mean, population deviation, least, most, and the values at ranks n/4, n/2 and 3n/4 (from 0, no interpolation).

    Ranks are found over counts of equal values, so equal values are combined before a sort; nulls are left out."""
    rows = df.where(F.col(value).isNotNull())
    stats = rows.groupBy(*keys).agg(F.count(value).alias("_n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most"))
    upto = F.sum("_m").over(over(keys, ["_v"]).rowsBetween(Window.unboundedPreceding, 0))
    ranks = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_m")).withColumn("_b", upto).join(stats.select(*keys, "_n"), keys)
    at = lambda share, name: F.min(F.when(F.col("_b") > F.expr(share), F.col("_v"))).alias(name)
    quartiles = ranks.groupBy(*keys).agg(at("_n div 4", "q25"), at("_n div 2", "q50"), at("3 * _n div 4", "q75"))
    return stats.drop("_n").join(quartiles, keys)


def compared(left: DataFrame, right: DataFrame, keys: list[str], place: str, a: str, b: str) -> DataFrame:
    """By key: places of the longer side, equal values at the same place, and their ``share``. Nulls equal nothing and are no places."""
    both = left.select(*keys, place, a).join(right.select(*keys, place, b), [*keys, place], "full")
    got = both.groupBy(*keys).agg(F.greatest(F.count(a), F.count(b)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    return got.withColumn("share", F.try_divide(F.col("same"), F.col("n")))
