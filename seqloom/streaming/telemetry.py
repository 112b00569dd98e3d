"""Structured Streaming forms: telemetry windows with alerts, late-data bounds, and a bounded buffer that drops its oldest rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = {"cpu": "max_cpu > 80", "latency": "max_latency > 50", "utilisation": "max_util > 0.9", "underrun": "underruns > 0", "overflow": "overflows > 0"}


def windows(frames: DataFrame, time: str = "ts", size: str = "1 second", late: str = "1 second") -> DataFrame:
    """Telemetry by tumbling window; rows later than ``late`` behind the newest are dropped by the watermark. Works on batch frames too."""
    x = frames.withWatermark(time, late) if frames.isStreaming else frames
    return x.groupBy(F.window(time, size).alias("w")).agg(
        F.count("*").alias("n"), F.avg("latency").alias("mean_latency"), F.max("latency").alias("max_latency"), F.max("cpu").alias("max_cpu"),
        F.max("util").alias("max_util"), F.sum("underruns").alias("underruns"), F.sum("overflows").alias("overflows"),
    ).select(F.col("w.start").alias("start"), "n", "mean_latency", "max_latency", "max_cpu", "max_util", "underruns", "overflows")


def alerts(stats: DataFrame) -> DataFrame:
    """One row for each rule that a window breaks."""
    found = F.array(*(F.when(F.expr(rule), F.lit(name)) for name, rule in RULES.items()))
    return stats.withColumn("alert", F.explode(F.filter(found, lambda x: x.isNotNull())))


def bounded(frames: DataFrame, key: str, seq: str, capacity: int) -> DataFrame:
    """After each batch, for each stream the newest ``capacity`` sequence numbers and how many were pushed out, oldest first."""

    def push(group: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept, lost = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for part in parts:
            kept += part[seq].tolist()
            kept.sort()
            lost += max(0, len(kept) - capacity)
            kept = kept[-capacity:]
        state.update((kept, lost))
        yield pd.DataFrame({key: [group[0]], "kept": [kept], "overflows": [lost]})

    kind = dict(frames.dtypes)[key]
    return frames.groupBy(key).applyInPandasWithState(push, f"{key} {kind}, kept array<bigint>, overflows bigint", "kept array<bigint>, overflows bigint", "update", "NoTimeout")
