"""Queries that run a stream: a bounded one, fed from the tables, whose result equals what SQL says of the same rows at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from seqloom.plans.catalogue import EV, ev, query
from seqloom.streaming import frames, normaliser, phonemes, places

SAMPLES = 8


def _stream(spark, df, time, parts=3):
    """df as a stream of one span of its time at a time."""
    files = places.files_for(df, parts)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(places.feed(df, time, parts, files=files))


def ramp(batch: pa.RecordBatch) -> np.ndarray:
    """A frame's value, rising over its samples; frames of the type ``error`` fail."""
    if "error" in batch.column("event_type").to_pylist():
        raise ValueError("no sound for an error")
    return batch.column("value").to_numpy(zero_copy_only=False)[:, None] * (np.arange(SAMPLES) + 1) / SAMPLES


@query("str06_stream_frames", f"""WITH i AS (SELECT unnest(range(0, {SAMPLES})) AS i) SELECT event_id, CAST(i AS INT) AS i, round(CASE WHEN event_type = 'error' THEN 0 ELSE value * (i + 1) / {SAMPLES} END, 6) AS sample,
CASE WHEN event_type = 'error' THEN 'ValueError: no sound for an error' END AS error FROM events, i""")
def _(spark, sf):
    stream = _stream(spark, ev(spark, sf).select("event_id", "t", "event_type", "value"), "t")
    session = frames.Session(frames.mapped(stream, ramp, SAMPLES), places.folder(spark, "session"))
    out = session.start().flush().output()
    return out.select("event_id", "error", F.posexplode("samples").alias("i", "sample")).select("event_id", "i", F.round("sample", 6).alias("sample"), "error")


@query("str16_stream_report", """SELECT count(*) AS frames, count(*) FILTER (event_type = 'error') AS failed, true AS timed FROM events""")
def _(spark, sf):
    stream = _stream(spark, ev(spark, sf).select("event_id", "t", "event_type", "value"), "t")
    session = frames.Session(frames.mapped(stream, ramp, SAMPLES), places.folder(spark, "session"))
    session.start().flush()
    timed = (F.col("mean_ms") > 0) & (F.col("peak_ms") >= F.col("mean_ms")) & (F.col("frames_a_second") > 0)
    return frames.latency(session.stats()).select("frames", "failed", timed.alias("timed"))


#: Minutes play the part of milliseconds, so that notes of a user wait together; clicks and views are controls 7 and 1, the others notes.
_ROWS = "t // 60000000 AS m, t // 60000000 + (event_id * 7919) % 40000 - 5000 AS s, (event_id * 131) % 1500 AS d"


@query("str09_phoneme_buffer", f"""WITH {EV}, x AS (SELECT user_id, event_id, event_type, {_ROWS}, value FROM ev),
c AS (SELECT *, event_type NOT IN ('click', 'view') AS note, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w AS volume, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS modulation FROM x WINDOW w AS (PARTITION BY user_id ORDER BY m, event_id)),
n AS MATERIALIZED (SELECT *, greatest(m, s - {phonemes.LOOKAHEAD_MS}) AS r, row_number() OVER (PARTITION BY user_id ORDER BY m, event_id) AS k FROM c WHERE note AND s + d >= m - {phonemes.GRACE_MS}),
p AS (SELECT i.user_id, i.event_id, j.m, count(*) AS newer FROM n i JOIN n j ON j.user_id = i.user_id AND j.k > i.k AND j.m < i.r JOIN n l ON l.user_id = i.user_id AND l.k > i.k AND l.k <= j.k AND l.r > j.m GROUP BY i.user_id, i.event_id, j.event_id, j.m),
e AS (SELECT event_id, min(m) AS out FROM p WHERE newer >= {phonemes.CAPACITY} GROUP BY 1)
SELECT user_id, event_id, CASE WHEN e.out IS NULL THEN 'played' ELSE 'evicted' END AS status, coalesce(e.out, r) AS "at", volume, modulation FROM n LEFT JOIN e USING (event_id)
UNION ALL SELECT user_id, event_id, 'late', m, volume, modulation FROM c WHERE note AND s + d < m - {phonemes.GRACE_MS}""")
def _(spark, sf):
    at, control = F.floor(F.col("t") / 60_000_000), F.col("event_type").isin("click", "view")
    start = at + (F.col("event_id") * 7919) % 40000 - 5000
    rows = ev(spark, sf).select(
        F.col("user_id").alias("key"), F.col("event_id").alias("id"), at.alias("time"), F.when(control, "control").otherwise("note").alias("kind"), start.alias("start"),
        (start + (F.col("event_id") * 131) % 1500).alias("end"), F.when(F.col("event_type") == "click", 7).otherwise(1).alias("number"), "value",
    )
    # a last row far ahead lets the watermark pass all others
    clock = rows.agg((F.coalesce(F.max("time"), F.lit(0)) + 100_000).alias("time")).select(F.lit(-1).cast("long").alias("key"), F.lit(-1).cast("long").alias("id"), "time", F.lit("clock").alias("kind"))
    fed = rows.unionByName(clock, allowMissingColumns=True)
    out = places.folder(spark, "buffer")
    with phonemes.store(spark):
        q = phonemes.buffered(_stream(spark, fed, "time")).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    level = lambda n: F.element_at(F.map_from_entries("controls"), F.lit(n))
    return spark.read.parquet(out).select(F.col("key").alias("user_id"), F.col("id").alias("event_id"), "status", "at", level(7).alias("volume"), level(1).alias("modulation"))


@query("ag27_stream_normaliser", """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(var_pop(value), 5) AS variance FROM events GROUP BY 1""")
def _(spark, sf):
    e = ev(spark, sf).select("event_type", "value", "t")
    kept = normaliser.Normaliser(spark, places.folder(spark, "normaliser"), ["event_type"], "value")
    kept.follow(_stream(spark, e, "t"), places.folder(spark, "checkpoint")).awaitTermination()
    # what came since a time is delivered once more as one batch, twice; then the same batch without rows takes it back
    middle = e.agg(F.avg("t").alias("_m"))
    for rows in (again := e.join(F.broadcast(middle), F.col("t") > F.col("_m")).drop("_m"), again, again.limit(0)):
        kept.update("late", rows)
    kept.compact()
    return kept.totals().select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("variance", 5).alias("variance"))
