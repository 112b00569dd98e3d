"""Streams: failing functions, redelivery, restarts, and independence of how rows come in."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.streaming import frames, normaliser, phonemes, places

FRAME = "id long, x double"


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def shaky():
    """A function that travels to tasks by value: it fails on 13 and nulls, and has infinite or missing samples for 7 and 9."""

    def run(batch):
        x = batch.column("x").to_numpy(zero_copy_only=False)
        if np.isnan(x).any() or (x == 13).any():
            raise RuntimeError("thirteen")
        out = x[:, None] * np.arange(1, 4)
        out[x == 7, 1] = np.inf
        return out[:, :2] if len(x) == 1 and x[0] == 9 else out

    return run


@pytest.mark.parametrize("parts", [1, 3])
def test_failing_frames_are_silent_alone(spark, parts):
    df = spark.createDataFrame([*((i, float(i)) for i in range(40)), (99, None)], FRAME).repartition(parts)
    got = {r.id: r for r in frames.mapped(df, shaky(), 3).collect()}
    assert len(got) == 41 and all(r.cost_ms > 0 for r in got.values())
    assert got[13].samples == [0, 0, 0] and got[13].error == "RuntimeError: thirteen" and got[99].error == "RuntimeError: thirteen"
    assert got[7].samples == [0, 0, 0] and "not finite" in got[7].error
    assert all(r.samples == [i, 2 * i, 3 * i] and r.error is None for i, r in got.items() if i not in (7, 13, 99))
    assert frames.mapped(df.limit(0), shaky(), 3).count() == 0


def test_wrong_number_of_samples(spark):
    df = spark.createDataFrame([(1, 9.0)], FRAME)
    assert "for 1 frames of 3 samples" in frames.mapped(df, shaky(), 3).first().error


def test_session_runs_stops_and_goes_on(spark):
    path = places.feed(spark.createDataFrame([(i, float(i)) for i in range(30)], FRAME), "id", 3)
    out = places.folder(spark, "session")
    bad = frames.Session(frames.mapped(source(spark, path, FRAME), shaky(), 3), out, stop_on_error=True).start()
    with pytest.raises(Exception, match="batch 0"):
        bad.flush()
    assert not bad.active
    mend = lambda batch: batch.column("x").to_numpy()[:, None] * np.arange(1, 4)
    good = frames.Session(frames.mapped(source(spark, path, FRAME), mend, 3), out, stop_on_error=True)
    good.start().flush()
    good.start().flush()  # nothing new
    rows = good.output().collect()
    assert sorted(r.id for r in rows) == list(range(30)) and not any(r.error for r in rows)
    assert sorted((r.batch, r.frames, r.failed) for r in good.stats().collect()) == [(0, 10, 0), (1, 10, 0), (2, 10, 0)]
    total = frames.latency(good.stats()).first()
    assert total.frames == 30 and total.failed == 0 and 0 < total.mean_ms <= total.peak_ms
    good.stop()


NOTE = "key string, id long, time long, kind string, start long, end long, number int, value double"


def plain_buffer(rows, lookahead=100, grace=1000, capacity=3):
    """The buffer of each key, moved from event to event."""
    out = []
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[2], r[1])), key=lambda r: r[0]):
        waiting, levels = [], {}

        def release(until):
            for w in [w for w in waiting if w[0] <= until]:
                waiting.remove(w)
                out.append((key, w[1], "played", w[0], w[2]))

        for _, i, at, kind, start, end, number, value in group:
            release(at)
            if kind == "control":
                levels[number] = value
            elif kind == "note" and end < at - grace:
                out.append((key, i, "late", at, tuple(sorted(levels.items()))))
            elif kind == "note":
                waiting.append((max(at, start - lookahead), i, tuple(sorted(levels.items()))))
                release(at)
                if len(waiting) > capacity:
                    w = waiting.pop(0)
                    out.append((key, w[1], "evicted", at, w[2]))
        release(10**9)
    return sorted(out)


def notes(seed, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        at = 5000 + i * 20
        start = at + rng.randrange(-2500, 1500)
        control = rng.random() < 0.3
        rows.append((rng.choice("ab"), i, at, "control" if control else "note", start, start + rng.randrange(400), rng.choice([1, 7]), rng.random()))
    return rows


def played(spark, path, out, delay):
    with phonemes.store(spark):
        x = phonemes.buffered(source(spark, path, NOTE), delay, capacity=3)
        x.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.key, r.id, r.status, r.at, tuple((c.number, c.value) for c in r.controls)) for r in spark.read.parquet(out).collect())


CLOCK = ("z", -1, 10**6, "clock", None, None, None, None)


@pytest.mark.parametrize("parts", [1, 4])
def test_buffer_equals_plain_moves(spark, parts):
    rows = notes(5)
    want = plain_buffer(rows)
    assert {s for _, _, s, _, _ in want} == {"played", "late", "evicted"}
    path = places.feed(spark.createDataFrame([*rows, CLOCK], NOTE), "id", parts)
    if parts > 1:  # by id the clock would come first
        path = places.feed(spark.createDataFrame(rows, NOTE), "time", parts)
        spark.createDataFrame([CLOCK], NOTE).coalesce(1).write.mode("append").parquet(path)
    assert played(spark, path, places.folder(spark, "out"), "0 seconds") == want


def test_buffer_restarts_and_takes_rows_out_of_order(spark):
    rows = notes(8)
    late = [r for i, r in enumerate(rows) if i % 10 == 3]  # these come one file later than they should
    path, out = places.folder(spark, "in"), places.folder(spark, "out")
    for i in range(4):
        now = [r for k, r in enumerate(rows) if k // 30 == i and r not in late] + [r for k, r in enumerate(rows) if (k + 9) // 30 == i and r in late]
        more = [CLOCK] if i == 3 else []
        held = [r for k, r in enumerate(rows) if r in late and (k + 9) // 30 > 3] if i == 3 else []
        spark.createDataFrame([*now, *held, *more], NOTE).coalesce(1).write.mode("append").parquet(path)
        got = played(spark, path, out, "1 second")  # each call is a restart from the checkpoint
    assert got == plain_buffer(rows)


def test_normaliser_does_not_depend_on_batches(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), 1e6 + rng.gauss(0, 1) if rng.random() > 0.1 else None) for _ in range(400)] + [("empty", None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, x double")
    want = {r.k: r for r in df.groupBy("k").agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v")).collect()}
    for step in (401, 60, 7 * 25):
        kept = normaliser.Normaliser(spark, places.folder(spark, "n"), ["k"], "x")
        with pytest.raises(ValueError, match="no batch"):
            kept.totals()
        for b in range(0, 401, step):
            part = df.where(F.col("i").between(b, b + step - 1))
            kept.update(b, part)
            if b % 2 == 0:
                kept.update(b, part)
            if b == step:
                kept.compact()
                kept.update(0, df.where(F.col("i") < step))  # delivered again after it was merged
        got = {r.k: r for r in kept.totals().collect()}
        assert got.keys() == want.keys() and got["empty"].n == 0 and got["empty"]["mean"] is None
        for k, r in got.items():
            assert r.n == want[k].n and (r.n == 0 or np.isclose(r["mean"], want[k].m, rtol=1e-12) and np.isclose(r.variance, want[k].v, rtol=1e-8))
    z = kept.scaled(df.where("k = 'a'")).agg(F.avg("scaled").alias("m"), F.var_pop("scaled").alias("v")).first()
    assert abs(z.m) < 1e-6 and abs(z.v - 1) < 1e-6


def test_spans_of_several_files_come_one_at_a_time(spark):
    """The second span has a row alone, so files of it stay empty; batches keep to their spans."""
    df = spark.createDataFrame([*((i, float(i % 7)) for i in range(200)), (500, 1.0), *((i, 2.0) for i in range(800, 1001))], FRAME).repartition(5)
    path = places.feed(df, "id", 3, files=4)
    assert len(spark.read.parquet(path).inputFiles()) == 12
    got = {}

    def keep(batch, number):
        got[number] = sorted(r.id for r in batch.collect())

    stream = spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 4).parquet(path)
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", places.folder(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert [got[n] for n in sorted(got)] == [[*range(200)], [500], [*range(800, 1001)]]
    assert places.files_for(df, 3) == 1
