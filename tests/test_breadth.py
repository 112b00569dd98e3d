"""Operators that no query over the tables reaches: files of banks, odd rows, driver utilities."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import scalars
from seqloom.operators import augment, banks, reports, spectra
from seqloom.operators import sequence as seq
from seqloom.operators import temporal
from seqloom.operators import timing as tm
from seqloom.plans import fields  # noqa: F401  fills the catalogue
from seqloom.plans.catalogue import QUERIES


def test_banks_of_files(spark, tmp_path):
    def put(where, name, data):
        folder = tmp_path / where
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)

    put("one", "oto.ini", "ka.wav=か,1,2,3,4,5\r\n# note\r\n\r\nki.wav=き,1,2,3,4,5\nki.wav=か,0,0,0,0,0\nbroken".encode("shift_jis"))
    put("one", "ka.wav", b"RIFF")
    put("one", "lost.WAV", b"RIFF")
    put("two/deep", "a.flac", b"x")
    put("backup", "oto.ini", b"# none")
    put("backup", "a.wav", b"x")
    files = banks.listing(spark, str(tmp_path))
    names = lambda df: sorted(r.folder.rsplit("/", 1)[1] for r in df.collect())
    assert names(banks.discovered(files)) == ["one"] and names(banks.folders(files)) == ["backup", "deep", "one"]
    good, bad = banks.read_entries(spark, str(tmp_path))
    assert sorted(r.alias for r in good.collect()) == ["か", "か", "き"] and [r.message for r in bad.collect()] == ["Missing '=' separator"]
    got = {r.folder.rsplit("/", 1)[1]: r for r in banks.validation(files, good).collect()}
    one = got["one"]
    assert (one.entries, one.duplicate_aliases, one.referenced, one.missing, one.orphaned, one.is_valid) == (3, 1, 2, 1, 1, False)
    assert one.suggestions == ["samples that are listed but absent: 1", "aliases given more than once: 1"] and got["deep"].suggestions[0].startswith("no timing file")
    assert got["deep"].orphaned == 1 and got["backup"].orphaned == 1 and got["backup"].entries == 0
    assert tuple(banks.summary(banks.validation(files, good)).first()) == (1, 2, 0)
    assert sorted({r.issue for r in banks.structure_issues(banks.folders(files)).collect()}) == ["missing character.txt", "missing oto.ini"]


def test_odd_rows_of_timing(spark):
    x = spark.createDataFrame([(1, None, 1.0, 60.0, 100.0, 50.0), (1, "a ka", None, 60.0, 100.0, 50.0), (1, " a\tk  a ", 60.0, 40.0, 100.0, 50.0), (2, "", 0.0, 0.0, 0.0, 0.0)], "k int, alias string, offset double, consonant double, blank double, preutterance double")
    found = tm.segments(x)
    assert [r.alias for r in found.where("accepted").collect()] == [" a\tk  a "]
    got = {r.k: r for r in tm.recognition(found, ["k"]).collect()}
    assert got[1].segments == 1 and got[2].confidence == 0 and got[2].errors == 1
    assert tm.sequence_text(found, ["k"], ["offset"]).collect()[0].phonemes == "a ka"
    assert tm.recognition(found.limit(0), ["k"]).count() == 0


def test_transforms_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 3.0, 4.0]), (2, None), (3, []), (4, [5.0, 6.0]), (5, [0.0, 1.0, 0.0, -1.0])]
    df = spark.createDataFrame(rows, "k int, x array<double>")
    got = {r.k: r for r in spectra.forward(df, "k", "x").collect()}
    assert got[2].re is None and got[3].im is None and np.allclose(np.array(got[1].re) + 1j * np.array(got[1].im), np.fft.rfft([1, 2, 3, 4]))
    back = {r.k: r["values"] for r in spectra.inverse(spectra.forward(df, "k", "x"), "k").collect()}
    assert np.allclose(back[5], rows[4][1]) and back[2] is None
    figures = spectra.window_figures(spark.createDataFrame([(1, [1.0] * 64)], "k int, x array<double>"), "k", "x").first()["figures"]
    assert np.allclose(figures[:2], 1) and abs(figures[2] + 13.2) < 0.2 and abs(figures[3] - 2) < 0.1


def test_augmented_rows_repeat(spark):
    df = spark.createDataFrame([(1, [100.0, 0.0, 200.0, 300.0]), (2, None), (None, [])], "k long, x array<double>")
    a, b = (sorted(map(str, augment.augmented(df.repartition(n), "k", "x").collect())) for n in (1, 3))
    assert a == b and len(a) == 15


def test_medians_and_utilities(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 1.0), ("b", 1.0), ("c", None), ("d", 2.0), ("d", 2.0)], "k string, v double")
    got = {r.k: r for r in reports.benchmark(df, ["k"], "v").collect()}
    assert [got[k].median for k in "abcd"] == [2.0, 1.0, None, 2.0] and got["c"].n == 0 and got["d"].score == 1
    assert reports.balanced({"a": 5, "b": 3, "c": 3, "d": 1}, 2) == [["a", "d"], ["b", "c"]]
    x = spark.createDataFrame([(b"abc",), (None,), (b"",)], "b binary")
    assert [r[0] and bytes(r[0]) for r in x.select(scalars.inflated(scalars.deflated("b"))).collect()] == [b"abc", None, b""]
    assert x.select(scalars.inflated("b")).collect()[0][0] is None
    e = spark.createDataFrame([([1.0, 2.0, 3.0],), (None,), ([1.0, 5.0, 1.0, 1.0],)], "v array<double>")
    assert [r[0] and [round(v, 6) for v in r[0]] for r in e.select(scalars.anti_aliased(F.col("v"))).collect()] == [[1.0, 2.0, 3.0], None, [1.0, 3.4, 1.48, 1.0]]
    sides = spark.createDataFrame([(1, 0, "x"), (1, 1, None)], "k int, i int, a string"), spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "k int, i int, b string")
    assert {(r.k, r.n, r.same) for r in seq.compared(*sides, ["k"], "i", "a", "b").collect()} == {(1, 1, 1), (2, 1, 0)}


@pytest.mark.parametrize("value", [0.0, -1.0, None])
def test_pitch_of_no_sound(spark, value):
    df = spark.createDataFrame([(value,)], "hz double")
    note, cents, sound = df.select(scalars.note(F.col("hz")), scalars.cents(F.col("hz")), scalars.voiced(F.col("hz"))).first()
    assert cents is None and not sound and note == (None if value is None else 0)


def events(spark, path, rows):
    """A folder with the table of events of (event_id, user_id, event_type, value), in this order."""
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    df.coalesce(1).selectExpr("event_id", "timestamp_micros(event_id) AS ts", "user_id", "event_type", "value").write.parquet(f"{path}/events.parquet")
    return str(path)


def test_arg_max_takes_the_first_of_equals(spark, tmp_path):
    sf = events(spark, tmp_path, [(1, 1, "a", 2.0), (3, 1, "a", 7.0), (5, 1, "a", 7.0), (9, 1, "a", 7.0), (11, 1, "a", None), (2, 2, "a", None)])
    assert sorted(map(tuple, QUERIES["srt05_arg_max"](spark, sf).collect())) == [(1, 3, 7.0), (2, None, None)]


@pytest.mark.parametrize("order", [(2.63, 5.52, 6.85), (6.85, 5.52, 2.63)])
def test_wins_do_not_depend_on_the_order_of_rows(spark, tmp_path, order):
    """The mean of the clicks is five, which is no tie; added one after another they come to less."""
    sf = events(spark, tmp_path, [(0, 1, "view", 0.0), *((i, 1, "click", v) for i, v in enumerate(order, 1)), (8, 2, "view", 1e300), (9, 2, "click", None), (10, 3, "view", 1e300), (11, 3, "click", 1.0)])
    assert sorted(map(tuple, QUERIES["ag50_wins"](spark, sf).collect())) == [("a", 1, 50.0), ("b", 1, 50.0)]


def test_pairs_of_one_key_are_dealt_out(spark):
    x = spark.createDataFrame([*((i, 1) for i in range(300)), (900, 2), (901, None)], "a long, k int")
    y = spark.createDataFrame([*((i, 1) for i in range(200)), *((i, 2) for i in range(3)), (7, None), (8, 5)], "b long, j int")
    got = temporal.paired(x, y, "k", "j", at_once=2000).select("a", "b")
    assert got.distinct().count() == got.count() == 300 * 200 + 3
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 12_000  # of one task; all of a key's before
    assert temporal.paired(x.limit(0), y, "k", "j").isEmpty()


def test_control_limits_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    times = [None, None, *map(int, rng.integers(-300, 300, 120))]
    rows = [(i, [None, "a", "b"][i % 3], t, None if i % 7 == 0 else float(round(v, 2))) for i, (t, v) in enumerate(zip(times, rng.normal(50, 20, len(times)), strict=True))]
    schema = "i long, k string, t long, v double"

    def check(rows):
        got = seq.control_limits(spark.createDataFrame(rows, schema).repartition(3), ["k"], "t", "v", 100).collect()
        assert len(got) == len(rows)
        for r in got:
            near = [v for _, k, t, v in rows if k == r.k and v is not None and (t is None if r.t is None else t is not None and r.t - 100 <= t <= r.t)]
            assert r.mean_before is None if not near else np.isclose(r.mean_before, np.mean(near)), r
            group = [v for _, k, _, v in rows if k == r.k and v is not None]
            assert r.out is None if r.v is None else r.out == (abs(r.v - np.mean(group)) > 3 * np.std(group, ddof=1))

    check(rows)
    check([*rows, (999, "b", 5, 1e200)])


def test_control_limits_do_not_add_up_a_span_for_each_row(spark):
    x = spark.range(150_000).selectExpr("1 AS k", "id AS t", "CAST(id % 10 AS DOUBLE) AS v")
    began = time.time()
    assert seq.control_limits(x, ["k"], "t", "v", 200_000).agg(F.sum("mean_before")).first()[0] > 0
    assert time.time() - began < 20
