import struct

from pyspark.sql import functions as F

from seqloom.functions import signal
from seqloom.sources import text_entries as src
from seqloom.streaming import telemetry

TEXT = """# a bank of our own
mo1.wav=mo,12.5,33.0,8.0,21.0,4.0
ne2.wav=ne,40.0,55.5,9.0,30.0,6.0

one3.wav=o ne,75.0,20.0,14.0,60.0,18.0
no separator here
hush.wav=,0,0,0,0,0
few.wav=few,1,2"""


def lines(spark):
    return spark.createDataFrame([("b", i, x) for i, x in enumerate(TEXT.split("\n"), 1)], "bank string, line_no int, line string")


def test_entries(spark):
    good, bad = src.entries(lines(spark), ["bank"], "line_no", "line")
    assert [(r.line_no, r.alias, r.offset) for r in good.orderBy("line_no").collect()] == [(2, "mo", 12.5), (3, "ne", 40.0), (5, "o ne", 75.0), (7, "", 0.0)]
    assert [(r.line_no, r.message) for r in bad.orderBy("line_no").collect()] == [(6, "Missing '=' separator"), (8, "Too few values")]


def test_strict_stops(spark):
    good, bad = src.entries(lines(spark), ["bank"], "line_no", "line", strict=True)
    assert good.count() == 3 and bad.count() == 1


def test_labels(spark):
    df = spark.createDataFrame([("u", 0, "0 1500000 sil-ka+sa x"), ("u", 1, "# c"), ("u", 2, "only label"), ("u", 3, "")], "utt string, n int, line string")
    assert [tuple(r)[2:] for r in src.labels(df, ["utt"], "n", "line").orderBy("n").collect()] == [(0, 1500000, "sil-ka+sa x"), (None, None, "only label")]


def test_wav_header(spark):
    head = b"RIFF" + struct.pack("<I", 36 + 88200) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 44100, 88200, 2, 16) + b"data" + struct.pack("<I", 88200)
    got = src.wav_header(spark.createDataFrame([(bytearray(head),), (bytearray(b"x"),)], "content binary")).select("rate", "channels", "bits", "duration_ms").collect()
    assert sorted(map(tuple, got)) == [(44100, 1, 16, 1000.0), (44100, 1, 16, 1000.0)]


def test_flags(spark):
    df = spark.createDataFrame([("g+20bre50Mt-5xx3",), ("",)], "f string").select(signal.flags("f").alias("m"))
    assert [r.m for r in df.collect()] == [{"g": 20, "bre": 50, "mt": -5, "xx": 3}, {}]


def test_array_functions(spark):
    df = spark.createDataFrame([([0.0, 100.0, 1000.0],)], "a array<double>")
    r = df.select(signal.pitch_shift("a", 12).alias("p"), signal.peak_normalised("a").alias("n"), signal.resample("a", 2.0).alias("r")).first()
    assert r.p == [0.0, 200.0, 1000.0] and r.n == [0.0, 0.1, 1.0] and r.r == [0.0, 50.0, 100.0, 550.0, 1000.0, 1000.0]


def test_alerts(spark):
    df = spark.createDataFrame([(60.0, 10.0, 0.5, 0, 1)], "latency double, cpu double, util double, underruns int, overflows int").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    assert sorted(r.alert for r in telemetry.alerts(telemetry.windows(df)).collect()) == ["latency", "overflow"]


def test_bounded_stream(spark, tmp_path):
    spark.createDataFrame([("s", i) for i in range(5)], "stream string, seq long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("stream string, seq long").parquet(str(tmp_path / "in"))
    q = telemetry.bounded(stream, "stream", "seq", 3).writeStream.format("memory").queryName("kept").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("kept").first()) == ("s", [2, 3, 4], 2)


def test_entry_without_training_operators():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
