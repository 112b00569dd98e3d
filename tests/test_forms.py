"""Readers, writers, text functions and rules on hand-worked cases."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import text
from seqloom.operators import rules
from seqloom.sinks import forms
from seqloom.sources import binary


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_wav_round_trip(spark, bits):
    x = [0.0, 0.5, -0.5, 1.0, -1.0, 2.0]
    df = spark.createDataFrame([("a", x, 8000, 2), ("b", None, 8000, 1), ("c", [], 8000, 1)], "path string, samples array<double>, rate int, channels int")
    made = forms.wav(df, "path", bits=bits)
    got = {r.path: r for r in binary.read_wav(made).collect()}
    assert got["a"].rate == 8000 and got["a"].channels == 2 and np.allclose(got["a"].samples, np.clip(x, -1, 1), atol=2.0 ** (2 - bits))
    assert got["b"].samples is None and got["c"].samples == []
    mono = {r.path: r for r in binary.read_wav(made, mono=True).collect()}
    assert np.allclose(mono["a"].samples, [0.25, 0.25, 0.0], atol=2.0 ** (2 - bits))


def test_wav_with_other_chunks_and_bad_files():
    body = forms.wav_bytes(np.array([0.25]), 44100)
    odd = body[:12] + b"LIST" + struct.pack("<I", 3) + b"abc\0" + body[12:]
    assert binary.wav_samples(odd)[2] == pytest.approx([0.25], abs=1e-4)
    assert binary.wav_samples(b"") is None and binary.wav_samples(b"RIFF0000WAVEfmt ") is None
    eight = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 38, b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", 2) + bytes([0, 192])
    assert list(binary.wav_samples(eight)[2]) == [-1.0, 0.5]


def midi(track):
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, 480) + b"MTrk" + struct.pack(">I", len(track)) + track


def test_midi(spark):
    track = bytes([0, 0xFF, 0x51, 3, 7, 0xA1, 0x20, 0, 0xFF, 5, 1, 97, 0, 0x90, 60, 100, 0x60, 62, 90, 0x83, 0x60, 60, 0, 0, 0x80, 62, 0, 0, 0xE0, 0, 0x50, 0, 0xB0, 1, 64, 0, 0xFF, 0x2F, 0])
    df = spark.createDataFrame([("m", bytearray(midi(track))), ("bad", bytearray(b"xx")), ("none", None)], "path string, content binary")
    events = binary.read_midi(df)
    got = [(r.tick, r.kind, r.a, r.b, r.text) for r in events.orderBy("ord").collect()]
    assert got == [(0, "tempo", 500000, 0, None), (0, "lyric", 0, 0, "a"), (0, "on", 60, 100, None), (96, "on", 62, 90, None), (576, "off", 60, 0, None), (576, "off", 62, 0, None), (576, "bend", 2048, 0, None), (576, "control", 1, 64, None)]
    assert sorted((r.note, r.start, r.stop) for r in binary.notes(events).collect()) == [(60, 0, 576), (62, 96, 576)]


def test_notes_pair_with_the_latest_open_one(spark):
    kinds = [(0, "off"), (1, "on"), (2, "on"), (3, "off"), (4, "off"), (5, "off"), (6, "on"), (7, "off"), (8, "on")]
    rows = [("p", 0, i, t, k, 60, 1) for i, (t, k) in enumerate(kinds)]
    events = spark.createDataFrame(rows, "path string, track int, ord int, tick long, kind string, a int, b int")
    assert sorted((r.start, r.stop or -1) for r in binary.notes(events).collect()) == [(1, 4), (2, 3), (6, 7), (8, -1)]


def test_encodings(spark):
    cases = {"68656C6C6F": ("ASCII", "hello"), "EFBBBF68656C6C6F": ("UTF-8-BOM", "hello"), "82A082A2": ("Shift-JIS", "あい"), "E38182": ("UTF-8", "あ"), "": ("UNKNOWN", "")}
    df = spark.createDataFrame([(k, bytearray.fromhex(k)) for k in cases] + [("null", None)], "k string, c binary")
    got = {r.k: (r.e, r.t) for r in df.select("k", text.encoding(F.col("c")).alias("e"), text.decoded(F.col("c")).alias("t")).collect()}
    assert got == {**cases, "null": (None, None)}


def test_text_functions(spark):
    df = spark.createDataFrame([(" a \t ka\r\n", "1.2.3", "x\\y"), (None, "1.x", None), ("ka", "2", "")], "a string, v string, p string")
    got = df.select(text.alias(F.col("a")).alias("a"), text.version(F.col("v")).alias("v"), text.path(F.col("p")).alias("p"), text.vowel(F.lit("ka")).alias("w"), text.consonant(F.lit("ka")).alias("c")).collect()
    assert [r.a for r in got] == ["a ka", None, "ka"]
    assert [tuple(r.v) if r.v else None for r in got] == [(1, 2, 3), None, (2, 0, 0)]
    assert [r.p for r in got] == ["x/y", None, ""] and (got[0].w, got[0].c) == ("a", "k")
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (3 << 30,)], "n long").select(text.file_size(F.col("n")).alias("s")).collect()
    assert [r.s for r in sizes] == ["0 B", "1023 B", "1.5 KB", "3.0 GB"]


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None), (4, float("nan"))], "id int, x double")
    got = rules.issues(df, ["id"], {"finite": ("critical", rules.finite(F.col("x"))), "positive": ("warning", F.col("x") > 0)})
    assert sorted((r.id, r.rule) for r in got.collect()) == [(2, "positive"), (3, "finite"), (3, "positive"), (4, "finite")]
    assert rules.issues(df.where("false"), ["id"], {"p": ("info", F.lit(False))}).count() == 0


def test_lines_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("f1", 2, "b"), ("f1", 1, "a"), ("f2", 1, "c")], "file string, i int, label string")
    forms.write_lines(df, str(tmp_path / "out"), "file", ["i"], forms.label_line(F.col("i"), F.col("i") + 1, F.col("label")))
    assert [r.value for r in spark.read.text(str(tmp_path / "out/file=f1")).collect()] == ["10000 20000 a", "20000 30000 b"]
    assert [r.value for r in forms.report(spark.createDataFrame([("a|b",)], "x string"), "t", "markdown").collect()] == ["| t | a\\|b |"]
    assert [r.value for r in forms.report(spark.createDataFrame([("<a>",)], "x string"), "t", "html").collect()] == ["<tr><th>t</th><td>&lt;a&gt;</td></tr>"]
    assert [r.json for r in forms.json_rows(spark.createDataFrame([(1, 2, None)], "k int, a int, b int"), ["k"]).collect()] == ['{"a":2}']
