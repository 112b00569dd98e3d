"""Binary readers over ``binaryFile`` rows: WAV samples and standard MIDI files. A file is one row and is read in one task."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PPQ = 480


def wav_chunks(data: bytes) -> dict[bytes, bytes]:
    """Chunks of a RIFF/WAVE file by name, the first of each; an empty dict for anything else."""
    found: dict[bytes, bytes] = {}
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return found
    at = 12
    while at + 8 <= len(data):
        size = struct.unpack_from("<I", data, at + 4)[0]
        found.setdefault(data[at : at + 4], data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def wav_samples(data: bytes) -> tuple[int, int, np.ndarray] | None:
    """(rate, channels, samples from -1 to 1, interleaved) of PCM with 8, 16, 24 or 32 bits; None for what can't be read."""
    chunk = wav_chunks(data)
    form, body = chunk.get(b"fmt ", b""), chunk.get(b"data")
    if len(form) < 16 or body is None:
        return None
    kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", form)
    if kind != 1 or channels not in (1, 2) or bits not in (8, 16, 24, 32):
        return None
    body = body[: len(body) // (bits // 8) * (bits // 8)]
    if bits == 8:
        x = (np.frombuffer(body, np.uint8).astype(np.float64) - 128) / 128
    elif bits == 24:
        raw = np.frombuffer(body, np.uint8).reshape(-1, 3).astype(np.int32)
        x = (((raw[:, 0] | raw[:, 1] << 8 | raw[:, 2] << 16) ^ 0x800000) - 0x800000) / 8388608
    else:
        x = np.frombuffer(body, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    return rate, channels, x


def read_wav(files: DataFrame, key: str = "path", content: str = "content", mono: bool = False) -> DataFrame:
    """(key, rate, channels, samples); files that can't be read give nulls. ``mono`` gives the mean of the channels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one file at a time bounds the memory
                raw = batch.column(1)[i].as_py()
                got = wav_samples(raw) if raw is not None else None
                if got and mono:
                    got = got[0], 1, got[2][: len(got[2]) // got[1] * got[1]].reshape(-1, got[1]).mean(axis=1)
                rate, channels, x = got or (None, None, None)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), pa.array([x], pa.list_(pa.float64()))], names=[key, "rate", "channels", "samples"])

    return files.select(key, content).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, rate int, channels int, samples array<double>")


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    while at < len(data):
        value = value << 7 | data[at] & 127
        at += 1
        if data[at - 1] < 128:
            break
    return value, at


def midi_events(data: bytes) -> tuple[int, list[tuple]]:
    """(ticks a quarter, events (track, ordinal, tick, kind, a, b, text)) of a standard MIDI file; kinds: on, off, control, bend, tempo (a: us
    a quarter), lyric. A track that ends early gives what it held; other files give nothing."""
    if data[:4] != b"MThd" or len(data) < 14:
        return PPQ, []
    size, _, _, division = struct.unpack_from(">IHHH", data, 4)
    out, at, track = [], 8 + size, 0
    while at + 8 <= len(data):
        name, length = data[at : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        body, at = data[at + 8 : at + 8 + length], at + 8 + length
        if name != b"MTrk":
            continue
        i, tick, status, n = 0, 0, 0, 0
        while i < len(body):
            delta, i = _varint(body, i)
            tick += delta
            if i >= len(body):
                break
            if body[i] >= 128:
                status, i = body[i], i + 1
            if status == 0xFF:
                kind, i = body[i] if i < len(body) else 0x2F, i + 1
                length, i = _varint(body, i)
                value, i = body[i : i + length], i + length
                if kind == 0x51 and len(value) == 3:
                    out.append((track, n, tick, "tempo", int.from_bytes(value), 0, None))
                elif kind == 5:
                    out.append((track, n, tick, "lyric", 0, 0, value.decode("utf-8", "replace")))
                elif kind == 0x2F:
                    break
            elif status in (0xF0, 0xF7):
                length, i = _varint(body, i)
                i += length
            elif status >= 0x80:
                wide = 1 if status & 0xF0 in (0xC0, 0xD0) else 2
                value, i = body[i : i + wide], i + wide
                if len(value) < wide:
                    break
                high = status & 0xF0
                if high == 0x90 and value[1]:
                    out.append((track, n, tick, "on", value[0], value[1], None))
                elif high in (0x80, 0x90):
                    out.append((track, n, tick, "off", value[0], value[1], None))
                elif high == 0xB0:
                    out.append((track, n, tick, "control", value[0], value[1], None))
                elif high == 0xE0:
                    out.append((track, n, tick, "bend", (value[1] << 7 | value[0]) - 8192, 0, None))
            else:
                break
            n += 1
        track += 1
    return division & 0x7FFF or PPQ, out


def read_midi(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """One row for each event of each file."""
    names = ["track", "ord", "tick", "kind", "a", "b", "text"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ppq, rows = midi_events(batch.column(1)[i].as_py() or b"")
                same = batch.column(0).take(pa.array([i] * len(rows), pa.int64()))
                yield pa.RecordBatch.from_arrays([same, pa.array([ppq] * len(rows), pa.int32()), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], names=[key, "ppq", *names])

    return files.select(key, content).mapInArrow(run, f"{key} {dict(files.dtypes)[key]}, ppq int, track int, ord int, tick long, kind string, a int, b int, text string")


def notes(events: DataFrame, key: str = "path") -> DataFrame:
    """(key, track, note, velocity, start, stop): an off closes the latest open on of its number; notes left open have a null stop.

    Opens and closes of one number are brackets: depth is a running sum, and an on is closed by the first off that returns to its depth."""
    w = Window.partitionBy(key, "track", "a").orderBy("tick", "ord")
    x = events.where("kind IN ('on', 'off')").withColumn("_d", F.when(F.col("kind") == "on", 1).otherwise(-1))
    x = x.withColumn("_s", F.sum("_d").over(w))
    # offs without an open note would sink the depth: lift it by the lowest point so far
    x = x.withColumn("_low", F.least(F.lit(0), F.min("_s").over(w))).withColumn("_level", F.col("_s") - F.col("_low") + F.when(F.col("kind") == "off", 1).otherwise(0))
    v = Window.partitionBy(key, "track", "a", "_level").orderBy("tick", "ord")
    x = x.withColumn("_next", F.lead("kind").over(v)).withColumn("_stop", F.lead("tick").over(v))
    return x.where("kind = 'on'").select(key, "track", F.col("a").alias("note"), F.col("b").alias("velocity"), F.col("tick").alias("start"), F.when(F.col("_next") == "off", F.col("_stop")).alias("stop"))
