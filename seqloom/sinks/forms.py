"""Forms in which tables leave: WAV bytes, label lines, entry lines, question sets, reports. Each gives a DataFrame to be written."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import text


def wav_bytes(samples: np.ndarray, rate: int, channels: int = 1, bits: int = 16) -> bytes:
    """A PCM file of samples from -1 to 1, clamped, scaled by 2^(bits-1) - 1; bits: 16, 24 or 32."""
    x = np.rint(np.clip(samples, -1, 1) * (2 ** (bits - 1) - 1)).astype("<i8")
    body = x.astype(f"<i{bits // 8}").tobytes() if bits != 24 else x.view(np.uint8).reshape(-1, 8)[:, :3].tobytes()
    step = channels * bits // 8
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, 1, channels, rate, rate * step, step, bits, b"data", len(body)) + body


def wav(df: DataFrame, key: str, samples: str = "samples", rate: str = "rate", channels: str = "channels", bits: int = 16) -> DataFrame:
    """(key, content binary) of each row's samples; null samples give a null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, r, c = (batch.column(j)[i].as_py() for j in (1, 2, 3))
                made = None if x is None else wav_bytes(np.array(x, np.float64), r, c, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([made], pa.binary())], names=[key, "content"])

    return df.select(key, samples, rate, channels).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, content binary")


def label_line(start_ms: Column, end_ms: Column, label: Column, mode: str = "ms") -> Column:
    return F.concat_ws(" ", text.label_time(start_ms, mode), text.label_time(end_ms, mode), label)


def entry_line(filename: Column, alias: Column, *values: Column) -> Column:
    """file=alias,offset,consonant,blank,preutterance,overlap."""
    return F.concat(filename, F.lit("="), F.concat_ws(",", alias, *(v.cast("double").cast("string") for v in values)))


def question_line(name: Column, pattern: Column) -> Column:
    return F.format_string('QS "%s" { %s }', name, pattern)


def write_lines(df: DataFrame, path: str, file: str, order: list[str], line: Column) -> None:
    """Text files under path/file=.../, one task for each group of files, lines in order."""
    x = df.withColumn("value", line)
    x.repartition(file).sortWithinPartitions(file, *order).select(file, "value").write.partitionBy(file).mode("overwrite").text(path)


def metric_rows(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value): one row for each metric."""
    return df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value")


def json_rows(df: DataFrame, keys: list[str], name: str = "json") -> DataFrame:
    """(keys, json) with the other columns as one object; nulls are left out."""
    return df.select(*keys, F.to_json(F.struct(*(c for c in df.columns if c not in keys))).alias(name))


def report(df: DataFrame, title: str, form: str) -> DataFrame:
    """(value): one line for each row in markdown or html, values escaped for the form."""
    cell = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    if form == "markdown":
        safe = [F.replace(F.replace(cell(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")) for c in df.columns]
        return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", F.lit(title), *safe), F.lit(" |")).alias("value"))
    safe = [F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(cell(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>")) for c in df.columns]
    return df.select(F.concat(F.lit("<tr><th>"), F.lit(title), F.lit("</th>"), *safe, F.lit("</tr>")).alias("value"))
