"""Readers of timed text: timing entries, label lines, WAV headers. All are columns over text or binaryFile sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMBER = "^\\\\s*[+-]?(\\\\d+\\\\.?\\\\d*|\\\\.\\\\d+)([eE][+-]?\\\\d+)?"
PARTS = ("offset", "consonant", "blank", "preutterance", "overlap")


def number(text: str) -> str:
    """SQL for the number that the text begins with, 0 if there is none."""
    return f"coalesce(try_cast(trim(regexp_extract({text}, '{NUMBER}', 0)) AS DOUBLE), 0D)"


def entries(lines: DataFrame, keys: list[str], ordinal: str, line: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Timing entries ``file=alias,offset,consonant,blank,preutterance,overlap`` and the rejected lines with messages.

    Blank lines and lines that begin with # count as neither; a trailing empty token is no token; strict stops at the first bad line."""
    x = lines.withColumn("_l", F.trim(F.regexp_replace(line, "\r", ""))).where("_l <> '' AND NOT startswith(_l, '#')")
    x = x.withColumn("_eq", F.instr("_l", "=")).withColumn("_t", F.split(F.expr("substring(_l, _eq + 1)"), ","))
    x = x.withColumn("_n", F.expr("size(_t) - CASE WHEN _t[size(_t) - 1] = '' THEN 1 ELSE 0 END"))
    why = F.when(F.col("_eq") == 0, "Missing '=' separator").when(F.col("_n") < 6, "Too few values")
    x = x.withColumn("message", why)
    if strict:
        x = x.withColumn("_bad", F.sum(F.col("message").isNotNull().cast("int")).over(Window.partitionBy(*keys).orderBy(ordinal))).where("_bad = 0 OR (_bad = 1 AND message IS NOT NULL)")
    good = x.where("message IS NULL").select(*keys, ordinal, F.expr("trim(substring(_l, 1, _eq - 1))").alias("filename"), F.expr("trim(_t[0])").alias("alias"), *(F.expr(number(f"_t[{i}]")).alias(p) for i, p in enumerate(PARTS, 1)))
    return good, x.where("message IS NOT NULL").select(*keys, ordinal, "message")


def labels(lines: DataFrame, keys: list[str], ordinal: str, line: str) -> DataFrame:
    """``start end label`` lines, or labels alone; blank lines and comments are left out."""
    x = lines.withColumn("_l", F.trim(line)).where("_l <> '' AND NOT startswith(_l, '#')").withColumn("_t", F.split("_l", "\\s+"))
    timed = "size(_t) >= 3 AND try_cast(_t[0] AS BIGINT) IS NOT NULL AND try_cast(_t[1] AS BIGINT) IS NOT NULL"
    return x.select(*keys, ordinal, F.expr(f"CASE WHEN {timed} THEN try_cast(_t[0] AS BIGINT) END").alias("start"), F.expr(f"CASE WHEN {timed} THEN try_cast(_t[1] AS BIGINT) END").alias("end"), F.expr(f"CASE WHEN {timed} THEN array_join(slice(_t, 3, size(_t)), ' ') ELSE _l END").alias("label"))


def little_endian(content: Column, at: int, size: int) -> Column:
    """An unsigned integer of ``size`` bytes at a byte offset."""
    parts = [F.hex(F.substring(content, at + i + 1, 1)) for i in reversed(range(size))]
    return F.conv(F.concat(*parts), 16, 10).cast("long")


def wav_header(files: DataFrame, content: str = "content") -> DataFrame:
    """Rate, channels, bits and duration of fixed 44-byte headers; other files get 44100, 16, 1 and 1000 ms."""
    c = F.col(content)
    wav = (F.substring(c, 1, 4) == F.lit(b"RIFF")) & (F.substring(c, 9, 4) == F.lit(b"WAVE")) & (F.length(c) >= 44)
    rate, channels, bits, data = little_endian(c, 24, 4), little_endian(c, 22, 2), little_endian(c, 34, 2), little_endian(c, 40, 4)
    per_second = rate * channels * (bits / 8)
    return files.withColumns({
        "rate": F.when(wav, rate).otherwise(44100), "channels": F.when(wav, channels).otherwise(1), "bits": F.when(wav, bits).otherwise(16),
        "duration_ms": F.when(wav & (per_second > 0), data / per_second * 1000.0).when(wav, 0.0).otherwise(1000.0),
    })


def label_format(first_line: Column) -> Column:
    """The form of a label file by its first line."""
    return F.when(F.contains(first_line, F.lit("/A:")), "hts").when(F.contains(first_line, F.lit("ms")), "utau").otherwise("extended")
