"""Text functions: encodings, aliases, versions, flags, sizes. All run inside the JVM but the Shift-JIS decoder, whose character set
Spark's own function lacks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WHITE = " \t\r\n"
VOWELS = ("a", "i", "u", "e", "o")


def encoding(content: Column) -> Column:
    """UNKNOWN for no bytes, then a UTF-8 mark, ASCII, valid UTF-8, and Shift-JIS for the rest; null stays null."""
    ascii_only = F.length(F.regexp_replace(F.hex(content), "([0-7][0-9A-F])", "")) == 0
    return (
        F.when(content.isNull(), None).when(F.length(content) == 0, "UNKNOWN").when(F.substring(content, 1, 3) == F.lit(b"\xef\xbb\xbf"), "UTF-8-BOM")
        .when(ascii_only, "ASCII").when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("Shift-JIS")
    )


@F.pandas_udf(StringType())
def _shift_jis(content: pd.Series) -> pd.Series:
    return content.map(lambda b: None if b is None else bytes(b).decode("shift_jis", "replace"))


def decoded(content: Column) -> Column:
    """The bytes as text by their encoding, without a mark."""
    kind = encoding(content)
    return F.when(kind == "UTF-8-BOM", F.decode(F.substring(content, 4, 2147483647), "UTF-8")).when(kind == "Shift-JIS", _shift_jis(content)).otherwise(F.decode(content, "UTF-8"))


def alias(text: Column) -> Column:
    """Tabs and runs of spaces become one space; trimmed."""
    return F.btrim(F.regexp_replace(text, "[ \\t\\r\\n]+", " "), F.lit(WHITE))


def path(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("/"))


def vowel(phoneme: Column) -> Column:
    """The last character if it is a vowel, else an empty string."""
    last = F.right(phoneme, F.lit(1))
    return F.when(last.isin(*VOWELS), last).otherwise("")


def consonant(phoneme: Column) -> Column:
    """What stands before the last character."""
    return F.left(phoneme, F.greatest(F.length(phoneme) - 1, F.lit(0)))


def nth_word(text: Column, n: Column) -> Column:
    """Word n (from 0) of a text, the last one if there are fewer; null if there is none."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    return F.coalesce(F.try_element_at(words, n + 1), F.try_element_at(words, F.lit(-1)))


def version(text: Column) -> Column:
    """major.minor.patch as three integers; missing parts are 0, anything else gives null."""
    part = lambda i: F.coalesce(F.try_element_at(F.split(text, "\\."), F.lit(i)).cast("int"), F.lit(0))
    return F.when(text.rlike("^[0-9]{1,9}(\\.[0-9]{1,9}){0,2}$"), F.struct(part(1).alias("major"), part(2).alias("minor"), part(3).alias("patch")))


def compatible(a: Column, b: Column) -> Column:
    """Same major version, and a not older than b."""
    return (a["major"] == b["major"]) & (a >= b)


def csv_field(text: Column) -> Column:
    """Quoted if it holds a comma, a quote or a line end."""
    return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def file_size(size: Column) -> Column:
    """Bytes in the largest unit that leaves at least 1, with one decimal beyond bytes."""
    out = F.concat(size.cast("string"), F.lit(" B"))
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(size >= 1024**k, F.concat(F.format_string("%.1f", size / float(1024**k)), F.lit(f" {unit}"))).otherwise(out)
    return out


def label_time(ms: Column, mode: str) -> Column:
    """A time stamp of a label line: 100 ns units, seconds, or frames of 5 ms."""
    return {"ms": F.floor(ms * 10_000).cast("long").cast("string"), "seconds": F.format_string("%.6f", ms / 1000.0), "frames": F.floor(ms / 5).cast("long").cast("string")}[mode]
