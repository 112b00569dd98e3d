"""Labels that say a sound's whole context: the form that models are trained on, the form for people, and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.sinks.forms import label_line

# The fields of a context label in their order; ``:d`` marks numbers whose fraction is cut off, ``:b`` truth as 1 or 0.
LABEL = (
    "/A:{syllables_from_start}_{syllables_to_end}/B:{syllable_position}_{syllable_length}/C:{l2}-{l1}+{c}++{r1}+{r2}/D:{word_position}_{word_length}/E:{words_from_start}_{words_to_end}"
    "/F:{phrase_syllables}_{phrase_words}/G:{pitch_cents:d}_{duration_ms:d}/H:{tempo:d}_{beat}/I:{stressed:b}_{accented:b}_{stress_level}"
)
# The same for people.
TEXT = "Context[{l2}-{l1}-{c}+{r1}+{r2} | syl:{syllable_position}/{syllable_length} | word:{word_position}/{word_length} | pitch:{pitch_cents}c | dur:{duration_ms}ms]"


def _filled(form: str, fields: dict[str, Column]) -> Column:
    """The form with a field's text in each pair of braces; nulls are empty text, but false where truth is asked for."""
    parts: list[Column] = []
    for piece in form.split("{"):
        name, brace, rest = piece.partition("}")
        if not brace:
            parts.append(F.lit(piece))
            continue
        name, _, kind = name.partition(":")
        value = fields[name]
        if kind == "d":
            value = value.cast("double").cast("long")
        elif kind == "b":
            value = F.coalesce(value, F.lit(False)).cast("int")
        parts += [F.coalesce(value.cast("string"), F.lit("")), F.lit(rest)]
    return F.concat(*parts)


def context_label(fields: dict[str, Column]) -> Column:
    """The label of a context whose ``fields`` are those that LABEL names; pitch, duration and tempo lose their fractions towards zero."""
    return _filled(LABEL, fields)


def context_text(fields: dict[str, Column]) -> Column:
    """The same for people, with pitch and duration as they are."""
    return _filled(TEXT, fields)


def label_files(rows: DataFrame, keys: list[str], start_ms: str, end_ms: str, label: str, tie: str, mode: str = "ms") -> DataFrame:
    """(keys, lines, content): an utterance's label lines by start (then ``tie``), each with its line end; one utterance is one file, as long as it is."""
    line = label_line(F.col(start_ms), F.col(end_ms), F.col(label), mode)
    x = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(start_ms).alias("s"), F.col(tie).alias("t"), line.alias("l")))).alias("f"))
    return x.select(*keys, F.size("f").cast("long").alias("lines"), F.concat(F.array_join("f.l", "\n"), F.lit("\n")).alias("content"))
