"""Arguments of a resampler call, as arrays of text, read into typed records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name, place in the call (the program is at 0), least and most value (None: no bound), value where it is absent, empty or wrong (None: an error).
NUMBERS = [
    ("pitch", 3, -4800, 4800, None), ("velocity", 4, 1, 1000, None), ("offset", 6, 0, None, 0), ("length", 7, 0, None, 0), ("consonant", 8, 0, None, 0), ("cutoff", 9, None, None, 0),
    ("volume", 10, -60, 60, 0), ("start", 11, 0, 100, 0), ("end", 12, 0, 100, 100),
]
#: Arguments that a call has at least and at most, the program's name among them.
LEAST, MOST = 5, 13
_INT = (-(1 << 31), (1 << 31) - 1)


def whole(text: Column, least: int | None = None, most: int | None = None) -> Column:
    """A whole number of 32 bits with nothing behind it (space before and a sign may stand) between the bounds, both of which count; else null."""
    value = F.when(text.rlike(r"^[ \t-\r]*[+-]?[0-9]+\z"), F.regexp_replace(text, r"^[ \t-\r]*\+?", "").try_cast("bigint"))
    low, high = (b if given is None else given for b, given in zip(_INT, (least, most), strict=True))
    return F.when(value.between(low, high), value.cast("int"))


def resampler(args: Column) -> Column:
    """struct(input, output, pitch, velocity, flags, offset, length, consonant, cutoff, volume, start, end, error, is_valid) of a call.

    A call of fewer than LEAST or more than MOST arguments, without a path, or with a wrong pitch or velocity is not valid and says why; other numbers fall back to their defaults. Flags
    stay text, which ``signal.flags`` turns into a map; they are empty where there are none. A null call counts as one without arguments."""
    args = F.coalesce(args, F.array().cast("array<string>"))
    at = lambda i: F.get(args, i)
    found = {name: whole(at(i), low, high) for name, i, low, high, _ in NUMBERS}
    wrong = [F.when(found[name].isNull(), F.concat(F.lit(f"no valid {name}: "), F.coalesce(at(i), F.lit("")))) for name, i, *_, default in NUMBERS if default is None]
    n = F.size(args)
    count = F.when(n < LEAST, F.concat(F.lit("too few arguments: "), n.cast("string"))).when(n > MOST, F.concat(F.lit("too many arguments: "), n.cast("string")))
    error = F.coalesce(count, F.when((F.coalesce(at(1), F.lit("")) == "") | (F.coalesce(at(2), F.lit("")) == ""), F.lit("empty path")), *wrong)
    fields = [F.coalesce(found[name], F.lit(default)).alias(name) if default is not None else found[name].alias(name) for name, *_, default in NUMBERS]
    pitch, velocity, *rest = fields
    return F.struct(at(1).alias("input"), at(2).alias("output"), pitch, velocity, F.coalesce(at(5), F.lit("")).alias("flags"), *rest, error.alias("error"), error.isNull().alias("is_valid"))

