"""Fill-in-the-middle rows: a text is cut at two of its units' boundaries and put together with the middle last.

A unit grammar over neighbouring characters becomes a regular expression of zero width, so that ``split`` keeps every character; which units
a text has is thus decided inside the JVM and nothing but the cuts depends on the id. Cuts, forms and shares follow from a SHA-256 of seed
and id, so a row comes out alike wherever and however often it is computed. Every row stands alone: nothing is shuffled.

Odd rows: a null text counts as empty and is ``plain``, as is a text that holds a marker; a null id counts as empty text; equal ids are cut alike
where their texts are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What marks prefix, suffix and middle, and the query's seed, share of texts that are cut and share of those with the suffix first, in percent.
MARKERS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM = 7, 100, 50


def ended_by(chars: str) -> str:
    """``[^C]*C|[^C]+``: a unit runs to the first of the characters, that one included. ``chars`` is what stands inside the brackets of a class."""
    return rf"(?<=[{chars}])(?=[\s\S])"


def led_by(chars: str) -> str:
    """``C*[^C]+|C+``: a unit begins with all the characters C before it."""
    return f"(?<=[^{chars}])(?=[{chars}])"


def followed_by(chars: str) -> str:
    """``[^C]+C*|C+``: a unit takes all the characters C after it."""
    return f"(?<=[{chars}])(?=[^{chars}])"


def runs_of(*classes: str) -> str:
    """``A+|B+|...|[^AB...]+``: longest runs of one class; the classes have no character in common."""
    return "|".join(f"(?<=[{c}])(?=[^{c}])|(?<=[^{c}])(?=[{c}])" for c in classes)


def each() -> str:
    """``.``: every code point."""
    return r"(?<=[\s\S])(?=[\s\S])"


UNITS = {"lines": ended_by(r"\n"), "sentences": ended_by(".!?"), "words": led_by(r"\s"), "words with space": followed_by(r"\s"), "runs": runs_of(r"\p{L}\p{N}_", r"\s"), "characters": each()}


def units(text: Column, boundary: str) -> Column:
    """The units of a text; none of an empty one, which ``split`` would give one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary, -1))


def _number(digest: Column, k: int) -> Column:
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def _apart(markers: tuple[str, str, str]) -> None:
    """A marker is found again by its first occurrence; that holds if no end of a marker can begin one, and none holds another."""
    for a in markers:
        for b in markers:
            if not a or any(a.endswith(b[:k]) for k in range(1, len(b))) or (a != b and a in b) or len(set(markers)) < 3:
                raise ValueError("markers must differ and neither hold each other nor overlap")


def transform(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "lines", seed: int = SEED, rate: int = RATE, spm: int = SPM, markers: tuple[str, str, str] = MARKERS,
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the number of units, ``plain``, ``psm`` or ``spm``, and the text in that form.

    ``unit`` is one of UNITS or a boundary of your own. ``rate`` percent of the texts are cut, ``spm`` percent of these have the suffix first."""
    _apart(markers)
    p, s, m = (F.lit(x) for x in markers)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    x = docs.select(F.col(doc_id).alias("id"), F.coalesce(text, F.lit("")).alias("t"), digest.alias("h"))
    x = x.select("id", "t", units(F.col("t"), UNITS.get(unit, unit)).alias("u"), *(_number(F.col("h"), k).alias(f"h{k}") for k in range(1, 5)))
    cut = lambda h: (F.col(h) % (F.size("u") + 1)).cast("int")
    x = x.select("id", "t", "u", "h3", "h4", F.least(cut("h1"), cut("h2")).alias("i"), F.greatest(cut("h1"), cut("h2")).alias("j"))
    plain = (F.size("u") == 0) | F.contains("t", p) | F.contains("t", s) | F.contains("t", m) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    piece = lambda first, n: F.array_join(F.slice("u", first, n), "")
    x = x.select(
        "id", "t", F.size("u").cast("long").alias("n"), form.alias("form"), piece(F.lit(1), F.col("i")).alias("a"), piece(F.col("i") + 1, F.col("j") - F.col("i")).alias("b"),
        piece(F.col("j") + 1, F.size("u") - F.col("j")).alias("c"),
    )
    output = F.when(F.col("form") == "plain", F.col("t")).when(F.col("form") == "spm", F.concat(s, "c", p, "a", m, "b")).otherwise(F.concat(p, "a", s, "c", m, "b"))
    held = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    return x.select(F.col("id").alias(doc_id), "n", "form", held("a").alias("prefix_chars"), held("b").alias("middle_chars"), output.alias("output"))


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output in a form was made from."""
    _apart(markers)
    p, s, m = markers

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        """What stands between the first marker, the second and that of the middle."""
        rest = F.substr(output, F.lit(len(first) + 1))
        tail = F.substring_index(output, m, -1)
        return F.substring_index(rest, second, 1), F.substring_index(F.substring_index(output, m, 1), second, -1), tail

    a, c, b = parts(p, s)
    c2, a2, b2 = parts(s, p)
    return F.when(form == "psm", F.concat(a, b, c)).when(form == "spm", F.concat(a2, b2, c2)).otherwise(output)


def digest(docs: DataFrame) -> DataFrame:
    """The rows of ``op13_fill_in_middle``."""
    x = transform(docs)
    x = x.withColumn("restored", restore(F.col("output"), F.col("form")))
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_H = [f"CAST(concat('0x', substr(h, {8 * k - 7}, 8)) AS BIGINT)" for k in range(1, 5)]
#: The text itself is what must come back.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256(concat('{SEED}:', doc_id)) AS h FROM documents),
e AS (SELECT *, least({_H[0]} % (len(u) + 1), {_H[1]} % (len(u) + 1)) AS i, greatest({_H[0]} % (len(u) + 1), {_H[1]} % (len(u) + 1)) AS j,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_H[2]} % 100 >= {RATE} THEN 'plain' WHEN {_H[3]} % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM d),
f AS (SELECT *, array_to_string(list_slice(u, 1, i), '') AS a, array_to_string(list_slice(u, i + 1, j), '') AS b, array_to_string(list_slice(u, j + 1, len(u)), '') AS c FROM e)
SELECT doc_id, CAST(len(u) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN concat('<S>', c, '<P>', a, '<M>', b) ELSE concat('<P>', a, '<S>', c, '<M>', b) END) AS output_sha256, sha256(t) AS restored_sha256 FROM f
"""
