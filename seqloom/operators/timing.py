"""Boundaries of vowel-consonant-vowel segments, their quality, and the timing of notes.

Columns that are null give null results unless a docstring says otherwise; nothing here orders rows but the functions that say by what.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions import text
from seqloom.operators import rules
from seqloom.operators import sequence as seq

#: Vowels, consonants, and estimated consonant durations in ms.
VOWELS = ("a", "i", "u", "e", "o")
CONSONANTS = ("k", "g", "s", "sh", "z", "j", "t", "ch", "d", "n", "h", "b", "p", "m", "y", "r", "w")
CONSONANT_MS = {"k": 50.0, "g": 50.0, "t": 50.0, "d": 50.0, "s": 80.0, "sh": 80.0, "z": 80.0, "m": 60.0, "n": 60.0, "r": 40.0}
OTHER_MS = 60.0
LEAST_VOWEL_MS, LEAST_CONSONANT_MS, LEAST_CONFIDENCE = 30.0, 20.0, 0.5
TOLERANCE_MS = 50.0
#: The timing that an alias alone is given.
ALIAS_ONLY = {"offset": 100.0, "consonant": 50.0, "blank": 100.0, "preutterance": 80.0, "overlap": 20.0}

EDGES = ("vowel1_start", "vowel1_end", "consonant_start", "consonant_end", "vowel2_start", "vowel2_end")


def boundaries(offset: Column, consonant: Column, blank: Column, preutterance: Column) -> dict[str, Column]:
    """The six edges of a segment in ms from its timing entry."""
    after = offset + consonant
    return dict(zip(EDGES, (offset - preutterance, offset, offset, after, after, after + blank), strict=True))


def lengthened(edges: dict[str, Column], vowel: float = LEAST_VOWEL_MS, consonant: float = LEAST_CONSONANT_MS) -> dict[str, Column]:
    """The edges with ends moved so that vowels and consonant have their least durations; starts stay."""
    out = dict(edges)
    for part, least in (("vowel1", vowel), ("consonant", consonant), ("vowel2", vowel)):
        start, end = edges[f"{part}_start"], edges[f"{part}_end"]
        out[f"{part}_end"] = F.when(end - start < least, start + least).otherwise(end)
    return out


def valid(edges: dict[str, Column], vowel: float = LEAST_VOWEL_MS, consonant: float = LEAST_CONSONANT_MS) -> Column:
    """True if each part begins before it ends and lasts its least duration."""
    length = lambda part: edges[f"{part}_end"] - edges[f"{part}_start"]
    return (length("vowel1") > 0) & (length("consonant") > 0) & (length("vowel2") > 0) & (length("vowel1") >= vowel) & (length("consonant") >= consonant) & (length("vowel2") >= vowel)


def confidence(edges: dict[str, Column], consistent: Column) -> Column:
    """1, times 0.7 without consistent timing, 0.5 under 100 ms in all, 0.8 where the consonant takes less than a tenth or over 0.8."""
    whole, part = edges["vowel2_end"] - edges["vowel1_start"], edges["consonant_end"] - edges["consonant_start"]
    share = F.try_divide(part, whole)
    return F.when(consistent, 1.0).otherwise(0.7) * F.when(whole < 100, 0.5).otherwise(1.0) * F.when((share < 0.1) | (share > 0.8), 0.8).otherwise(1.0)


def consonant_ms(consonant: Column) -> Column:
    """The estimated duration of a consonant; OTHER_MS for any other text and null."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in CONSONANT_MS.items() for x in pair])[consonant], F.lit(OTHER_MS))


def is_vowel(phoneme: Column) -> Column:
    return phoneme.isin(*VOWELS)


def is_consonant(phoneme: Column) -> Column:
    return phoneme.isin(*CONSONANTS)


def parts(alias: Column) -> Column:
    """struct(vowel1, consonant, vowel2) of ``a ka`` or ``a k a``; empty texts for other forms."""
    w = F.split(text.alias(alias), " ")
    one, two, three = (F.coalesce(F.get(w, F.lit(i)), F.lit("")) for i in range(3))
    n = F.size(w)
    short = (n == 2) & (F.length(two) >= 2)
    return F.struct(
        F.when(n.isin(2, 3), one).otherwise("").alias("vowel1"), F.when(short, text.consonant(two)).when(n == 3, two).otherwise("").alias("consonant"),
        F.when(short, F.right(two, F.lit(1))).when(n == 3, three).otherwise("").alias("vowel2"),
    )


def coarticulation(vowel1: Column, consonant: Column, vowel2: Column) -> Column:
    """How easily the parts follow one another, 1 at most."""
    hard = ((vowel1 == "i") & (consonant == "u")) | ((vowel2 == "u") & (consonant == "i"))
    easy = ((vowel1 == "a") & (vowel2 == "a")) | consonant.isin("k", "s")
    return F.least(F.lit(1.0), F.when(hard, 0.8).otherwise(1.0) * F.when(easy, 1.1).otherwise(1.0))


def quality(part: Column, edges: dict[str, Column], sure: Column) -> Column:
    """Quality of a segment from 0 to 1: its confidence, halved unless its parts are vowel, consonant, vowel; 0 without duration."""
    known = is_vowel(part["vowel1"]) & is_consonant(part["consonant"]) & is_vowel(part["vowel2"])
    whole, middle = edges["vowel2_end"] - edges["vowel1_start"], edges["consonant_end"] - edges["consonant_start"]
    share = F.try_divide(middle, whole)
    got = sure * F.when(known, 1.0).otherwise(0.5 * 0.7) * F.when((share < 0.1) | (share > 0.8), 0.8).otherwise(1.0)
    return F.when((whole <= 0) | (middle <= 0), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), got)))


def segments(entries: DataFrame, alias: str = "alias", offset: str = "offset", consonant: str = "consonant", blank: str = "blank", preutterance: str = "preutterance") -> DataFrame:
    """entries with ``kind`` (vcv, cv or other), ``part``, the six edges, ``sure`` (confidence) and ``accepted``: a vcv with all parts and
    the least confidence. A null alias is other; null timing is not consistent and not accepted."""
    c = [F.col(x) for x in (offset, consonant, blank, preutterance)]
    edges = boundaries(*c)
    word, part = text.alias(F.col(alias)), parts(F.col(alias))
    vcv = word.rlike("^[aiueo] [kgsztdnhbpmyrwj][aiueo]$") | word.rlike("^[aiueo] (k|g|s|sh|z|j|t|ch|d|n|h|b|p|m|y|r|w) [aiueo]$")
    kind = F.when(vcv, "vcv").when(word.rlike("^[kgsztdnhbpmyrwj][aiueo]"), "cv").otherwise("other")
    sure = confidence(edges, F.coalesce(rules.timing_consistent(*c), F.lit(False)))
    out = entries.select("*", kind.alias("kind"), part.alias("part"), *(e.alias(k) for k, e in edges.items()), sure.alias("sure"))
    return out.withColumn("accepted", F.coalesce((F.col("kind") == "vcv") & (F.col("part.vowel2") != "") & (F.col("sure") >= LEAST_CONFIDENCE) & F.col("vowel1_start").isNotNull() & F.col("vowel2_end").isNotNull(), F.lit(False)))


def recognition(found: DataFrame, keys: list[str]) -> DataFrame:
    """Of the rows of ``segments`` by key: accepted segments, cv aliases, errors, and over the accepted the mean confidence, the mean
    durations of vowels, consonant and whole, and naturalness (mean co-articulation); means are 0 without accepted segments."""
    ok = F.col("accepted")
    mean = lambda c: F.coalesce(F.avg(F.when(ok, c)), F.lit(0.0))
    vowels = F.col("consonant_start") - F.col("vowel1_start") + F.col("vowel2_end") - F.col("consonant_end")
    p = F.col("part")
    return found.groupBy(*keys).agg(
        F.count_if(ok).alias("segments"), F.count_if(F.col("kind") == "cv").alias("cv"), F.count_if(F.col("kind") == "other").alias("errors"), mean(F.col("sure")).alias("confidence"),
        mean(vowels).alias("vowel_ms"), mean(F.col("consonant_end") - F.col("consonant_start")).alias("consonant_ms"), mean(F.col("vowel2_end") - F.col("vowel1_start")).alias("whole_ms"),
        mean(coarticulation(p["vowel1"], p["consonant"], p["vowel2"])).alias("naturalness"),
    )


def sequence_text(found: DataFrame, keys: list[str], order: list[str], alias: str = "alias") -> DataFrame:
    """(keys, phonemes, line): ``a -> b`` over a sequence's accepted segments, and its phonemes: the first vowel, then consonant and vowel
    of each. One array a sequence; ties of the order keys are broken by alias."""
    rows = found.where("accepted").select(*keys, F.struct(*order, F.col(alias).alias("alias"), F.col("part").alias("part")).alias("x"))
    got = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("x")).alias("x"))
    after = F.transform("x", lambda r: F.concat(r["part"]["consonant"], r["part"]["vowel2"]))
    phonemes = F.concat(F.transform(F.slice("x", 1, 1), lambda r: r["part"]["vowel1"]), after)
    return got.select(*keys, F.array_join(phonemes, " ").alias("phonemes"), F.array_join(F.transform("x", lambda r: r["alias"]), " -> ").alias("line"))


def overlaps(found: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Accepted segments that begin before the one before them ends."""
    w = seq.over(keys, order)
    return found.where("accepted").withColumn("before_end", F.lag("vowel2_end").over(w)).where("vowel1_start < before_end")


def note_timing(start: Column, duration: Column, preutterance: Column, blank: Column) -> tuple[Column, Column]:
    """Start and duration of a note's phoneme: the pre-utterance moves the start ahead and lengthens it, as does the blank."""
    lead = F.when(preutterance > 0, preutterance).otherwise(0.0)
    return start - lead, duration + lead + F.when(blank > 0, blank).otherwise(0.0)


def timing_usable(start: Column, duration: Column, pitch: Column, sure: Column) -> Column:
    return F.coalesce((duration > 0) & (start >= 0) & (pitch > 0) & (sure > 0), F.lit(False))


def generated_name(ordinal: Column) -> Column:
    """The file name of the entry that stands for a note, ordinals from 0."""
    return F.concat(F.lit("generated_"), ordinal.cast("string"), F.lit(".wav"))


def integration_quality(notes: DataFrame, keys: list[str], order: list[str], note_start: str = "note_start", note_hz: str = "note_hz", start: str = "start", duration: str = "duration", hz: str = "hz") -> DataFrame:
    """By key: ``onset`` (mean e^(-gap / 50 ms) between note and phoneme), ``pitch`` (mean e^(-cents / 100), 0.5 where one is missing),
    ``coherence`` of neighbours (1 for one row), their weighted ``overall`` 0.4, 0.3, 0.3, and ``total_ms``, the latest end.

    Ties of the order keys leave the neighbours open, so give keys that tell rows apart."""
    w = seq.over(keys, order)
    a, b = F.col(note_hz), F.col(hz)
    both = (a > 0) & (b > 0)
    cents = F.when(both, F.abs(1200 * F.log2(F.when(both, b / a))))
    end = F.col(start) + F.col(duration)
    gap, ratio = F.col(start) - F.lag(end).over(w), F.try_divide(b, F.lag(b).over(w))
    near = (F.exp(-F.abs(gap) / 100) + F.exp(-F.abs(F.log2(ratio)) / 2)) / 2
    rows = notes.select(*keys, F.exp(-F.abs(F.col(note_start) - F.col(start)) / 50).alias("onset"), F.coalesce(F.exp(-cents / 100), F.lit(0.5)).alias("pitch"), near.alias("near"), end.alias("end"))
    got = rows.groupBy(*keys).agg(F.avg("onset").alias("onset"), F.avg("pitch").alias("pitch"), F.coalesce(F.avg("near"), F.lit(1.0)).alias("coherence"), F.max("end").alias("total_ms"))
    return got.withColumn("overall", 0.4 * F.col("onset") + 0.3 * F.col("pitch") + 0.3 * F.col("coherence"))


def pitch_curve(hz: Column, bend: Column, modulation: Column, time_ms: Column) -> Column:
    """A note's pitch at a moment: bent by semitones, with a vibrato of 5 Hz and 5 % depth at full modulation (0 to 127)."""
    return hz * F.pow(F.lit(2.0), bend / 12) * (1 + F.sin(2 * F.pi() * 5 * time_ms / 1000) * modulation / 127 * 0.05)


def controls(modulation: Column, volume: Column, pan: Column, cutoff: Column) -> dict[str, Column]:
    """What four controllers (0 to 127, null as 0) mean: vibrato depth, dynamics (1 for none), brightness (0.5 for none), vibrato rate."""
    m, v, p, c = (F.coalesce(x, F.lit(0)) / 127 for x in (modulation, volume, pan, cutoff))
    return {"vibrato_depth": m, "dynamics": F.when(v == 0, 1.0).otherwise(v), "brightness": F.when(p == 0, 0.5).otherwise(p), "vibrato_rate": 3 + 4 * c}


def label_statistics(labels: DataFrame, keys: list[str], start: str, end: str, label: str) -> DataFrame:
    """By key: count, sum, mean, least and greatest duration in ms, and the sorted distinct phonemes between two plus signs."""
    d, found = F.col(end) - F.col(start), F.regexp_extract(F.col(label), "\\+([^+]+)\\+", 1)
    return labels.groupBy(*keys).agg(
        F.count("*").alias("entries"), F.sum(d).alias("total_ms"), F.avg(d).alias("mean_ms"), F.min(d).alias("least_ms"), F.max(d).alias("most_ms"),
        F.sort_array(F.collect_set(F.when(found != "", found))).alias("phonemes"),
    )


def label_quality(labels: DataFrame, keys: list[str], order: list[str], start: str, end: str, label: str) -> DataFrame:
    """By key: ``accuracy`` 0.9 to the number of gaps over 1 ms, ``consistency`` the share of labels that hold a slash, and ``overall``, the
    mean of both and a constant 0.8. Null labels hold none."""
    gap = F.abs(F.col(start) - F.lag(end).over(seq.over(keys, order))) > 1
    rows = labels.select(*keys, gap.alias("gap"), F.coalesce(F.contains(F.col(label), F.lit("/")), F.lit(False)).alias("full"))
    got = rows.groupBy(*keys).agg(F.pow(F.lit(0.9), F.count_if("gap")).alias("accuracy"), F.avg(F.col("full").cast("double")).alias("consistency"))
    return got.withColumn("overall", (F.col("accuracy") + F.col("consistency") + 0.8) / 3)
