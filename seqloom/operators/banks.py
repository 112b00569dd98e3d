"""Voice banks as tables: folders found in a listing of files, their structure, and what their timing entries refer to.

A listing has ``path`` and ``length`` for each file, as Spark's binary reader gives them without their contents (``listing``). All
results are aggregates by folder; rows with a null path are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import text
from seqloom.sources import text_entries

#: Audio extensions, excluded folders and files, readme names.
AUDIO = (".wav", ".flac", ".aiff", ".aif")
SKIPPED_FOLDERS = (".git", ".svn", "_cache", "backup", "temp")
SKIPPED_FILES = (".DS_Store", "Thumbs.db", "desktop.ini")
README = ("readme.txt", "README.txt", "readme.md", "README.md")
INI, CHARACTER = "oto.ini", "character.txt"


def listing(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, length) of all files below the roots but empty ones, which Spark leaves out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    return files.select("path", "length")


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased, with its dot; empty for names without one."""
    return F.lower(F.regexp_extract(name(path), "(?<=.)(\\.[^.]*)$", 1))


def is_audio(path: Column) -> Column:
    return extension(path).isin(*AUDIO)


def skipped(path: Column) -> Column:
    """True for excluded files and for files below an excluded or hidden folder."""
    above = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return name(path).isin(*SKIPPED_FILES) | F.exists(above, lambda p: p.isin(*SKIPPED_FOLDERS) | p.rlike("^\\.[^./]"))


def folders(files: DataFrame) -> DataFrame:
    """By folder that holds a file: ``files``, ``bytes``, ``audio`` (files with an audio extension), and whether it has the timing file, the
    character file and a readme; ``is_bank`` if it has the timing file and audio. Candidates by no other rule: see ``discovered``."""
    p, one = F.col("path"), name(F.col("path"))
    got = files.where("path IS NOT NULL").groupBy(folder(p).alias("folder")).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count_if(is_audio(p)).alias("audio"), F.max(one == INI).alias("has_ini"),
        F.max(one == CHARACTER).alias("has_character"), F.max(one.isin(*README)).alias("has_readme"),
    )
    return got.withColumn("is_bank", F.col("has_ini") & (F.col("audio") > 0))


def discovered(files: DataFrame) -> DataFrame:
    """The folders that are banks, among files that are not skipped; roots that were listed together are scanned together."""
    return folders(files.where(~skipped(F.col("path")))).where("is_bank")


def extensions(files: DataFrame) -> DataFrame:
    """(extension, n) of the audio files."""
    return files.where(is_audio(F.col("path"))).groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("n"))


def read_entries(spark: SparkSession, *roots: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Entries and rejected lines, by ``folder``, of every timing file below the roots: decoded by its encoding, split into lines."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", INI).load(list(roots))
    lines = files.select(folder(F.col("path")).alias("folder"), F.posexplode(F.split(text.decoded(F.col("content")), "\n")).alias("line_no", "line"))
    return text_entries.entries(lines, ["folder"], "line_no", "line", strict)


def references(files: DataFrame, entries: DataFrame) -> DataFrame:
    """By folder with entries or files: ``entries``, ``referenced`` (distinct files), ``duplicate_aliases`` (aliases that stand more than once),
    ``missing`` (referenced but not listed) and ``orphaned`` (audio files of the folder that nothing refers to).

    Null aliases and file names count as names of their own in ``entries`` only."""
    by_alias = entries.groupBy("folder", "alias").agg(F.count("*").alias("n"))
    counts = by_alias.groupBy("folder").agg(F.sum("n").alias("entries"), F.count_if((F.col("n") > 1) & F.col("alias").isNotNull()).alias("duplicate_aliases"))
    named = entries.where("filename IS NOT NULL").select("folder", F.col("filename").alias("file")).distinct().withColumn("named", F.lit(1))
    held = files.where("path IS NOT NULL").select(folder(F.col("path")).alias("folder"), name(F.col("path")).alias("file"), is_audio(F.col("path")).cast("int").alias("audio"))
    held = held.groupBy("folder", "file").agg(F.max("audio").alias("audio"))
    both = named.join(held, ["folder", "file"], "full").groupBy("folder").agg(
        F.count("named").alias("referenced"), F.count_if(F.col("named").isNotNull() & F.col("audio").isNull()).alias("missing"),
        F.count_if(F.col("named").isNull() & (F.col("audio") == 1)).alias("orphaned"),
    )
    return both.join(counts, "folder", "left").fillna(0, ["entries", "duplicate_aliases"])


def validation(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Every folder with its structure, references, ``is_valid`` (timing file, audio, nothing missing) and ``suggestions``."""
    x = folders(files).join(references(files, entries), "folder", "left").fillna(0, ["entries", "duplicate_aliases", "referenced", "missing", "orphaned"])
    x = x.withColumn("is_valid", F.col("is_bank") & (F.col("missing") == 0))
    told = F.array(
        F.when(~F.col("has_ini"), "no timing file: list the samples and their times"), F.when(F.col("audio") == 0, "no audio: put the samples into the folder"),
        F.when(F.col("missing") > 0, F.concat(F.lit("samples that are listed but absent: "), F.col("missing").cast("string"))),
        F.when(F.col("duplicate_aliases") > 0, F.concat(F.lit("aliases given more than once: "), F.col("duplicate_aliases").cast("string"))),
    )
    return x.withColumn("suggestions", F.when(F.col("is_valid"), F.array().cast("array<string>")).otherwise(F.array_compact(told)))


def summary(validated: DataFrame) -> DataFrame:
    """One row: folders that are valid, partial (timing file or audio, not both in order) and invalid (neither)."""
    partly = F.col("has_ini") | (F.col("audio") > 0)
    return validated.agg(F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid") & partly).alias("partial"), F.count_if(~F.col("is_valid") & ~partly).alias("invalid"))


def structure_issues(checked: DataFrame) -> DataFrame:
    """(folder, severity, issue) for what a folder lacks."""
    issue = lambda when, severity, what: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(what).alias("issue")))
    found = F.array_compact(F.array(issue(~F.col("has_ini"), "error", "missing oto.ini"), issue(F.col("audio") == 0, "critical", "no audio files"), issue(~F.col("has_character"), "warning", "missing character.txt")))
    return checked.select("folder", F.inline(found))


def audio_guess(size: Column, duration_ms: Column) -> Column:
    """struct(level, noise_db, peak, clipping) guessed from bytes a millisecond; null without a duration."""
    per = F.try_divide(size, duration_ms)
    level = F.when(per < 50, 0.3).when(per > 200, 0.7).when(per.isNotNull(), 0.5)
    noise = F.when(per < 50, 30.0).when(per > 200, 60.0).when(per.isNotNull(), 45.0)
    return F.struct(level.alias("level"), noise.alias("noise_db"), (level * 1.4).alias("peak"), (level * 1.4 > 0.95).alias("clipping"))


def phonemes(entries: DataFrame) -> DataFrame:
    """The sorted distinct aliases; null is none."""
    return entries.where("alias IS NOT NULL").select("alias").distinct().orderBy("alias")
