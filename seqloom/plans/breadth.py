"""Queries of segment timing, voice banks, reports and scalar functions, with their SQL counterparts.

Line items stand for timing entries, events for notes, line items by order for the files of a bank.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from seqloom.functions import phonemes, scalars, signal
from seqloom.operators import banks, reports, rules
from seqloom.operators import sequence as seq
from seqloom.operators import statistics as st
from seqloom.operators import timing as tm
from seqloom.plans.catalogue import _DIMS, EV, WD, K, O, _dims, ev, query, rnd, tb

# Timing entries: every line item has an alias of one of five forms.
_LI = """li AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice / 500 AS c, l_discount * 1000 AS b, l_tax * 1000 - 10 AS p,
['a','i','u','e','o'][1 + l_partkey % 5] AS v1, ['k','s','t','n','x'][1 + l_suppkey % 5] AS k, ['a','i','u','e','o'][1 + l_suppkey % 5] AS v2, l_partkey % 5 AS form FROM lineitem),
en AS (SELECT *, CASE form WHEN 0 THEN v1 || ' ' || k || v2 WHEN 1 THEN v1 || chr(9) || k || '  ' || v2 WHEN 2 THEN k || v2 WHEN 3 THEN 'R' ELSE ' ' || v1 || ' ' || k || v2 END AS alias FROM li)"""
# b: blank may be zero, c: consonant, p: pre-utterance may be negative
_SEG = f"""{_LI}, wd AS (SELECT *, trim(regexp_replace(alias, '[ \\t]+', ' ', 'g')) AS w, q - p AS s, q + c AS m, q + c + b AS e FROM en),
sg AS (SELECT *, CASE WHEN regexp_matches(w, '^[aiueo] [kgsztdnhbpmyrwj][aiueo]$') OR regexp_matches(w, '^[aiueo] (k|g|s|sh|z|j|t|ch|d|n|h|b|p|m|y|r|w) [aiueo]$') THEN 'vcv' WHEN regexp_matches(w, '^[kgsztdnhbpmyrwj][aiueo]') THEN 'cv' ELSE 'other' END AS kind,
CASE WHEN q >= 0 AND c >= 0 AND b >= 0 AND c + b > 0 AND p <= (c + b) * 2 THEN 1e0 ELSE 0.7e0 END * CASE WHEN e - s < 100 THEN 0.5e0 ELSE 1e0 END * CASE WHEN (m - q) / nullif(e - s, 0) < 0.1e0 OR (m - q) / nullif(e - s, 0) > 0.8e0 THEN 0.8e0 ELSE 1e0 END AS sure FROM wd),
ac AS (SELECT *, kind = 'vcv' AND sure >= 0.5 AS accepted FROM sg)"""


def _entries(spark, sf):
    pick = lambda letters, c: F.element_at(F.array(*map(F.lit, letters)), (1 + F.col(c) % 5).cast("int"))
    li = tb(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("offset"), (F.col("l_extendedprice") / 500).alias("consonant"), (F.col("l_discount") * 1000).alias("blank"), (F.col("l_tax") * 1000 - 10).alias("preutterance"),
        pick("aiueo", "l_partkey").alias("v1"), pick("kstnx", "l_suppkey").alias("k"), pick("aiueo", "l_suppkey").alias("v2"), (F.col("l_partkey") % 5).alias("form"),
    )
    c, f = F.col, F.col("form")
    forms = F.when(f == 0, F.concat("v1", F.lit(" "), "k", "v2")).when(f == 1, F.concat("v1", F.lit("\t"), "k", F.lit("  "), "v2")).when(f == 2, F.concat("k", "v2")).when(f == 3, "R").otherwise(F.concat(F.lit(" "), c("v1"), F.lit(" "), c("k"), c("v2")))
    return li.withColumn("alias", forms)


def _edges():
    return tm.boundaries(*(F.col(x) for x in ("offset", "consonant", "blank", "preutterance")))


@query("prj04_boundaries", f"""WITH {_LI} SELECT l_orderkey, l_linenumber, round(q - p, 6) AS vowel1_start, q AS vowel1_end, q AS consonant_start, round(q + c, 6) AS consonant_end, round(q + c, 6) AS vowel2_start, round(q + c + b, 6) AS vowel2_end FROM li""")
def _(spark, sf):
    e = _edges()
    return rnd(_entries(spark, sf).select("l_orderkey", "l_linenumber", *(v.alias(k) for k, v in e.items())), "vowel1_start", "consonant_end", "vowel2_start", "vowel2_end")


@query("prj05_lengthened", f"""WITH {_LI} SELECT l_orderkey, l_linenumber, round(CASE WHEN p < 30 THEN q - p + 30 ELSE q END, 6) AS vowel1_end, round(CASE WHEN c < 20 THEN q + 20 ELSE q + c END, 6) AS consonant_end, round(CASE WHEN (q + c + b) - (q + c) < 30 THEN q + c + 30 ELSE q + c + b END, 6) AS vowel2_end FROM li""")
def _(spark, sf):
    e = tm.lengthened(_edges())
    return rnd(_entries(spark, sf).select("l_orderkey", "l_linenumber", *(e[k].alias(k) for k in ("vowel1_end", "consonant_end", "vowel2_end"))), "vowel1_end", "consonant_end", "vowel2_end")


@query("prj06_parts", f"""WITH {_SEG}, x AS (SELECT *, string_split(w, ' ') AS t FROM sg) SELECT l_orderkey, l_linenumber, CASE WHEN len(t) IN (2, 3) THEN t[1] ELSE '' END AS vowel1, CASE WHEN len(t) = 2 AND length(t[2]) >= 2 THEN t[2][:-2] WHEN len(t) = 3 THEN t[2] ELSE '' END AS consonant, CASE WHEN len(t) = 2 AND length(t[2]) >= 2 THEN right(t[2], 1) WHEN len(t) = 3 THEN t[3] ELSE '' END AS vowel2 FROM x""")
def _(spark, sf):
    return _entries(spark, sf).select("l_orderkey", "l_linenumber", tm.parts(F.col("alias")).alias("x")).select("l_orderkey", "l_linenumber", "x.*")


@query("flt04_boundaries_valid", f"""WITH {_LI} SELECT l_orderkey, l_linenumber, p > 0 AND c > 0 AND q + c + b > q + c AND q - (q - p) >= 30 AND (q + c) - q >= 20 AND (q + c + b) - (q + c) >= 30 AS valid FROM li""")
def _(spark, sf):
    return _entries(spark, sf).select("l_orderkey", "l_linenumber", tm.valid(_edges()).alias("valid"))


@query("flt06_members", f"""WITH {_LI} SELECT l_orderkey, l_linenumber, v1 IN ('a','i','u','e','o') AS vowel, k IN ('k','s','t','n') AS consonant FROM li""")
def _(spark, sf):
    return _entries(spark, sf).select("l_orderkey", "l_linenumber", tm.is_vowel(F.col("v1")).alias("vowel"), tm.is_consonant(F.col("k")).alias("consonant"))


@query("fn_m07_confidence", f"""WITH {_SEG} SELECT l_orderkey, l_linenumber, kind, round(sure, 6) AS sure, accepted FROM ac""")
def _(spark, sf):
    return rnd(tm.segments(_entries(spark, sf)).select("l_orderkey", "l_linenumber", "kind", "sure", "accepted"), "sure")


@query("fn_m07_quality", f"""WITH {_SEG}, x AS (SELECT *, string_split(w, ' ') AS t FROM ac), y AS (SELECT *, CASE WHEN len(t) = 2 THEN t[2][:-2] ELSE t[2] END AS mid FROM x WHERE accepted)
SELECT l_orderkey, l_linenumber, round(CASE WHEN e - s <= 0 OR c <= 0 THEN 0 ELSE sure * CASE WHEN mid IN ('k','s','t','n') THEN 1 ELSE 0.35 END * CASE WHEN (m - q) / (e - s) < 0.1 OR (m - q) / (e - s) > 0.8 THEN 0.8 ELSE 1 END END, 6) AS quality, round(least(1, CASE WHEN (t[1] = 'a' AND right(w, 1) = 'a') OR mid IN ('k', 's') THEN 1.1 ELSE 1 END), 6) AS coarticulation FROM y""")
def _(spark, sf):
    x, p = tm.segments(_entries(spark, sf)).where("accepted"), F.col("part")
    edges = {k: F.col(k) for k in tm.EDGES}
    return rnd(x.select("l_orderkey", "l_linenumber", tm.quality(p, edges, F.col("sure")).alias("quality"), tm.coarticulation(p["vowel1"], p["consonant"], p["vowel2"]).alias("coarticulation")), "quality", "coarticulation")


@query("ag14_recognition", f"""WITH {_SEG} SELECT l_linenumber, count(*) FILTER (WHERE accepted) AS segments, count(*) FILTER (WHERE kind = 'cv') AS cv, count(*) FILTER (WHERE kind = 'other') AS errors, round(coalesce(avg(sure) FILTER (WHERE accepted), 0), 6) AS confidence, round(coalesce(avg(q - s + e - m) FILTER (WHERE accepted), 0), 6) AS vowel_ms, round(coalesce(avg(m - q) FILTER (WHERE accepted), 0), 6) AS consonant_ms, round(coalesce(avg(e - s) FILTER (WHERE accepted), 0), 6) AS whole_ms FROM ac GROUP BY 1""")
def _(spark, sf):
    return rnd(tm.recognition(tm.segments(_entries(spark, sf)), ["l_linenumber"]).drop("naturalness"), "confidence", "vowel_ms", "consonant_ms", "whole_ms")


@query("ag16_naturalness", f"""WITH {_SEG}, x AS (SELECT *, string_split(w, ' ') AS t FROM ac) SELECT l_linenumber, round(coalesce(avg(least(1, CASE WHEN (t[1] = 'a' AND right(w, 1) = 'a') OR (CASE WHEN len(t) = 2 THEN t[2][:-2] ELSE t[2] END) IN ('k', 's') THEN 1.1 ELSE 1 END)) FILTER (WHERE accepted), 0), 6) AS naturalness FROM x GROUP BY 1""")
def _(spark, sf):
    return rnd(tm.recognition(tm.segments(_entries(spark, sf)), ["l_linenumber"]).select("l_linenumber", "naturalness"), "naturalness")


@query("fn_s11_sequence", f"""WITH {_SEG}, x AS (SELECT *, string_split(w, ' ') AS t FROM ac WHERE accepted) SELECT l_orderkey, string_agg(CASE WHEN len(t) = 2 THEN t[2] ELSE t[2] || t[3] END, ' ' ORDER BY l_linenumber, q, c) AS syllables, string_agg(alias, ' -> ' ORDER BY l_linenumber, q, c) AS line, arg_min(t[1], (l_linenumber, q, c)) AS first FROM x GROUP BY 1""")
def _(spark, sf):
    got = tm.sequence_text(tm.segments(_entries(spark, sf)), ["l_orderkey"], ["l_linenumber", "offset", "consonant"])
    words = F.split("phonemes", " ")
    return got.select("l_orderkey", F.array_join(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("syllables"), "line", words[0].alias("first"))


@query("fn_m10_consonant_ms", f"""WITH {_LI} SELECT l_orderkey, l_linenumber, CASE WHEN k IN ('k', 't') THEN 50.0 WHEN k = 's' THEN 80.0 ELSE 60.0 END AS ms FROM li""")
def _(spark, sf):
    return _entries(spark, sf).select("l_orderkey", "l_linenumber", tm.consonant_ms(F.col("k")).alias("ms"))


@query("prj08_note_timing", f"""WITH {_LI} SELECT l_orderkey, l_linenumber, round(q - greatest(p, 0), 6) AS start, round(c + greatest(p, 0) + greatest(b, 0), 6) AS duration, 'generated_' || (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, q, c) - 1) || '.wav' AS name FROM li""")
def _(spark, sf):
    start, duration = tm.note_timing(*(F.col(x) for x in ("offset", "consonant", "preutterance", "blank")))
    ordinal = F.row_number().over(seq.over(["l_orderkey"], ["l_linenumber", "offset", "consonant"])) - 1
    return rnd(_entries(spark, sf).select("l_orderkey", "l_linenumber", start.alias("start"), duration.alias("duration"), tm.generated_name(ordinal).alias("name")), "start", "duration")


@query("flt07_usable", f"""WITH {_LI} SELECT l_orderkey, l_linenumber, c > 0 AND q - 10 >= 0 AND b > 0 AND p > 0 AS usable FROM li""")
def _(spark, sf):
    return _entries(spark, sf).select("l_orderkey", "l_linenumber", tm.timing_usable(F.col("offset") - 10, F.col("consonant"), F.col("blank"), F.col("preutterance")).alias("usable"))


@query("jn03_notes_by_position", f"""WITH {EV}, n AS (SELECT user_id, value, row_number() OVER {WD} AS i FROM ev), t AS (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) SELECT user_id, CAST(n.i AS BIGINT) AS i, value, o_totalprice AS price FROM n JOIN t ON o_custkey = user_id AND t.i = n.i""")
def _(spark, sf):
    return seq.by_position(ev(spark, sf).select("user_id", "t", "event_id", "value"), tb(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", F.col("o_totalprice").alias("price")), K, O, ["o_orderkey"]).select("user_id", F.col("i").cast("long").alias("i"), "value", "price")


@query("ag19_integration", f"""WITH {EV}, x AS (SELECT *, t / 1000.0 AS note_start, t / 1000.0 - value AS s, value * 2 AS d, value + 50 AS hz, 440.0 AS note_hz FROM ev), y AS (SELECT *, s - lag(s + d) OVER w AS gap, hz / lag(hz) OVER w AS ratio FROM x WINDOW w AS {WD})
SELECT user_id, round(avg(exp(-abs(note_start - s) / 50)), 6) AS onset, round(avg(exp(-abs(1200 * log2(hz / note_hz)) / 100)), 6) AS pitch, round(coalesce(avg((exp(-abs(gap) / 100) + exp(-abs(log2(ratio)) / 2)) / 2), 1), 6) AS coherence, round(max(s + d) / 1000, 3) AS total_s FROM y GROUP BY 1""")
def _(spark, sf):
    ms = F.col("t") / 1000
    x = ev(spark, sf).select("*", ms.alias("note_start"), (ms - F.col("value")).alias("start"), (F.col("value") * 2).alias("duration"), (F.col("value") + 50).alias("hz"), F.lit(440.0).alias("note_hz"))
    got = tm.integration_quality(x, K, O)
    return rnd(got.select("user_id", "onset", "pitch", "coherence", F.round(F.col("total_ms") / 1000, 3).alias("total_s")), "onset", "pitch", "coherence")


@query("arr21_pitch_curve", f"""WITH {_LI} SELECT l_orderkey, l_linenumber, round((q + 200) * pow(2, (form - 2) / 12) * (1 + sin(2 * pi() * 5 * c / 1000) * (form * 25) / 127 * 0.05), 5) AS hz FROM li""")
def _(spark, sf):
    hz = tm.pitch_curve(F.col("offset") + 200, F.col("form") - 2, F.col("form") * 25, F.col("consonant"))
    return _entries(spark, sf).select("l_orderkey", "l_linenumber", F.round(hz, 5).alias("hz"))


@query("arr22_controls", """SELECT l_orderkey, l_linenumber, round(l_partkey % 128 / 127, 6) AS vibrato_depth, round(CASE WHEN l_suppkey % 128 = 0 THEN 1 ELSE l_suppkey % 128 / 127 END, 6) AS dynamics, round(CASE WHEN l_orderkey % 128 = 0 THEN 0.5 ELSE l_orderkey % 128 / 127 END, 6) AS brightness, round(3 + 4 * (l_linenumber / 127), 6) AS vibrato_rate FROM lineitem""")
def _(spark, sf):
    c = tm.controls(*(F.col(x) % 128 for x in ("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")))
    return rnd(tb(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(v.alias(k) for k, v in c.items())), *c)


@query("ag21_label_statistics", f"""WITH {EV}, l AS (SELECT user_id, t / 1000.0 AS s, t / 1000.0 + value AS e, 'x-' || event_id || '+' || event_type || '+/A:' AS label FROM ev) SELECT user_id, count(*) AS entries, round(sum(e - s), 2) AS total_ms, round(avg(e - s), 4) AS mean_ms, round(min(e - s), 4) AS least_ms, round(max(e - s), 4) AS most_ms, array_to_string(list_sort(list(DISTINCT regexp_extract(label, '\\+([^+]+)\\+', 1))), ',') AS phonemes FROM l GROUP BY 1""")
def _(spark, sf):
    ms = F.col("t") / 1000
    x = ev(spark, sf).select("user_id", ms.alias("s"), (ms + F.col("value")).alias("e"), F.concat(F.lit("x-"), F.col("event_id").cast("string"), F.lit("+"), "event_type", F.lit("+/A:")).alias("label"))
    g = tm.label_statistics(x, K, "s", "e", "label")
    return g.select("user_id", "entries", F.round("total_ms", 2).alias("total_ms"), *(F.round(c, 4).alias(c) for c in ("mean_ms", "least_ms", "most_ms")), F.array_join("phonemes", ",").alias("phonemes"))


@query("ag22_label_quality", f"""WITH {EV}, l AS (SELECT user_id, event_id, t, t / 1000.0 AS s, t / 1000.0 + value AS e, CASE WHEN event_type = 'view' THEN '/A:' ELSE event_type END AS label FROM ev), g AS (SELECT *, abs(s - lag(e) OVER {WD}) > 1 AS gap FROM l) SELECT user_id, round(pow(0.9, count(*) FILTER (WHERE gap)), 6) AS accuracy, round(avg(CASE WHEN contains(label, '/') THEN 1 ELSE 0 END), 6) AS consistency, round((pow(0.9, count(*) FILTER (WHERE gap)) + avg(CASE WHEN contains(label, '/') THEN 1 ELSE 0 END) + 0.8) / 3, 6) AS overall FROM g GROUP BY 1""")
def _(spark, sf):
    ms = F.col("t") / 1000
    x = ev(spark, sf).select("*", ms.alias("s"), (ms + F.col("value")).alias("e"), F.when(F.col("event_type") == "view", "/A:").otherwise(F.col("event_type")).alias("label"))
    return rnd(tm.label_quality(x, K, O, "s", "e", "label"), "accuracy", "consistency", "overall")


# The files of banks: a folder for each order, a file for each of its line items, some of them not audio, some below skipped folders.
_FILES = """f AS (SELECT 'root/' || CASE WHEN l_orderkey % 9 = 0 THEN 'temp/' WHEN l_orderkey % 10 = 0 THEN '.hid/' ELSE '' END || 'b' || (l_orderkey // 3) AS folder,
CASE WHEN l_partkey % 7 = 0 THEN 'oto.ini' WHEN l_partkey % 7 = 1 THEN 'character.txt' WHEN l_partkey % 7 = 2 THEN 'README.md' WHEN l_partkey % 7 = 3 THEN 'a' || l_suppkey || '.WAV' WHEN l_partkey % 7 = 4 THEN 'desktop.ini' ELSE 'a' || l_suppkey || '.flac' END AS file, CAST(l_quantity AS BIGINT) AS length, l_linenumber FROM lineitem),
k AS (SELECT *, regexp_matches(file, '(?i)\\.(wav|flac)$') AS audio FROM f)"""


def _files(spark, sf):
    o, p = F.col("l_orderkey"), F.col("l_partkey") % 7
    up = F.concat(F.lit("root/"), F.when(o % 9 == 0, "temp/").when(o % 10 == 0, ".hid/").otherwise(""), F.lit("b"), F.floor(o / 3).cast("long").cast("string"))
    audio = lambda end: F.concat(F.lit("a"), F.col("l_suppkey").cast("string"), F.lit(end))
    file = F.when(p == 0, "oto.ini").when(p == 1, "character.txt").when(p == 2, "README.md").when(p == 3, audio(".WAV")).when(p == 4, "desktop.ini").otherwise(audio(".flac"))
    return tb(spark, sf, "lineitem").select(F.concat(up, F.lit("/"), file).alias("path"), F.col("l_quantity").cast("long").alias("length"), "l_linenumber", "l_suppkey")


@query("src01_discovered", f"""WITH {_FILES} SELECT folder, count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER (WHERE audio) AS audio, bool_or(file = 'character.txt') AS has_character, bool_or(file = 'README.md') AS has_readme FROM k WHERE folder NOT LIKE '%/temp/%' AND folder NOT LIKE '%/.hid/%' AND file <> 'desktop.ini' GROUP BY 1 HAVING bool_or(file = 'oto.ini') AND count(*) FILTER (WHERE audio) > 0""")
def _(spark, sf):
    return banks.discovered(_files(spark, sf)).drop("has_ini", "is_bank")


@query("src03_candidates", f"""WITH {_FILES} SELECT folder, bool_or(file = 'oto.ini') AND count(*) FILTER (WHERE audio) > 0 AS is_bank FROM k GROUP BY 1""")
def _(spark, sf):
    return banks.folders(_files(spark, sf)).select("folder", "is_bank")


@query("src04_audio", f"""WITH {_FILES} SELECT folder || '/' || file AS path, lower(regexp_extract(file, '\\.[^.]*$')) AS extension FROM k WHERE audio""")
def _(spark, sf):
    return _files(spark, sf).where(banks.is_audio(F.col("path"))).select("path", banks.extension(F.col("path")).alias("extension"))


@query("ag06_extensions", f"""WITH {_FILES} SELECT lower(regexp_extract(file, '\\.[^.]*$')) AS extension, count(*) AS n FROM k WHERE audio GROUP BY 1""")
def _(spark, sf):
    return banks.extensions(_files(spark, sf))


@query("ag07_tree_totals", f"""WITH {_FILES} SELECT count(*) AS files, CAST(sum(length) AS BIGINT) AS bytes, count(*) FILTER (WHERE audio) AS audio FROM k""")
def _(spark, sf):
    return banks.folders(_files(spark, sf)).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"), F.sum("audio").alias("audio"))


@query("flt22_skipped", f"""WITH {_FILES} SELECT folder || '/' || file AS path, folder LIKE '%/temp/%' OR folder LIKE '%/.hid/%' OR file = 'desktop.ini' AS skipped FROM k""")
def _(spark, sf):
    return _files(spark, sf).select("path", banks.skipped(F.col("path")).alias("skipped"))


_REF = f"""{_FILES}, e AS (SELECT folder, 'a' || (length % 12) || '.flac' AS filename, 'al' || (length % 9) AS alias FROM k WHERE l_linenumber < 4),
h AS (SELECT DISTINCT folder, file, audio FROM k), n AS (SELECT DISTINCT folder, filename FROM e),
ref AS (SELECT folder, count(*) AS referenced, count(*) FILTER (WHERE h.file IS NULL) AS missing FROM n LEFT JOIN h ON h.folder = n.folder AND h.file = n.filename GROUP BY ALL),
ref2 AS (SELECT n.folder, count(*) AS referenced, count(*) FILTER (WHERE h.file IS NULL) AS missing FROM n LEFT JOIN h ON h.folder = n.folder AND h.file = n.filename GROUP BY 1),
orp AS (SELECT h.folder, count(*) AS orphaned FROM h LEFT JOIN n ON h.folder = n.folder AND h.file = n.filename WHERE h.audio AND n.filename IS NULL GROUP BY 1),
dup AS (SELECT folder, sum(c) AS entries, count(*) FILTER (WHERE c > 1) AS duplicate_aliases FROM (SELECT folder, alias, count(*) AS c FROM e GROUP BY ALL) GROUP BY 1),
val AS (SELECT k.folder, bool_or(file = 'oto.ini') AS has_ini, count(*) FILTER (WHERE audio) AS audio FROM k GROUP BY 1),
al AS (SELECT val.*, coalesce(entries, 0) AS entries, coalesce(duplicate_aliases, 0) AS dups, coalesce(referenced, 0) AS referenced, coalesce(missing, 0) AS missing, coalesce(orphaned, 0) AS orphaned, has_ini AND audio > 0 AND coalesce(missing, 0) = 0 AS is_valid FROM val LEFT JOIN dup USING (folder) LEFT JOIN ref2 USING (folder) LEFT JOIN orp USING (folder))""".replace("""ref AS (SELECT folder, count(*) AS referenced, count(*) FILTER (WHERE h.file IS NULL) AS missing FROM n LEFT JOIN h ON h.folder = n.folder AND h.file = n.filename GROUP BY ALL),
""", "")


def _validated(spark, sf):
    files = _files(spark, sf)
    path, n = F.col("path"), F.col("length")
    entries = files.where("l_linenumber < 4").select(banks.folder(path).alias("folder"), F.concat(F.lit("a"), (n % 12).cast("string"), F.lit(".flac")).alias("filename"), F.concat(F.lit("al"), (n % 9).cast("string")).alias("alias"))
    return banks.validation(files, entries)


@query("ag04_validation", f"""WITH {_REF} SELECT folder, CAST(entries AS BIGINT) AS entries, dups AS duplicate_aliases, referenced, missing, orphaned, is_valid, CASE WHEN is_valid THEN '' ELSE concat_ws('|', CASE WHEN NOT has_ini THEN 'no timing file: list the samples and their times' END, CASE WHEN audio = 0 THEN 'no audio: put the samples into the folder' END, CASE WHEN missing > 0 THEN 'samples that are listed but absent: ' || missing END, CASE WHEN dups > 0 THEN 'aliases given more than once: ' || dups END) END AS suggestions FROM al""")
def _(spark, sf):
    return _validated(spark, sf).select("folder", "entries", "duplicate_aliases", "referenced", "missing", "orphaned", "is_valid", F.array_join("suggestions", "|").alias("suggestions"))


@query("ag05_summary", f"""WITH {_REF} SELECT count(*) FILTER (WHERE is_valid) AS valid, count(*) FILTER (WHERE NOT is_valid AND (has_ini OR audio > 0)) AS partial, count(*) FILTER (WHERE NOT is_valid AND NOT has_ini AND audio = 0) AS invalid FROM al""")
def _(spark, sf):
    return banks.summary(_validated(spark, sf))


@query("sup04_structure_issues", f"""WITH {_FILES}, v AS (SELECT folder, bool_or(file = 'oto.ini') AS i, count(*) FILTER (WHERE audio) AS a, bool_or(file = 'character.txt') AS c FROM k GROUP BY 1) SELECT folder, 'error' AS severity, 'missing oto.ini' AS issue FROM v WHERE NOT i UNION ALL SELECT folder, 'critical', 'no audio files' FROM v WHERE a = 0 UNION ALL SELECT folder, 'warning', 'missing character.txt' FROM v WHERE NOT c""")
def _(spark, sf):
    return banks.structure_issues(banks.folders(_files(spark, sf)))


@query("sup02_audio_guess", """SELECT l_orderkey, l_linenumber, CASE WHEN r < 50 THEN 0.3e0 WHEN r > 200 THEN 0.7e0 ELSE 0.5e0 END AS level, CASE WHEN r < 50 THEN 30e0 WHEN r > 200 THEN 60e0 ELSE 45e0 END AS noise_db, r > 200 AS clipping FROM (SELECT *, l_extendedprice / l_quantity / 8 AS r FROM lineitem)""")
def _(spark, sf):
    x = tb(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", banks.audio_guess(F.col("l_extendedprice") / 8, F.col("l_quantity")).alias("g"))
    return x.select("l_orderkey", "l_linenumber", "g.level", "g.noise_db", "g.clipping")


@query("ag03_phonemes", f"""WITH {_LI} SELECT DISTINCT alias FROM en""")
def _(spark, sf):
    return banks.phonemes(_entries(spark, sf))


# Reports: a benchmark for each type of event, a run for each event.
@query("fn_m12_regression", """WITH b AS (SELECT event_type, avg(value) AS m FROM events GROUP BY 1), p AS (SELECT event_id, (value - m) * 100 / m AS change FROM events JOIN b USING (event_type)) SELECT event_id, round(change, 6) AS change, CASE WHEN change > 50 THEN 'critical' WHEN change > 25 THEN 'high' WHEN change > 15 THEN 'medium' ELSE 'low' END AS severity FROM p""")
def _(spark, sf):
    e = tb(spark, sf, "events")
    x = e.join(e.groupBy("event_type").agg(F.avg("value").alias("m")), "event_type")
    change, severity = reports.regression(F.col("value"), F.col("m"))
    return rnd(x.select("event_id", change.alias("change"), severity.alias("severity")), "change")


@query("ag42_level", """SELECT l_orderkey, l_linenumber, CASE WHEN d < 4 AND r < 15 AND c > 0.9 THEN 'EXCELLENT' WHEN d < 6 AND r < 25 AND c > 0.8 THEN 'GOOD' WHEN d < 8 AND r < 35 AND c > 0.7 THEN 'FAIR' ELSE 'POOR' END AS level, round(0.4 * (1 - d / 10) + 0.3 * (1 - r / 50) + 0.3 * c, 6) AS composite FROM (SELECT l_orderkey, l_linenumber, l_linenumber * 1.3 AS d, l_quantity AS r, 1 - l_discount * 3 AS c FROM lineitem)""")
def _(spark, sf):
    m = (F.col("l_linenumber") * 1.3, F.col("l_quantity"), 1 - F.col("l_discount") * 3)
    return rnd(tb(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", reports.level(*m).alias("level"), reports.composite(*m).alias("composite")), "composite")


@query("ag48_benchmark", """SELECT event_type, count(value) AS n, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS deviation, round(median(value), 6) AS median, round(greatest(0, 1 - stddev_samp(value) / avg(value)), 6) AS score FROM events GROUP BY 1""")
def _(spark, sf):
    return rnd(reports.benchmark(tb(spark, sf, "events"), ["event_type"], "value"), "mean", "deviation", "median", "score")


@query("ag49_threads", """WITH t AS (SELECT l_suppkey, l_linenumber AS n, avg(l_extendedprice / l_linenumber) AS t FROM lineitem GROUP BY ALL) SELECT l_suppkey, round(coalesce(max(t) FILTER (WHERE n = 1) / min(t * n) FILTER (WHERE n > 1), 0), 6) AS efficiency, arg_min(n, (t, n)) AS best_threads FROM t GROUP BY 1""")
def _(spark, sf):
    x = tb(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", (F.col("l_extendedprice") / F.col("l_linenumber")).alias("time"))
    return rnd(reports.thread_efficiency(x, ["l_suppkey"], "l_linenumber", "time"), "efficiency")


@query("ag50_wins_and_means", """WITH p AS (SELECT avg(value) FILTER (WHERE event_type = 'click') AS a, avg(value) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY user_id), q AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL) SELECT count(*) FILTER (WHERE a - b > 5) AS wins_a, count(*) FILTER (WHERE b - a > 5) AS wins_b, count(*) FILTER (WHERE abs(a - b) <= 5) AS ties, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, count(*) AS n, round(100.0 * count(*) FILTER (WHERE a - b > 5) / count(*), 6) AS percent_wins_a, round(100.0 * count(*) FILTER (WHERE b - a > 5) / count(*), 6) AS percent_wins_b, round(100.0 * count(*) FILTER (WHERE abs(a - b) <= 5) / count(*), 6) AS percent_ties FROM q""")
def _(spark, sf):
    p = tb(spark, sf, "events").groupBy("user_id").agg(*(st.exact_mean(F.when(F.col("event_type") == k, F.col("value"))).alias(n) for k, n in (("click", "a"), ("view", "b"))))
    return rnd(reports.wins(p, "a", "b", 5.0), "mean_a", "mean_b", "percent_wins_a", "percent_wins_b", "percent_ties")


@query("ag51_pass_rates", """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 20) AS passed, round(avg(CASE WHEN value > 20 THEN 1 ELSE 0 END), 6) AS rate, round(avg(value), 6) AS mean_score, round(avg(value) FILTER (WHERE value > 20), 6) AS mean_passed FROM events GROUP BY 1""")
def _(spark, sf):
    return rnd(reports.pass_rates(tb(spark, sf, "events"), ["event_type"], F.col("value") > 20, "value"), "rate", "mean_score", "mean_passed")


@query("ag52_jobs", """SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag <> 'R') AS completed, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, round(coalesce(sum(l_quantity) FILTER (WHERE l_returnflag <> 'R'), 0), 2) AS bytes, round(avg(l_tax) FILTER (WHERE l_returnflag <> 'R'), 6) AS mean_ms, round(coalesce((20000 - count(*)) * avg(l_tax) FILTER (WHERE l_returnflag <> 'R'), 0), 4) AS remaining_ms FROM lineitem GROUP BY 1""")
def _(spark, sf):
    x = reports.jobs(tb(spark, sf, "lineitem"), ["l_suppkey"], F.col("l_returnflag") != "R", "l_tax", "l_quantity", 20_000)
    return x.select("l_suppkey", "completed", "failed", F.round("bytes", 2).alias("bytes"), F.round("mean_ms", 6).alias("mean_ms"), F.round("remaining_ms", 4).alias("remaining_ms"))


@query("ag53_history", f"""WITH {EV}, r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY t DESC, event_id DESC) AS r FROM ev) SELECT user_id, round(avg(value), 6) AS mean, max(value) AS peak FROM r WHERE r <= 10 GROUP BY 1""")
def _(spark, sf):
    return rnd(reports.history(ev(spark, sf), K, O, "value", 10), "mean")


@query("ag55_error_counts", """SELECT 'severity' AS dimension, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'category', o_orderstatus, count(*) FROM orders GROUP BY 2""")
def _(spark, sf):
    return reports.error_counts(tb(spark, sf, "orders"), "o_orderpriority", "o_orderstatus")


@query("ag56_baselines", """WITH l AS (SELECT max(CAST(ts AS DATE)) AS d FROM events) SELECT event_type, user_id % 4 AS platform, count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS deviation, min(value) AS least, max(value) AS most FROM events, l WHERE CAST(ts AS DATE) > d - 20 AND CAST(ts AS DATE) <= d GROUP BY 1, 2 HAVING count(value) >= 10""")
def _(spark, sf):
    e = tb(spark, sf, "events").select("event_type", (F.col("user_id") % 4).alias("platform"), F.to_date("ts").alias("day"), "value")
    last = e.agg(F.max("day")).first()[0]
    return rnd(reports.baselines(e, ["event_type", "platform"], "day", "value", F.lit(last), 20, 10), "mean", "deviation")


@query("ag56_trend", """SELECT event_type, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(value) AS n FROM events GROUP BY 1, 2""")
def _(spark, sf):
    return rnd(reports.trend(tb(spark, sf, "events"), ["event_type"], F.col("ts"), "value").withColumn("day", F.col("day").cast("string")), "mean")


@query("sup23_deviation", """WITH p AS (SELECT a.vec_id, CAST(unnest(a.embedding) AS DOUBLE) AS x, CAST(unnest(b.embedding) AS DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(avg(abs((x - y) / x)) FILTER (WHERE x <> 0), 4) AS deviation FROM p GROUP BY 1""")
def _(spark, sf):
    e = tb(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    x = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    return x.select("vec_id", F.round(reports.deviation(F.col("e"), F.col("f")), 4).alias("deviation"))


@query("sup18_cpu", """SELECT event_type, round(least(1, avg(value) / 40), 6) AS cpu FROM events GROUP BY 1""")
def _(spark, sf):
    m = tb(spark, sf, "events").groupBy("event_type").agg(F.avg("value").alias("m"))
    return rnd(m.select("event_type", reports.cpu_estimate(F.col("m"), F.lit(40.0)).alias("cpu")), "cpu")


# Scalar functions.
@query("fn_m01_notes", """SELECT event_id, CASE WHEN value <= 0 THEN 0 ELSE CAST(greatest(0, least(127, floor(69 + 12 * log2(value * 10 / 440) + 0.5))) AS INT) END AS note, round(CASE WHEN value > 0 THEN 1200 * log2(value * 10 / 440) END, 5) AS cents, round(60000000 / nullif(value, 0), 4) AS quarter_us, round((event_id % 16384 - 8192) / 8192 * 2, 6) AS bend FROM events""")
def _(spark, sf):
    hz = F.col("value") * 10
    x = tb(spark, sf, "events").select("event_id", scalars.note(hz).alias("note"), F.round(scalars.cents(hz), 5).alias("cents"), F.round(scalars.quarter_us(F.col("value")), 4).alias("quarter_us"), F.round(scalars.bend(F.col("event_id") % 16384 - 8192), 6).alias("bend"))
    return x


@query("fn_m05_normalised", """WITH s AS (SELECT event_type, avg(value) AS m, stddev_pop(value) AS d, min(value) AS a, max(value) AS b FROM events GROUP BY 1) SELECT event_id, round((value - m) / d, 6) AS z, round((value - a) / (b - a), 6) AS unit, round(value, 6) AS back, round(ln(greatest(value, 1e-8) + 1), 6) AS log, round(value / 4800, 8) AS cents_unit, 0.0 AS flat FROM events JOIN s USING (event_type)""")
def _(spark, sf):
    e = tb(spark, sf, "events")
    s = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("d"), F.min("value").alias("a"), F.max("value").alias("b"))
    v, m, d, a, b = (F.col(c) for c in ("value", "m", "d", "a", "b"))
    z, u = scalars.z_score(v, m, d), scalars.min_max(v, a, b)
    back = (scalars.from_z_score(z, m, d) + scalars.from_min_max(u, a, b)) / 2
    return e.join(s, "event_type").select("event_id", F.round(z, 6).alias("z"), F.round(u, 6).alias("unit"), F.round(back, 6).alias("back"), F.round(scalars.log_scale(v), 6).alias("log"), F.round(scalars.cents_unit(v), 8).alias("cents_unit"), (scalars.z_score(v, m, F.lit(0.0)) + scalars.min_max(v, a, a)).alias("flat"))


@query("fn_m05_robust", """WITH s AS (SELECT event_type, median(value) AS m, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1) SELECT event_id, round((value - m) / (b - a), 6) AS robust FROM events JOIN s USING (event_type)""")
def _(spark, sf):
    e = tb(spark, sf, "events")
    s = e.groupBy("event_type").agg(F.percentile("value", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75))).alias("p"))
    return e.join(s, "event_type").select("event_id", F.round(scalars.robust(F.col("value"), F.col("p")[0], F.col("p")[1], F.col("p")[2]), 6).alias("robust"))


@query("fn_m08_distance", """WITH p AS (SELECT a.vec_id, CAST(unnest(a.embedding) AS DOUBLE) AS x, CAST(unnest(b.embedding) AS DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT vec_id, round(sqrt(sum((x - y) * (x - y))), 5) AS distance FROM p GROUP BY 1""")
def _(spark, sf):
    e = tb(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("e"))
    x = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    return x.select("vec_id", F.round(scalars.distance(F.col("e"), F.col("f")), 5).alias("distance"))


@query("fn_m11_relative", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 2 THEN 0 WHEN l_linenumber >= 5 THEN 1 ELSE round((l_linenumber - 2) / 3, 6) END AS place FROM lineitem""")
def _(spark, sf):
    return rnd(tb(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalars.relative(F.col("l_linenumber"), F.lit(2), F.lit(5)).alias("place")), "place")


@query("fn_s15_cache_key", f"""WITH {EV}, w AS (SELECT event_id, row_number() OVER {WD} - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n, list(event_type) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS a FROM ev) SELECT event_id, 'idx:' || i || '_size:' || n || '_' || array_to_string(a, '_') AS key FROM w""")
def _(spark, sf):
    w = seq.over(K, O)
    x = ev(spark, sf).select("event_id", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(*K)).alias("n"), F.collect_list("event_type").over(w.rowsBetween(-2, 2)).alias("a"))
    return x.select("event_id", scalars.cache_key(F.col("i"), F.col("n"), F.col("a")).alias("key"))


@query("fn_s16_hash", None)
def _(spark, sf):
    return tb(spark, sf, "documents").select("doc_id", scalars.hash32(F.col("text")).alias("hash"))


@query("fn_s07_scripts", """WITH x AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN chr(12353 + CAST(event_id % 90 AS INT)) WHEN 2 THEN upper(event_type) ELSE chr(12353 + CAST(event_id % 80 AS INT)) || event_type END AS s FROM events)
SELECT event_id, regexp_full_match(s, '[a-z]+') AS romaji, length(s) = 1 AND unicode(s) BETWEEN 12353 AND 12438 AS hiragana FROM x""")
def _(spark, sf):
    """Letters, kana (and signs just beyond them), capitals, and both together."""
    kind, kana = F.col("event_id") % 4, lambda n: F.decode(F.unhex(F.lpad(F.hex(12353 + F.col("event_id") % n), 8, "0")), "UTF-32")
    s = F.when(kind == 0, F.col("event_type")).when(kind == 1, kana(90)).when(kind == 2, F.upper("event_type")).otherwise(F.concat(kana(80), "event_type"))
    return tb(spark, sf, "events").select("event_id", phonemes.is_romaji(s).alias("romaji"), phonemes.is_hiragana(s).alias("hiragana"))


@query("fn_d01_iso", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events""")
def _(spark, sf):
    iso = scalars.iso_time(F.col("ts").cast("timestamp"))
    return tb(spark, sf, "events").select("event_id", iso.alias("iso"), F.unix_seconds(scalars.from_iso_time(iso).cast("timestamp")).alias("seconds"))


@query("fn_d03_days", """WITH l AS (SELECT max(ts) AS m FROM events) SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, ts >= m - INTERVAL 7 DAY AS recent, CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR) AS month, CAST(CAST(ts + INTERVAL 40 DAY AS DATE) AS VARCHAR) AS later, dayofyear(ts) AS n FROM events, l""")
def _(spark, sf):
    e = tb(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = F.lit(e.agg(F.max("ts")).first()[0])
    ts = F.col("ts")
    return e.select("event_id", F.to_date(ts).cast("string").alias("day"), scalars.within_days(ts, last, 7).alias("recent"), F.to_date(F.date_trunc("month", ts)).cast("string").alias("month"), F.date_add(F.to_date(ts), 40).cast("string").alias("later"), F.dayofyear(ts).alias("n"))


@query("flt11_voiced", """SELECT event_id, value > 50 AS voiced FROM events""")
def _(spark, sf):
    return tb(spark, sf, "events").select("event_id", scalars.voiced(F.col("value")).alias("voiced"))


@query("flt12_quality_gate", """SELECT l_orderkey, l_linenumber, concat_ws('; ', CASE WHEN l_linenumber * 0.5 >= 2 THEN 'high spectral distortion' END, CASE WHEN 1 - l_discount * 4 <= 0.7 THEN 'poor pitch continuity' END, CASE WHEN l_quantity / 20 <= 0.5 OR l_quantity / 20 >= 2 THEN 'range out of bounds' END) AS issues FROM lineitem""")
def _(spark, sf):
    _, issues = scalars.quality_gate(F.col("l_linenumber") * 0.5, 1 - F.col("l_discount") * 4, F.col("l_quantity") / 20)
    return tb(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", issues.alias("issues"))


@query("prj19_acoustic", """WITH i AS (SELECT unnest(range(0, 6)) AS i) SELECT vec_id, CAST(i AS INT) AS i, round(sin(0.5 * label + 0.1 * i) + (label + 100) * 0.001, 6) AS x FROM embeddings, i""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("vec_id", F.posexplode(scalars.acoustic(F.col("label"), F.col("label") + 100, 6)).alias("i", "x"))
    return rnd(x, "x")


@query("prj21_merged", f"""WITH {_DIMS} SELECT vec_id, CAST(dim AS INT) AS i, round(abs(x) * exp(0.1 * x), 5) AS x FROM dims""")
def _(spark, sf):
    e = F.transform("embedding", lambda v: v.cast("double"))
    x = tb(spark, sf, "embeddings").select("vec_id", F.posexplode(scalars.merged(F.transform(e, F.abs), e)).alias("i", "x"))
    return x.withColumn("x", F.round("x", 5))


@query("win22_anti_aliased", """WITH RECURSIVE e AS (SELECT vec_id, [CAST(v AS DOUBLE) FOR v IN embedding] AS a FROM embeddings), r AS (SELECT vec_id, a, 1 AS i, a[1] AS x FROM e UNION ALL SELECT vec_id, a, i + 1, CASE WHEN i + 1 = len(a) THEN a[i + 1] ELSE 0.8 * (0.25 * x + 0.5 * a[i + 1] + 0.25 * a[i + 2]) + 0.2 * a[i + 1] END FROM r WHERE i < len(a)) SELECT vec_id, CAST(i - 1 AS INT) AS i, round(x, 5) AS x FROM r""")
def _(spark, sf):
    e = F.transform("embedding", lambda v: v.cast("double"))
    x = tb(spark, sf, "embeddings").select("vec_id", e.alias("e")).select("vec_id", F.posexplode(scalars.anti_aliased(F.col("e"))).alias("i", "x"))
    return x.withColumn("x", F.round("x", 5))


@query("sup08_weights", f"""WITH {_DIMS}, s AS (SELECT vec_id, sum(abs(x)) AS s FROM dims GROUP BY 1) SELECT vec_id, CAST(dim AS INT) AS i, round(abs(x) / s, 6) AS w FROM dims JOIN s USING (vec_id)""")
def _(spark, sf):
    e = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    return rnd(tb(spark, sf, "embeddings").select("vec_id", F.posexplode(scalars.weights(e)).alias("i", "w")), "w")


@query("fn_m17_zlib", """SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents""")
def _(spark, sf):
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return tb(spark, sf, "documents").select("doc_id", F.sha2(scalars.inflated(scalars.deflated(raw)), 256).alias("digest"))


@query("win02_positions", f"""WITH {EV} SELECT event_id, coalesce(lag(value, 2) OVER w, 0) AS l2, coalesce(lag(value, 1) OVER w, 0) AS l1, coalesce(lead(value, 1) OVER w, 0) AS r1, coalesce(lead(value, 2) OVER w, 0) AS r2 FROM ev WINDOW w AS {WD}""")
def _(spark, sf):
    return seq.number_context(ev(spark, sf), K, O, "value", 2).select("event_id", "l2", "l1", "r1", "r2")


@query("ag26_vector_normaliser", f"""WITH {_DIMS} SELECT CAST(dim AS INT) AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS deviation, round(min(x), 6) AS least, round(max(x), 6) AS most, round(list_sort(list(x))[CAST(count(*) // 4 AS INT) + 1], 6) AS q25, round(list_sort(list(x))[CAST(count(*) // 2 AS INT) + 1], 6) AS q50, round(list_sort(list(x))[CAST(3 * count(*) // 4 AS INT) + 1], 6) AS q75 FROM dims GROUP BY 1""")
def _(spark, sf):
    return rnd(seq.ranked_normaliser(_dims(spark, sf).select("dim", "x"), ["dim"], "x"), "mean", "deviation", "least", "most", "q25", "q50", "q75")


@query("ag24_feature_quality", """SELECT event_type, round(least(1, greatest(0, (avg(CASE WHEN value BETWEEN 1 AND 90 THEN 1 ELSE 0 END) + avg(value / 100)) / 2)), 6) AS quality FROM events GROUP BY 1""")
def _(spark, sf):
    x = rules.feature_quality(tb(spark, sf, "events"), ["event_type"], F.col("value").between(1, 90), F.col("value") / 100)
    return rnd(x, "quality")


@query("ag33_safe_variance", """SELECT user_id, round(greatest(coalesce(var_pop(value), 1e-6), 1e-6), 5) AS variance FROM events GROUP BY 1""")
def _(spark, sf):
    x = tb(spark, sf, "events").groupBy("user_id").agg(rules.safe_variance("value").alias("variance"))
    return x.withColumn("variance", F.round("variance", 5))


@query("set05_intersect", """SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders""")
def _(spark, sf):
    return tb(spark, sf, "customer").select(F.col("c_custkey").alias("k")).intersect(tb(spark, sf, "orders").select(F.col("o_custkey")))


@query("srt02_tempo_order", f"""WITH {EV} SELECT event_id, CAST(row_number() OVER {WD} AS INT) AS i FROM ev""")
def _(spark, sf):
    return ev(spark, sf).select("event_id", F.row_number().over(seq.over(K, O)).alias("i"))


@query("arr10_gaussian", """SELECT vec_id, CAST(i AS INT) AS i, round(x * exp(-0.5 * pow((i - 31.5) / (64 / 6.0), 2)), 5) AS x FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)""")
def _(spark, sf):
    x = tb(spark, sf, "embeddings").select("vec_id", F.posexplode(F.zip_with("embedding", signal.window("gaussian", 64), lambda v, w: v.cast("double") * w)).alias("i", "x"))
    return x.withColumn("x", F.round("x", 5))
