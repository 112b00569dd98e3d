"""Benchmark decontamination: a prefix-filtered join of benchmark windows with document word shingles, built-in functions only.

A window is ``width`` consecutive words of an item (a shorter item is one window); it must occur whole, so its containment threshold is
all of its shingles and one prefix shingle, the rarest, is enough. Shingles are hashes of up to five words.

1. Every document position's shingle hash is joined with those of the benchmark; what matches is kept as (document, position, hash).
2. Document frequencies of the matches, over all documents, order each window's shingles by rarity; its first is its prefix.
3. Matches of a prefix are candidates (document, start, window); a start before the first word or an end past the last is pruned.
4. Candidates, gathered by document (bounded by its words), meet the document once more, and the words themselves are compared.

What stems from the benchmark is broadcast, table by table, only within bounds on rows and bytes; beyond them the joins shuffle by hash
and AQE splits hot hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import ascii_lower, fits, free_name, materialise, maybe_broadcast, release

WIDTH = 10
SHINGLE = 5
BREAKS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) runs of digits, letters a to z and characters beyond ASCII; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAKS), "")


def shingles(words: str, size: int) -> Column:
    """One hash for each position at which ``size`` words begin."""
    parts = ", ".join(f"get({words}, i + {j})" if j else "one" for j in range(size))
    return F.expr(f"transform(slice({words}, 1, greatest(size({words}) - {size - 1}, 0)), (one, i) -> xxhash64({parts}))")


def _windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, wid, n, words): each distinct window of each item; wid is the digest of its words."""
    cut = F.expr(f"transform(sequence(0, greatest(size(w) - {width}, 0)), i -> slice(w, i + 1, {width}))")
    rows = items.withColumn("w", words_of(F.col("item_text"))).where("size(w) > 0").select("item_id", F.explode(cut).alias("words"))
    rows = rows.select("item_id", F.sha2(F.concat_ws(" ", "words"), 256).alias("wid"), F.size("words").alias("n"), "words")
    return rows.dropDuplicates(["item_id", "wid"])


def contaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_words, n_hit, items) for each row of docs: its words, the words inside any occurrence of a window, and the sorted ids
    (as strings) of the items that have one.

    Null and wordless texts have no words and no items; null items, items without words and items with a null id match nothing. Rows
    that repeat an id with its text each return the same figures; a null id counts as an id of its own. Long texts are taken whole.
    No column but the named ones is read, so clashing names do no harm."""
    return _keyed(docs, items, doc_id, text, item_id, item_text, width).drop("key")


def _keyed(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str = "item_id", item_text: str = "text", width: int = WIDTH) -> DataFrame:
    """The rows of ``contaminate`` with ``key``, the hash of their id and text."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    items = items.select(F.col(item_id).cast("string").alias("item_id"), F.col(item_text).alias("item_text")).where("item_id IS NOT NULL")
    of_item = materialise(_windows(items, width), "windows")
    windows = materialise(of_item.select("wid", "n", "words").dropDuplicates(["wid"]), "window")
    sizes = sorted(r.size for r in windows.select(F.least("n", F.lit(SHINGLE)).alias("size")).distinct().collect())  # at most SHINGLE of them
    hashed = [windows.where(F.least("n", F.lit(SHINGLE)) == s).select("wid", "n", F.posexplode(shingles("words", s)).alias("off", "h")) for s in sizes]
    tokens = materialise(_all(hashed, spark, "wid string, n int, off int, h long"), "tokens")
    small = fits(tokens)
    of_tokens = lambda df: F.broadcast(df) if small else df  # tables with a row for each shingle or window at most

    split = base.select(F.xxhash64("id", "text").alias("key"), words_of(F.col("text")).alias("w"))
    positions = [split.select("key", F.size("w").alias("n_words"), F.posexplode(shingles("w", s)).alias("pos", "h")) for s in sizes]
    found = _all(positions, spark, "key long, n_words int, pos int, h long").join(of_tokens(tokens.select("h").distinct()), "h", "left_semi")
    found = materialise(found, "found")
    rarity = found.groupBy("h").agg(F.count("*").alias("df"))
    prefix = tokens.join(of_tokens(rarity), "h").groupBy("wid", "n").agg(F.min(F.struct("df", "h", "off")).alias("p"), F.count("*").alias("present"))
    # a window with a shingle that no document has occurs nowhere
    prefix = prefix.where(F.col("present") == F.expr(f"n - least(n, {SHINGLE}) + 1")).select("wid", "n", F.col("p.h").alias("h"), F.col("p.off").alias("off"))
    start = found.join(of_tokens(prefix), "h").select("key", "wid", (F.col("pos") - F.col("off")).alias("start"), "n", "n_words").where("start >= 0 AND start + n <= n_words")
    named = start.dropDuplicates(["key", "wid", "start"]).join(maybe_broadcast(windows.select("wid", "words")), "wid")
    gathered = named.groupBy("key").agg(F.collect_list(F.struct("start", "n", "wid", "words")).alias("c"))
    full = base.select("id", F.xxhash64("id", "text").alias("key"), "text").join(gathered, "key", "left").withColumn("w", words_of(F.col("text")))
    exact = F.expr("filter(c, x -> slice(w, x.start + 1, x.n) = x.words)")
    kept = full.select("id", "key", F.size("w").cast("long").alias("n_words"), exact.alias("c"))
    covered = F.expr("size(array_distinct(flatten(transform(c, x -> sequence(x.start, x.start + x.n - 1)))))")
    kept = materialise(kept.select("id", "key", "n_words", F.when(F.size("c") > 0, covered).otherwise(0).cast("long").alias("n_hit"), F.coalesce(F.expr("array_distinct(transform(c, x -> x.wid))"), F.expr("CAST(array() AS ARRAY<STRING>)")).alias("wids")), "hits")
    release(found)
    hit = kept.select("key", F.explode("wids").alias("wid")).distinct()
    per_doc = hit.join(maybe_broadcast(of_item.select("wid", "item_id")), "wid").groupBy("key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return kept.drop("wids").join(per_doc, "key", "left").select("key", "id", "n_words", "n_hit", F.coalesce("items", F.expr("CAST(array() AS ARRAY<STRING>)")).alias("items"))


def _all(parts: list[DataFrame], spark, schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The columns of ``op2_benchmark_decontamination``."""
    r = contaminate(docs, items)
    return r.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that hold an occurrence of a benchmark window, null ids among them; their columns and all other rows, also
    those that share an id with a dropped one, are as they were."""
    key, of = free_name("hit_key", docs), free_name("hit_id", docs)
    hit = _keyed(docs, items, doc_id, text).where("n_hit > 0").select(F.col("key").alias(key), F.col("id").alias(of)).distinct()
    hit = maybe_broadcast(materialise(hit, "hit"))
    return docs.join(hit, (F.xxhash64(F.col(doc_id), F.col(text)) == F.col(key)) & F.col(doc_id).eqNullSafe(F.col(of)), "left_anti")


#: The same by brute definition, for DuckDB.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + 10) AS win FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM iw),
pos AS (SELECT doc_id, n, i, list_slice(w, i + 1, i + n) AS win FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, n, i FROM pos JOIN iw USING (win)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM m)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
