"""A Merkle manifest of a dataset: a digest of every row, a tree of digests over each group, a tree over the groups, a proof for every row.

Ranks come from a radix trie, not from a sort: histograms of the leading digits of the keys give each digit's first rank, and only what still holds
too many keys is divided by further digits. A rank's digits in the base of the fan-out then name the nodes of the tree above it: ranks with
the same prefix meet in one bounded block, which is reduced by LEVELS levels at once, and blocks are the leaves of the next stage.

Odd rows: a null value is digested as ``-``, an empty text as ``0:``; a null order value comes first in its group, a null group first of the groups.
Equal order values follow by their digests and equal rows one after the other, each a leaf of its own. An empty table has no rows and no root.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.llm.shared import LOWER, UPPER, materialise, maybe_broadcast

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Children of a node, levels that one block covers, and so the leaves that meet in one block.
FANOUT, LEVELS = 8, 3
BLOCK = FANOUT**LEVELS
#: Hexadecimal digits of one level of the radix trie, and the keys under one prefix that are ranked at once.
DIGIT, BUCKET = 3, 1 << 16


def sha(x: Column) -> Column:
    return F.sha2(x, 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:``, and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: list[Column]) -> Column:
    return sha(F.concat(*(encoded(v) for v in values)))


def text_key(value: Column) -> Column:
    """Hexadecimal text that sorts as the value's UTF-8 bytes do; null is first."""
    return F.when(value.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.hex(value.cast("string").cast("binary"))))


def integer_key(value: Column) -> Column:
    """Seventeen hexadecimal digits that sort as the whole number does; null is first."""
    biased = value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.when(value.isNull(), F.lit("0" * 17)).otherwise(F.concat(F.lit("1"), F.lpad(F.hex(biased), 16, "0")))


def radix_ranks(rows: DataFrame, group: str, key: str, weight: str, bucket: int = BUCKET) -> DataFrame:
    """rows with ``rank``: the weights, added up, of the rows of the same group with smaller keys.

    Keys are hexadecimal text, distinct within a group. A level's histogram has at most 16 ** DIGIT digits (and one for keys that end
    there) below each prefix, so a window over them is bounded whatever a group holds; the keys of a prefix with at most ``bucket`` of them
    are ranked by a window, and the others go on to their next digits. What all keys begin with is skipped."""
    least, most = rows.agg(F.min(key), F.max(key)).first()
    if least is None:
        return rows.withColumn("rank", F.lit(0).cast("long"))
    level, done = len(os.path.commonprefix([least, most])), []
    open_ = rows.withColumn("_base", F.lit(0).cast("long"))
    below = lambda *of: Window.partitionBy(*of).orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    while open_ is not None:
        level += DIGIT
        digits = open_.groupBy(group, "_base", F.substring(key, 1, level).alias("_prefix")).agg(F.count("*").alias("_keys"), F.sum(weight).alias("_held"))
        digits = materialise(digits, "digits")
        before = F.coalesce(F.sum("_held").over(below(group, F.substring("_prefix", 1, level - DIGIT))), F.lit(0))
        bases = digits.withColumn("_order", F.col("_prefix")).select(group, "_prefix", "_keys", (F.col("_base") + before).alias("_base"))
        placed = open_.drop("_base").withColumn("_prefix", F.substring(key, 1, level)).join(maybe_broadcast(bases), [group, "_prefix"])
        done.append(placed.where(F.col("_keys") <= bucket))
        crowded = digits.agg(F.max("_keys")).first()[0] > bucket
        open_ = materialise(placed.where(F.col("_keys") > bucket).drop("_keys", "_prefix"), "crowded") if crowded else None
    placed = done[0]
    for more in done[1:]:
        placed = placed.unionByName(more)
    rank = F.col("_base") + F.coalesce(F.sum(weight).over(below(group, "_prefix")), F.lit(0))
    return placed.withColumn("_order", F.col(key)).withColumn("rank", rank).drop("_order", "_base", "_prefix", "_keys")


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def _parents(level: Column) -> Column:
    """The digest of every FANOUT consecutive nodes, the last of which may be fewer."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / FANOUT).cast("int")), lambda i: sha(_joined(F.slice(level, i * FANOUT + 1, FANOUT))))


def _siblings(level: Column) -> Column:
    """For each node, its place in its run and what the run's other nodes hold, from left to right."""

    def of(i: Column) -> Column:
        at = i % FANOUT
        return F.struct(at.alias("at"), F.concat(_joined(F.slice(level, i - at + 1, at)), _joined(F.slice(level, i + 2, F.lit(FANOUT - 1) - at))).alias("others"))

    return F.transform(F.sequence(F.lit(0), F.size(level) - 1), of)


def _depth(total: Column) -> Column:
    """Levels that a block of a group with so many nodes is reduced by."""
    depth = F.lit(LEVELS)
    for k in range(LEVELS - 1, -1, -1):
        depth = F.when(total <= FANOUT**k, F.lit(k)).otherwise(depth)
    return depth


def _levels(blocks: DataFrame) -> DataFrame:
    """blocks with their levels _l0 (the digests), _l1, ... and _depth."""
    out = blocks.withColumn("_l0", F.col("nodes.digest")).withColumn("_depth", _depth(F.col("total")))
    for k in range(LEVELS):
        out = out.withColumn(f"_l{k + 1}", _parents(F.col(f"_l{k}")))
    return out


def _blocks(nodes: DataFrame) -> DataFrame:
    """(group, block, total, nodes): ranks with the same prefix together, from (group, rank, copies, total, digest, row); one list a block, at most
    BLOCK long. A node of many copies is dealt to all the blocks that it covers."""
    covers = F.sequence(F.floor(F.col("rank") / BLOCK), F.floor((F.col("rank") + F.col("copies") - 1) / BLOCK))
    x = nodes.withColumn("block", F.explode(covers))
    first, after = F.greatest("rank", F.col("block") * BLOCK), F.least(F.col("rank") + F.col("copies"), (F.col("block") + 1) * BLOCK)
    one = F.struct((first % BLOCK).cast("int").alias("at"), (after - first).cast("int").alias("copies"), "digest", "row")
    x = x.groupBy("group", "block", "total").agg(F.sort_array(F.collect_list(one)).alias("nodes"))
    return x.withColumn("nodes", F.flatten(F.transform("nodes", lambda n: F.array_repeat(F.struct(n["digest"].alias("digest"), n["row"].alias("row")), n["copies"]))))


def _climbed(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The tables of blocks of each stage, and (group, digest) of what each group comes to."""
    stages = []
    while True:
        stages.append(materialise(_blocks(nodes), f"blocks-{len(stages)}"))
        x = _levels(stages[-1].select("group", "block", "total", F.transform("nodes", lambda n: F.struct(n["digest"].alias("digest"))).alias("nodes")))
        top = F.element_at(F.array(*(F.col(f"_l{k}")[0] for k in range(LEVELS + 1))), F.col("_depth") + 1)
        nodes = materialise(x.select(
            "group", F.col("block").alias("rank"), F.lit(1).alias("copies"), F.ceil(F.col("total") / BLOCK).alias("total"), top.alias("digest"), F.struct(F.lit(True).alias("inner")).alias("row"),
        ), f"tops-{len(stages)}")
        if (nodes.agg(F.max("total")).first()[0] or 1) == 1:
            return stages, nodes.select("group", "digest")


def _descended(stages: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """(group, rank, digest, row, proof, the seeds' other columns) of each leaf: a proof is its siblings at each level up to the group's digest, then what
    the seed of the group (group, proof, ...) has above it."""
    above, held = seeds.withColumn("block", F.lit(0).cast("long")), [c for c in seeds.columns if c not in ("group", "proof")]
    for stage in reversed(stages):
        x = _levels(stage.join(maybe_broadcast(above), ["group", "block"]))
        for k in range(LEVELS):
            x = x.withColumn(f"_s{k}", _siblings(F.col(f"_l{k}")))
        step = lambda n, i: F.struct(i.alias("at"), n["digest"].alias("digest"), n["row"].alias("row"), F.slice(F.array(*(F.col(f"_s{k}")[F.floor(i / FANOUT**k).cast("int")] for k in range(LEVELS))), 1, F.col("_depth")).alias("own"))
        x = x.select("group", "block", "proof", *held, F.explode(F.transform("nodes", step)).alias("n"))
        x = x.select("group", (F.col("block") * BLOCK + F.col("n.at")).alias("rank"), "n.digest", "n.row", F.concat("n.own", "proof").alias("proof"), *held)
        above = x.select("group", F.col("rank").alias("block"), "proof", *held)
    return x


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof come to."""
    return F.aggregate(proof, digest, lambda x, s: sha(F.concat(F.substr(s["others"], F.lit(1), s["at"] * 64), x, F.substr(s["others"], s["at"] * 64 + 1))))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, level by level."""
    return sha(F.array_join(F.transform(proof, lambda s: s["others"]), ""))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, group: str = "lang", order: str = "doc_id", changed: Column | None = None) -> DataFrame:
    """(order, rank, leaf, changed, proof, subroot, root): a row for each row of docs.

    Leaves are digests of ``columns``; those of a group ascend by ``order`` (whole numbers) and make the group's subroot, subroots by group the
    root. ``changed`` is a second digest that travels with the row, to be held against the manifest; it may be null. The text is read once and
    leaves no trace but its digests."""
    read = docs.select(
        F.col(order).alias("id"), text_key(F.col(group)).alias("group"), leaf([F.col(c) for c in columns]).alias("digest"), (F.lit(None).cast("string") if changed is None else changed).alias("changed"),
    )
    rows = materialise(read.groupBy("group", F.concat(integer_key(F.col("id")), F.col("digest")).alias("key"), "id", "changed").agg(F.count("*").alias("copies")), "leaves")
    # equal rows change alike, unless `changed` looks at other columns: then they are told apart by it
    rows = rows.withColumn("key", F.concat("key", F.coalesce("changed", F.lit(""))))
    totals = rows.groupBy("group").agg(F.sum("copies").alias("total"))
    ranked = radix_ranks(rows, "group", "key", "copies").join(maybe_broadcast(totals), "group")
    stages, subroots = _climbed(ranked.select("group", "rank", "copies", "total", F.substring("key", 18, 64).alias("digest"), F.struct("id", "changed").alias("row")))
    groups = radix_ranks(subroots.select(F.lit("").alias("all"), "group", "digest", F.lit(1).alias("copies")), "all", "group", "copies")
    count = subroots.agg(F.count("*").alias("total"))
    tops, root = _climbed(groups.crossJoin(F.broadcast(count)).select(F.col("all").alias("group"), "rank", "copies", "total", "digest", F.struct(F.col("group").alias("name")).alias("row")))
    empty = F.array().cast("array<struct<at:int,others:string>>")
    named = _descended(tops, root.select("group", empty.alias("proof"), F.col("digest").alias("root")))
    seeds = named.select(F.col("row.name").alias("group"), "proof", F.col("digest").alias("subroot"), "root")
    return _descended(stages, seeds).select(F.col("row.id").alias(order), "rank", F.col("digest").alias("leaf"), F.col("row.changed").alias("changed"), "proof", "subroot", "root")


def digest(docs: DataFrame) -> DataFrame:
    """The rows of ``op11_merkle_manifest``: rows whose id's CRC-32 is divisible by 3 are tampered with (A-Z lower-cased) after the manifest is made; a null
    id has no CRC-32 and is left alone."""
    text = F.translate(F.col("text"), UPPER, LOWER)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf([text if c == "text" else F.col(c) for c in COLUMNS]))
    x = manifest(docs, changed=tampered).withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
    return x.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_leaf(text: str) -> str:
    values = [text if c == "text" else f"CAST({c} AS VARCHAR)" for c in COLUMNS]
    return "sha256(concat(" + ", ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE concat(strlen({v}), ':', {v}) END" for v in values) + "))"


def _sql_tree(name: str, leaves: str) -> str:
    """Two tables: the nodes of each level of each group g, and beside each node but the last what its run holds on its left and right."""
    return f"""{name} AS (SELECT g, 0 AS k, i, h FROM {leaves}
UNION ALL SELECT g, k + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}) WHERE n > 1 GROUP BY g, k, i // 8),
{name}_top AS (SELECT g, max(k) AS k, arg_max(h, k) AS h FROM {name} GROUP BY g),
{name}_run AS (SELECT a.g, a.k, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
FROM {name} a JOIN {name}_top t ON t.g = a.g AND a.k < t.k JOIN {name} b ON b.g = a.g AND b.k = a.k AND b.i // 8 = a.i // 8 GROUP BY ALL)"""


#: CRC-32 of the id's decimal text, bit by bit.
_SQL_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))), 4294967295)"
SQL = f"""
WITH RECURSIVE d AS (SELECT *, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g, {_sql_leaf("text")} AS leaf,
CASE WHEN {_SQL_CRC} % 3 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS t FROM documents),
l AS MATERIALIZED (SELECT doc_id, g, leaf AS h, t, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, coalesce(t, '')) - 1 AS i FROM d),
{_sql_tree("node", "l")},
s AS (SELECT '' AS g, g AS name, row_number() OVER (ORDER BY g) - 1 AS i, h FROM node_top),
{_sql_tree("top", "s")},
step AS MATERIALIZED (SELECT n.g || '/' || n.k || '/' || n.i AS at, CASE WHEN n.k + 1 = t.k THEN 'top/0/' || s.i ELSE n.g || '/' || (n.k + 1) || '/' || (n.i // 8) END AS up, l, r FROM node_run n JOIN node_top t ON t.g = n.g JOIN s ON s.name = n.g
UNION ALL SELECT 'top/' || k || '/' || i, 'top/' || (k + 1) || '/' || (i // 8), l, r FROM top_run),
path AS (SELECT l.g, l.i, 0 AS k, CASE WHEN t.k = 0 THEN 'top/0/' || s.i ELSE l.g || '/0/' || l.i END AS at, coalesce(l.t, l.h) AS x, '' AS others FROM l JOIN node_top t ON t.g = l.g JOIN s ON s.name = l.g
UNION ALL SELECT p.g, p.i, p.k + 1, up, sha256(concat(step.l, x, step.r)), concat(others, step.l, step.r) FROM path p JOIN step ON step.at = p.at),
done AS (SELECT g, i, arg_max(x, k) AS folded_root, sha256(arg_max(others, k)) AS proof_sha256 FROM path GROUP BY ALL)
SELECT l.doc_id, l.h AS leaf, t.h AS subroot, root.h AS root, proof_sha256, folded_root, folded_root = root.h AS verified
FROM l JOIN node_top t ON t.g = l.g JOIN done ON done.g = l.g AND done.i = l.i CROSS JOIN top_top root
"""
