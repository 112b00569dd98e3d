"""N-gram Jaccard join: word-shingle sets in a global order, joined by traversing a prefix tree.

1. Shingles are 64-bit hashes of five words; documents of equal sets become one set with its smallest id (a grouped minimum).
2. Extended prefix filter, without a trie: a set of n shingles needs t = ceil(0.8 n) in common with any partner, so among its
   n - t + e smallest shingles by hash at least e lie in the partner's prefix as well. Sets with fewer prefix shingles that any other
   set has link with nothing. One grouped minimum and maximum by shingle decides it; nothing is gathered by shingle.
3. The remaining sets are ordered by rarity. Those that share a shingle within their n - t + 1 rarest fall into one candidate
   class (components over one star for each shingle, so links grow with the rows). A class of at most ``block_tokens`` shingles is a
   block and joined at once. A larger one is dealt into blocks by a hash, each joined on its own, twice with different hashes: that
   joins large groups of near copies with work in proportion to their rows.
4. After each deal only shingles that sets of two different components hold can still stand for a missing link, so the classes of
   dealt sets are formed anew over those shingles, mostly none. What is left after the last deal and still too large is split into
   blocks of like size, and every two blocks that can hold a link are joined: exact, and quadratic in that rest alone.
5. In a block the ordered sets go into a radix tree, commonest shingle first. A probe walks it once: sets with a common
   beginning share the count of what has matched so far, and a subtree is left where what has matched plus the shorter remainder
   falls short of the overlap that its shortest set asks for, or where all its sets are linked with the probe already.
   What comes out is a spanning forest of the links, at most one row for each set and block.
6. Components of these rows give the classes.

Equality is that of 64-bit hashes of shingles and 128-bit digests of sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.llm.components import components
from seqloom.llm.shared import chunks, free_name, materialise, maybe_broadcast, release, utf8

WORDS = 5
#: Needed: 100 * intersection >= SHARE * union.
SHARE = 80
BLOCK_TOKENS, DEALS = 32_000, 2
ODD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse, modulo 2^64, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base))]) for base in (ODD, inverse))
        return self.up, self.down


POWERS = Powers()


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """For each row of bytes its sorted distinct shingle hashes."""
    lo, hi = int(at[0]), int(at[-1])
    text = np.concatenate([_LOWER[data[lo:hi]], np.array([32], np.uint8)])
    space = _SPACE[text]
    begin, stop = ~space, space.copy()
    begin[1:] &= space[:-1]
    stop[1:] &= ~space[:-1]
    stop[0] = False
    edges = (at - lo)[1:-1]
    inner = edges[(edges > 0) & (edges < hi - lo)]
    begin[inner] = ~space[inner]
    start = np.flatnonzero(begin)
    closing = stop.copy()
    cut = inner[~space[inner - 1]]
    closing[cut] = True
    end = np.flatnonzero(closing)
    up, down = POWERS.get(len(text) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)])])
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * STEP)
    first = np.searchsorted(start, at - lo)
    rolled = np.zeros(max(0, len(word) - words + 1), np.uint64)
    for j in range(words):
        rolled = rolled * STEP + word[j : j + len(rolled)]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            h = np.uint64(b - a)
            for w in word[a:b]:
                h = mix(np.array([h * STEP + w]))[0]
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)))


def _with_sets(docs: DataFrame, doc_id: str, text: str, words: int, make: Callable[[list[np.ndarray]], dict[str, pa.Array]], kinds: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                data, at = utf8(batch.column(1))
                for i, j in chunks(at):
                    made = make(shingle_sets(data, at[i : j + 1], words))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *made.values()], names=["id", *made])

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id long, {kinds}")


def _digest(sets: list[np.ndarray]) -> dict[str, pa.Array]:
    """n, and two independent sums over mixed shingles: equal for equal sets."""
    one = [mix(s).sum(dtype=np.uint64) for s in sets]
    two = [mix(s ^ STEP).sum(dtype=np.uint64) for s in sets]
    return {"n": pa.array([len(s) for s in sets], pa.int64()), "d1": pa.array(np.array(one, np.uint64).view(np.int64)), "d2": pa.array(np.array(two, np.uint64).view(np.int64))}


def _extra(n: int, share: int) -> tuple[int, int]:
    """Length of the extended prefix, and how many shingles of it must occur elsewhere."""
    misses = n - -(-share * n // 100)
    extra = max(1, min(n - misses, misses))
    return misses + extra, extra


def _prefix(share: int) -> Callable[[list[np.ndarray]], dict[str, pa.Array]]:
    def make(sets: list[np.ndarray]) -> dict[str, pa.Array]:
        return {"d1": _digest(sets)["d1"], "h": _lists([s[: _extra(len(s), share)[0]] for s in sets])}

    return make


class Node:
    __slots__ = ("label", "next", "ends", "low", "high", "most", "any", "even")

    def __init__(self, label: np.ndarray, x: int, n: int, shared: int) -> None:
        self.label, self.next, self.ends = label, {}, []
        self.low = self.high = n
        self.most, self.any, self.even = shared, x, True


def forest(sizes: np.ndarray, sets: list[np.ndarray], share: int = SHARE) -> list[tuple[int, int]]:
    """A spanning forest of the links. sizes: shingles in each set, those that no other set has included; sets: ranks of the others,
    ascending. Links are those with 100 * overlap >= share * union."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    root = Node(np.zeros(0, np.int32), 0, int(sizes[0]) if len(sizes) else 0, 0)
    root.even = False
    mask = np.zeros(1 + max((int(s[-1]) for s in sets if len(s)), default=0), bool)
    links = []
    for x in np.argsort(-sizes, kind="stable").tolist():
        mine, n = sets[x], int(sizes[x])
        mask[mine] = True
        stack = [(c, 0, 0) for c in root.next.values()]
        while stack:
            node, matched, depth = stack.pop()
            if 100 * node.high < share * n or share * node.low > 100 * n or node.even and find(node.any) == find(x):
                continue
            matched += int(np.count_nonzero(mask[node.label]))
            depth += len(node.label)
            left = min(len(mine) - int(np.searchsorted(mine, node.label[-1], side="right")), node.most - depth)
            if (100 + share) * (matched + left) < share * (n + node.low):
                continue
            for y in node.ends:
                if 100 * matched >= share * (n + int(sizes[y]) - matched) and find(x) != find(y):
                    links.append((x, y))
                    parent[find(y)] = find(x)
            stack += [(c, matched, depth) for c in node.next.values()]
        mask[mine] = False
        if not len(mine):
            continue
        node, rest = root, mine
        while True:
            node.low, node.high, node.most = min(node.low, n), max(node.high, n), max(node.most, len(mine))
            if node is not root:
                node.even = node.even and find(node.any) == find(x)
            if not len(rest):
                node.ends.append(x)
                break
            child = node.next.get(int(rest[0]))
            if child is None:
                node.next[int(rest[0])] = leaf = Node(rest, x, n, len(mine))
                leaf.ends.append(x)
                break
            m = min(len(rest), len(child.label))
            differ = np.flatnonzero(rest[:m] != child.label[:m])
            k = int(differ[0]) if len(differ) else m
            if k < len(child.label):
                above = Node(child.label[:k], child.any, child.low, child.most)
                above.high, above.even = child.high, child.even
                child.label = child.label[k:]
                above.next[int(child.label[0])] = child
                node.next[int(rest[0])] = above
                child = above
            node, rest = child, rest[k:]
    return links


def _join(share: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by block: when a block ends, its forest."""

    def solve(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        ids, sizes = [r[0] for r in rows], np.array([r[1] for r in rows])
        df, h = (np.concatenate([r[k] for r in rows]) for k in (2, 3))
        order = np.lexsort((h, -df))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (df[order][1:] != df[order][:-1])
        rank = np.empty(len(order), np.int32)
        rank[order] = np.cumsum(fresh) - 1
        edge = np.cumsum([0, *(len(r[2]) for r in rows)])
        return [(ids[x], ids[y]) for x, y in forest(sizes, [np.sort(rank[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)], share)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out = None, [], []
        for batch in batches:
            keys, ids, sizes, lists = (batch.column(i) for i in range(4))
            inner = lists.flatten()
            df, h = inner.field("df").to_numpy(zero_copy_only=False), inner.field("h").to_numpy(zero_copy_only=False)
            edge = np.cumsum([0, *(len(x) for x in lists)])
            for i, (key, x, n) in enumerate(zip(keys.to_pylist(), ids.to_pylist(), sizes.to_pylist(), strict=True)):
                if key != now:
                    out += solve(rows)
                    now, rows = key, []
                rows.append((x, n, df[edge[i] : edge[i + 1]].copy(), h[edge[i] : edge[i + 1]].copy()))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
                out = []
        out += solve(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return run


def _misses(share: int) -> str:
    return f"n - CAST(ceil({share} * n / 100.0D) AS LONG)"


def _classes(token: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(node, root): candidate classes over the prefix shingles that sets of two components or more hold."""
    if roots is not None:
        token = token.join(roots, token.id == roots.node, "left").select("id", "h", F.coalesce("root", "id").alias("root"))
    else:
        token = token.withColumn("root", F.col("id"))
    group = token.groupBy("h").agg(F.min("id").alias("b"), F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h", "b")
    return components(token.join(group, "h").select(F.col("id").alias("a"), "b"), "a", "b")


def _paired(held: DataFrame, large: DataFrame, block_tokens: int, share: int) -> DataFrame:
    """Rows of large classes, once for every two blocks of like size that can hold a link."""
    held = held.join(maybe_broadcast(large.select("root")), "root", "left_semi").withColumn("band", F.floor(F.log("n") / F.lit(float(np.log(100 / share)))).cast("int"))
    sums = held.groupBy("root", "band").agg(F.sum(F.size("shared")).alias("tokens"))
    blocks = sums.select("root", "band", F.ceil(F.col("tokens") / (block_tokens / 2)).cast("int").alias("k"))
    blocks = materialise(blocks.select("root", "band", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part")), "blocks")
    other = blocks.select("root", F.col("band").alias("band2"), F.col("part").alias("part2"))
    name = F.when(F.expr("struct(band, part) <= struct(band2, part2)"), F.concat_ws("/", "band", "part", "band2", "part2")).otherwise(F.concat_ws("/", "band2", "part2", "band", "part"))
    pairs = blocks.join(other, "root").where("abs(band - band2) <= 1").select("root", "band", "part", name.alias("pair"))
    split = held.join(blocks.select("root", "band", "k").distinct(), ["root", "band"]).withColumn("part", F.pmod(F.xxhash64("id"), "k").cast("int"))
    return split.join(pairs, ["root", "band", "part"]).select(F.concat_ws(":", "root", "pair").alias("block"), "id", "n", "shared")


def _links(ordered: DataFrame, block_tokens: int, share: int) -> DataFrame:
    """(a, b): links whose components are those of all links between the sets (id, n, shared, len)."""
    parts = int(ordered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    token = ordered.select("id", F.explode(F.expr("slice(shared, 1, CAST(len AS INT)).h")).alias("h"))
    found, roots = None, None
    for deal in range(DEALS + 1):
        classes = _classes(token, roots)
        held = materialise(ordered.join(classes, ordered.id == classes.node).select("id", "n", "shared", "len", "root"), "held")
        sums = held.groupBy("root").agg(F.sum(F.size("shared")).alias("tokens"))
        large = materialise(sums.where(F.col("tokens") > block_tokens).select("root", F.ceil(F.col("tokens") / block_tokens).alias("k")), "large")
        done = large.isEmpty()
        near = maybe_broadcast(large)
        rows = held.join(near, "root", "left").select("root", "k", "id", "n", "shared")
        if deal < DEALS:
            part = F.coalesce(F.pmod(F.xxhash64("id", F.lit(deal)), "k"), F.lit(0))
            blocks = rows.select(F.concat_ws(":", "root", part).alias("block"), "id", "n", "shared")
        else:
            blocks = rows.where("k IS NULL").select(F.concat_ws(":", "root").alias("block"), "id", "n", "shared")
            if not done:
                blocks = blocks.union(_paired(held, large, block_tokens, share))
        made = materialise(blocks.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_join(share), "a long, b long"), "links")
        found = made if found is None else found.union(made)
        if done or deal == DEALS:
            return found
        ordered = materialise(held.join(near, "root", "left_semi").select("id", "n", "shared", "len"), "dealt")
        release(held)
        token = ordered.select("id", F.explode(F.expr("slice(shared, 1, CAST(len AS INT)).h")).alias("h"))
        roots = components(found, "a", "b")
    return found


def link_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, share: int = SHARE, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, n_shingles, component_id) for each row of docs; ids are integers, others raise TypeError.

    Texts that are null or have no word have no shingles and link with nothing; fewer words than ``words`` make one shingle. Rows
    that repeat an id are one document: each of their texts links under that id. A null id gives a null component. Other columns are
    ignored whatever their names; an empty table gives an empty one."""
    if docs.schema[doc_id].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{doc_id} must be of an integer type")
    ids = materialise(_with_sets(docs, doc_id, text, words, _digest, "n long, d1 long, d2 long"), "ids")
    full = ids.where("n > 0 AND id IS NOT NULL")
    first = full.groupBy("d1", "d2", "n").agg(F.min("id").alias("rep"))

    prefix = _with_sets(docs, doc_id, text, words, _prefix(share), "d1 long, h array<long>").where("id IS NOT NULL AND size(h) > 0")
    alone = prefix.select("d1", F.explode("h").alias("h")).groupBy("h").agg(F.min("d1").alias("d1"), F.max("d1").alias("other")).where("d1 = other")
    lone = alone.groupBy("d1").agg(F.count("*").alias("lone"))
    extra = f"greatest(1, least(n - ({_misses(share)}), {_misses(share)}))"
    left = materialise(first.join(lone, "d1", "left").where(f"{_misses(share)} + {extra} - coalesce(lone, 0) >= {extra}").drop("lone"), "left")

    mine = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(maybe_broadcast(left.select(F.col("rep").alias("id")).distinct()), "id", "left_semi")
    whole = lambda sets: _digest(sets) | {"h": _lists(sets)}
    sets = _with_sets(mine, "id", "text", words, whole, "n long, d1 long, d2 long, h array<long>")
    rows = materialise(sets.where("n > 0").dropDuplicates(["id", "d1", "d2"]).select("id", "d1", "d2", "n", F.explode("h").alias("h")), "shingles")
    common = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    ordered = rows.join(common, "h").groupBy("id", "d1", "d2", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    ordered = ordered.withColumn("lone", F.col("n") - F.size("shared")).withColumn("len", F.expr(f"{_misses(share)} + 1 - lone")).where("len > 0")
    ordered = materialise(ordered.select("id", "n", "shared", "len"), "ordered")
    release(rows)
    links = _links(ordered, block_tokens, share)

    # an id with several texts is one document: it holds together the classes of all of them
    several = full.groupBy("id").agg(F.min(F.struct("d1", "d2", "n")).alias("x"), F.max(F.struct("d1", "d2", "n")).alias("y")).where("x <> y").select("id")
    several = full.join(maybe_broadcast(several), "id", "left_semi").join(first, ["d1", "d2", "n"]).select(F.col("id").alias("a"), F.col("rep").alias("b"))
    roots = components(links.union(several), "a", "b")

    known = first.join(roots, first.rep == roots.node, "left").select(F.col("d1").alias("e1"), F.col("d2").alias("e2"), F.col("n").alias("m"), F.coalesce("root", "rep").alias("component_id"))
    joined = ids.join(known, (ids.d1 == known.e1) & (ids.d2 == known.e2) & (ids.n == known.m) & (ids.n > 0), "left")
    return joined.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that have a smaller id in their component; their columns stay, whatever their names.

    Rows with a null id stay, as do rows without words and all rows of a kept id; a document goes with all its rows."""
    name = free_name("gone_id", docs)
    gone = link_components(docs, doc_id, text).where("component_id < id").select(F.col("id").alias(name)).distinct()
    return docs.join(maybe_broadcast(materialise(gone, "gone")), F.col(doc_id) == F.col(name), "left_anti")
