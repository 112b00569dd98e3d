"""Language-model scoring: a hierarchical log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Counts: every training token of the corpus, by word, kept as a table in the shared folder; every task holds those of the ``HEAD`` commonest
words. The ``VECTORS`` commonest have vectors of their own, as context and as target. Targets form a tree of two levels: the ``SINGLES``
commonest words are classes of their own, the rest of those with vectors is cut into classes of ``GROUP`` words in the order of their
endings, and all other words share ``BUCKETS`` classes by their last three bytes. The network predicts the class from the two tokens before, and, in a class of words
with vectors, the word as well; in a bucket a word has (c + 1) / (sum of c + 1 over the bucket, and 1 for unknown words). So the probabilities
of all words add up to one.

Training reads every training token once. Rows are dealt by a hash of their id and text over shards of about ``SHARD`` tokens and
``ROUNDS`` rounds, so that nothing depends on how the table is partitioned. In a round every shard goes on from the common parameters over
its rows of that round; then they are averaged, each vector weighted by how often it was met, in two steps of bounded size. Scoring
normalises with batched matrix products over all classes and over all words of a class. Words beyond the head, whose number grows with
the corpus, meet their counts in a shuffled join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import in_pieces, materialise, release, remainder, utf8

HEAD, VECTORS, SINGLES, BUCKETS, GROUP = 131_072, 10_240, 64, 32, 96
WIDTH, NOISE, INNER_NOISE, BATCH, LEAST_STEPS = 16, 48, 1, 4_096, 400
SHARD, ROUNDS = 8_000_000, 4
#: Averages are taken over pieces of so many rows, first among so many shards.
PIECE, FAN = 4_096, 64
END = b"\n"
#: Words that a task counts before it passes their counts on.
TALLY = 250_000
LOG10 = float(np.log(10))
NONE = np.float32(-1e30)


class Words(dict):
    """Word to its place in the head; others to -1 - bucket."""

    def __missing__(self, word: bytes) -> int:
        return -1 - zlib.crc32(word[-3:]) % BUCKETS


@dataclass
class Vocabulary:
    """The head's counts and classes, and what every task needs of the whole corpus."""

    words: Words
    counts: np.ndarray  # of the head's words
    mass: np.ndarray  # of each bucket's words beyond the head, and 1
    tokens: int
    distinct: int

    def __post_init__(self) -> None:
        n, c = len(self.words), self.counts + 1.0
        self.vectors = min(n, VECTORS)
        self.logs = np.log10(c)
        named = list(self.words)
        rest = sorted((w[::-1], i) for i, w in enumerate(named[: self.vectors]) if i >= SINGLES)
        self.slot = np.full(n, -1, np.int32)  # place among the words of all groups
        self.slot[[i for _, i in rest]] = np.arange(len(rest))
        groups = -(-len(rest) // GROUP)
        weight = np.zeros(groups * GROUP)
        weight[: len(rest)] = c[[i for _, i in rest]]
        per_group = weight.reshape(groups, GROUP).sum(axis=1)
        chance = weight / np.repeat(per_group, GROUP) if groups else weight  # of a word within its group
        self.inner = np.where(chance > 0, np.log(np.maximum(chance, 1e-30)), NONE).astype(np.float32)
        bucket = np.array([zlib.crc32(w[-3:]) % BUCKETS for w in named[self.vectors :]], np.int32)
        self.mass = self.mass + np.bincount(bucket, c[self.vectors :], BUCKETS)  # of each bucket
        singles = np.concatenate([c[: min(self.vectors, SINGLES)], np.full(max(0, SINGLES - n), 1e-6)])
        weight = np.concatenate([singles, self.mass, per_group])
        self.start = np.log(weight / weight.sum())
        self.classes = np.where(self.slot >= 0, SINGLES + BUCKETS + self.slot // GROUP, np.arange(n)).astype(np.int32)
        self.classes[self.vectors :] = SINGLES + bucket

    def places(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
        """Place of every token (0 and up in the head, else -1 - bucket), where each text's tokens start (an end follows its words), and the words."""
        each = [t.lower().split() + [END] for t in texts]
        edge = np.cumsum([0, *map(len, each)])
        get = self.words.__getitem__
        return np.fromiter((p for row in each for p in map(get, row)), np.int32, int(edge[-1])), edge, each

    def class_of(self, place: np.ndarray) -> np.ndarray:
        if not len(self.classes):
            return (SINGLES - 1 - place).astype(np.int32)
        return np.where(place >= 0, self.classes[np.maximum(place, 0)], SINGLES - 1 - place).astype(np.int32)

    def slot_of(self, place: np.ndarray) -> np.ndarray:
        if not len(self.slot):
            return np.full(len(place), -1, np.int32)
        return np.where(place >= 0, self.slot[np.maximum(place, 0)], -1).astype(np.int32)

    def contexts(self, place: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors one and two tokens before; before a text's first token stands the vector after the last."""
        own = np.where((place >= 0) & (place < self.vectors), place, self.vectors - SINGLES + self.class_of(place))
        none = self.vectors + BUCKETS
        one, two = np.concatenate([[none], own[:-1]]), np.concatenate([[none, none], own[:-2]])[: len(own)]
        first = edge[:-1]
        one[first], two[first] = none, none
        second = (first + 1)[first + 1 < len(own)]
        two[second] = none
        return one.astype(np.int32), two.astype(np.int32)


Parameters = dict[str, np.ndarray]


def initial(known: Vocabulary, seed: int = 4) -> Parameters:
    """q: context vectors; one, two: a matrix for each place; r: classes, s: words within their classes, each with a bias at its end."""
    rng = np.random.default_rng(seed)
    small = lambda n: rng.normal(0, 0.1, (n, WIDTH)).astype(np.float32)
    with_bias = lambda rows, bias: np.concatenate([rows, bias.astype(np.float32)[:, None]], axis=1)
    return {
        "q": small(known.vectors + BUCKETS + 1), "r": with_bias(small(len(known.start)), known.start), "s": with_bias(np.zeros((len(known.inner), WIDTH), np.float32), known.inner),
        "one": np.eye(WIDTH, dtype=np.float32), "two": 0.5 * np.eye(WIDTH, dtype=np.float32),
    }


def _with_one(h: np.ndarray) -> np.ndarray:
    """h with a last column of ones, which takes the biases into a product."""
    return np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1)


def _rows(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct places and the sum of the rows at each."""
    # 16-bit numbers are sorted by radix
    order = np.argsort(at.astype(np.int16) if len(at) and at.max() < 1 << 15 else at, kind="stable")
    at = at[order]
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return at[first], np.add.reduceat(rows[order], first, axis=0)


def sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def nce(known: Vocabulary, p: Parameters, total: Parameters, place: np.ndarray, edge: np.ndarray, least: int = LEAST_STEPS, rate: float = 0.1, seed: int = 4) -> tuple[Parameters, Parameters, Parameters]:
    """Parameters and AdaGrad sums after one pass, or at least ``least`` steps, of noise-contrastive estimation, and how
    often each row was met.

    The noise for classes is their unigram distribution, drawn for each step and shared by its tokens; for words within a class it is the
    words that other tokens of the step have there, in random order."""
    p, total = ({k: v.copy() for k, v in x.items()} for x in (p, total))
    y, slot, (one, two) = known.class_of(place), known.slot_of(place), known.contexts(place, edge)
    group = (slot // GROUP).astype(np.int16)
    rng, n = np.random.default_rng(seed), len(place)
    chance = np.exp(known.start - np.logaddexp.reduce(known.start))
    noise_log = (np.log(chance) + np.log(NOISE)).astype(np.float32)
    inner_log = known.inner + np.float32(np.log(INNER_NOISE))

    def move(k: str, at: np.ndarray | slice, g: np.ndarray) -> None:
        now = total[k][at] + g * g
        total[k][at] = now
        p[k][at] -= rate * g / np.sqrt(now)

    for step in range(max(-(-n // BATCH), least) if n else 0):
        a = step % -(-n // BATCH) * BATCH
        t, c1, c2, w = y[a : a + BATCH], one[a : a + BATCH], two[a : a + BATCH], slot[a : a + BATCH]
        noise = rng.choice(len(chance), NOISE, p=chance)
        q1, q2 = p["q"][c1], p["q"][c2]
        h = _with_one(q1 @ p["one"] + q2 @ p["two"])
        r_t, r_n = p["r"][t], p["r"][noise]
        scale = np.float32(1 / len(t))
        on_t = (sigmoid((h * r_t).sum(axis=1) - noise_log[t]) - 1) * scale
        on_n = sigmoid(h @ r_n.T - noise_log[noise]) * scale
        d_h = on_t[:, None] * r_t + on_n @ r_n
        at, g = _rows(np.concatenate([t, noise]), np.concatenate([on_t[:, None] * h, on_n.T @ h]))
        inside = np.flatnonzero(w >= 0)
        if len(inside):
            inside = inside[rng.permutation(len(inside))]
            inside = inside[np.argsort(group[a : a + BATCH][inside], kind="stable")]  # by group, in random order within it
            own, h_w = w[inside], h[inside]
            begins = np.flatnonzero(np.concatenate([[True], own[1:] // GROUP != own[:-1] // GROUP]))
            size = np.diff(np.append(begins, len(own)))
            begin, size = np.repeat(begins, size), np.repeat(size, size)
            s_o, log_o = p["s"][own], inner_log[own]
            on = (sigmoid((h_w * s_o).sum(axis=1) - log_o) - 1) * scale
            rise, g_s = on[:, None] * s_o, on[:, None] * h_w
            for k in range(1, INNER_NOISE + 1):  # the noise of a token: targets of its group's other tokens
                other = begin + (np.arange(len(own)) - begin + k) % size
                s_k = s_o[other]
                on = np.where(size > k, sigmoid((h_w * s_k).sum(axis=1) - log_o[other]) * scale, 0)[:, None]
                rise += on * s_k
                g_s[other] += on * h_w  # a rotation: no target is met twice
            d_h[inside] += rise
            move("s", *_rows(own, g_s))
        d_h = d_h[:, :-1]
        at_q, g_q = _rows(np.concatenate([c1, c2]), np.concatenate([d_h @ p["one"].T, d_h @ p["two"].T]))
        move("one", slice(None), q1.T @ d_h)
        move("two", slice(None), q2.T @ d_h)
        move("r", at, g)
        move("q", at_q, g_q)
    tally = lambda x, size: np.bincount(x, minlength=size).astype(np.float32)
    met = {"q": tally(one, len(p["q"])) + tally(two, len(p["q"])), "r": tally(y, len(p["r"])), "s": tally(slot[slot >= 0], len(p["s"]))}
    return p, total, met | {"one": np.full(WIDTH, n, np.float32), "two": np.full(WIDTH, n, np.float32)}


def log_probabilities(known: Vocabulary, p: Parameters, place: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """log10 of P(class | context), times P(word | class, context) for words with vectors, normalised over all classes and words.

    Classes are normalised once for each distinct context, words class by class."""
    y, slot, (one, two) = known.class_of(place), known.slot_of(place), known.contexts(place, edge)
    a, b = (p["q"] @ p[k] for k in ("one", "two"))
    wide = len(p["q"])
    pairs, at = np.unique(two.astype(np.int64) * wide + one, return_inverse=True)
    first, second = (pairs % wide).astype(np.int32), (pairs // wide).astype(np.int32)
    h, r, s = _with_one(a[first] + b[second]), p["r"], p["s"]
    reach = _longest(h)
    norm, tame = np.empty(len(pairs), np.float32), _tame(reach, r)
    for i in range(0, len(pairs), 4096):
        norm[i : i + 4096] = _log_sum(h[i : i + 4096] @ r.T, tame)
    out = np.empty(len(place), np.float64)
    for i in range(0, len(place), 65_536):
        part = slice(i, i + 65_536)
        out[part] = (h[at[part]] * r[y[part]]).sum(axis=1) - norm[at[part]]
    order = np.argsort(np.where(slot >= 0, slot // GROUP, -1).astype(np.int16), kind="stable")
    order = order[np.count_nonzero(slot < 0) :]
    group = slot[order] // GROUP
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(order) else []
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        low = int(group[i]) * GROUP
        rows = s[low : low + GROUP]
        tame = _tame(reach, rows)
        for k in range(i, j, 4096):
            mine = order[k : min(j, k + 4096)]
            x = h[at[mine]] @ rows.T
            out[mine] += x[np.arange(len(mine)), slot[mine] - low]
            out[mine] -= _log_sum(x, tame)
    return out / LOG10


def _longest(rows: np.ndarray) -> float:
    """The length of the longest row, its last value left out."""
    return float(np.sqrt((rows[:, :-1] ** 2).sum(axis=1).max(initial=0)))


def _tame(reach: float, rows: np.ndarray) -> bool:
    """True if no sum of exponentials of products with rows of that reach can leave single precision."""
    most, bias = reach * _longest(rows), float(rows[:, -1].max())
    return most + bias < 60 and bias - most > -60


def _log_sum(x: np.ndarray, tame: bool) -> np.ndarray:
    """log of the sum of the exponentials of each row; x is overwritten."""
    top = np.float32(0) if tame else x.max(axis=1)
    if not tame:
        x -= top[:, None]
    return np.log(np.exp(x, out=x) @ np.ones(x.shape[1], np.float32)) + top


ORDER = ("q", "r", "s", "one", "two")


def _stack(p: Parameters) -> np.ndarray:
    """All rows of all parameters, of one width."""
    return np.concatenate([np.pad(p[k], ((0, 0), (0, WIDTH + 1 - p[k].shape[1]))) for k in ORDER])


def _parts(rows: np.ndarray, like: Parameters) -> Parameters:
    edges = np.cumsum([0, *(len(like[k]) for k in ORDER)])
    return {k: rows[a:b, : like[k].shape[1]].astype(np.float32) for k, a, b in zip(ORDER, edges[:-1], edges[1:], strict=True)}


def _weights(met: Parameters) -> np.ndarray:
    """A weight for every row: how often it was met, and a little, so that rows nobody met are averaged too."""
    return np.concatenate([met[k] for k in ORDER]) + np.float32(1e-3)


#: Of a piece of the rows: changes, AdaGrad sums, weights. A shard sends changes and the logarithms of its sums in half precision, sums
#: over shards are weighted and in single precision.
SUMS = "piece int, share int, change binary, sums binary, weight binary"


def _sums(piece: int, share: int, *arrays: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([share], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=["piece", "share", "change", "sums", "weight"])


def _add(batches: Iterator[pa.RecordBatch], fan: int, half: bool) -> Iterator[pa.RecordBatch]:
    """Sums for each (piece, share / fan); rows come sorted by piece and share."""
    now, total = None, None
    done = lambda: _sums(*now, *(x.astype(np.float32) for x in total))
    for batch in batches:
        for piece, share, change, sums, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            m = np.frombuffer(weight, np.float32).astype(np.float64)
            if half:
                wide = m[:, None]
                row = [(np.frombuffer(change, np.float16).reshape(len(m), -1) * wide).ravel(), (np.exp2(np.frombuffer(sums, np.float16).astype(np.float64)).reshape(len(m), -1) * wide).ravel(), m]
            else:
                row = [np.frombuffer(change, np.float32).astype(np.float64), np.frombuffer(sums, np.float32).astype(np.float64), m]
            if (piece, share // fan) != now:
                if now is not None:
                    yield done()
                now, total = (piece, share // fan), row
            else:
                total = [x + y for x, y in zip(total, row, strict=True)]
    if now is not None:
        yield done()


def count(docs: DataFrame, learn: Column) -> DataFrame:
    """(word, c) over the words and ends of all rows for which ``learn`` holds, added up task by task before they are shuffled."""

    def batch_of(found: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for piece in in_pieces(batch, "text"):
                data, at = utf8(piece.column(0))
                for a, b in zip(at[:-1], at[1:], strict=True):
                    found.update(data[a:b].tobytes().lower().split())
                found[END] += len(at) - 1
                if len(found) > TALLY:
                    yield batch_of(found)
                    found = Counter()
        if found:
            yield batch_of(found)

    each = docs.where(learn).select("text").mapInArrow(run, "word string, c long")
    return materialise(each.groupBy("word").agg(F.sum("c").alias("c")), "counts")


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head is every word at least as common as a bound that leaves HEAD words at most; classes and masses cover all words."""
    level = F.floor(F.log2("c") * 64).cast("int")
    levels = sorted(((r.level, r.words) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect()), reverse=True)
    taken, least = 0, 1 << 30
    for lv, n in levels:
        if taken + n > HEAD:
            break
        taken, least = taken + n, lv
    head = sorted(((-r.c, r.word.encode()) for r in counts.where(level >= least).collect()))
    bucket = F.crc32(F.substring(F.col("word").cast("binary"), -3, 3)) % BUCKETS
    mass = np.ones(BUCKETS)
    for r in counts.where(level < least).groupBy(bucket.alias("k")).agg(F.sum(F.col("c") + 1).alias("m")).collect():
        mass[r.k] += r.m
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return Vocabulary(Words({w: i for i, (_, w) in enumerate(head)}), np.array([-n for n, _ in head], np.float64), mass, int(tokens), int(distinct))


def train(docs: DataFrame, learn: Column, known: Vocabulary, shard: int = SHARD, rounds: int = ROUNDS) -> Parameters:
    """The parameters after all rounds; they depend on the rows, not on their order or partitions."""
    p = initial(known)
    total = {k: np.full_like(v, 1e-6) for k, v in p.items()}
    if not known.tokens:
        return p
    shards = -(-known.tokens // shard)
    key = F.xxhash64("id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, "text"):
                data, at = utf8(piece.column(1))
                place, edge, _ = known.places([data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([place[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], names=["key", "place"])

    coded = docs.where(learn).select(key.alias("key"), "text").mapInArrow(encode, "key long, place binary")
    coded = coded.select("key", "place", F.pmod("key", F.lit(rounds)).cast("int").alias("round"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int").alias("shard"))
    coded = materialise(coded, "coded")
    for turn in range(rounds):
        state = (p, total)

        def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine, now = [], None

            def solve() -> Iterator[pa.RecordBatch]:
                edge = np.cumsum([0, *map(len, mine)])
                new, sums, met = nce(known, *state, np.concatenate(mine), edge, -(-LEAST_STEPS // rounds), seed=turn * 1_000_003 + now)
                m = _weights(met)
                change, t = (_stack(new) - _stack(state[0])).astype(np.float16), np.log2(np.maximum(_stack(sums), 1e-6)).astype(np.float16)
                for k, i in enumerate(range(0, len(m), PIECE)):
                    part = slice(i, i + PIECE)
                    yield _sums(k, now, change[part], t[part], m[part])

            for batch in batches:
                for which, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if which != now and mine:
                        yield from solve()
                        mine = []
                    now = which
                    mine.append(np.frombuffer(place, np.int32))
            if mine:
                yield from solve()

        dealt = coded.where(F.col("round") == turn).repartition(max(1, shards), "shard").sortWithinPartitions("shard", "key").select("shard", "place")
        sums = dealt.mapInArrow(fit, SUMS)
        for fan, half in ((FAN, True), (1 << 30, False)):
            near = F.floor(F.col("share") / fan)
            parts = 16 if fan > FAN else max(16, 4 * -(-shards // FAN))  # a task reads the sums of some shares
            sums = sums.repartition(parts, "piece", near).sortWithinPartitions("piece", "share").mapInArrow(lambda x, fan=fan, half=half: _add(x, fan, half), SUMS)
        got = sorted((r.piece, r.change, r.sums, r.weight) for r in sums.collect())  # one row for each piece
        if got:
            change, t, m = (np.concatenate([np.frombuffer(x[k], np.float32) for x in got]) for k in (1, 2, 3))
            p, total = (_parts(x, p) for x in (_stack(p) + change.reshape(-1, WIDTH + 1) / m[:, None], np.maximum(t.reshape(-1, WIDTH + 1) / m[:, None], 1e-6)))
    release(coded)
    return p


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", learn: Column | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; ``learn`` is over column ``id``.

    Null texts count as empty and have one token, the end; rows that repeat an id are scored one by one; with no training rows every
    token is unknown and the base is that of an empty corpus. Other columns are ignored whatever their names."""
    base = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    learn = remainder(F.col("id"), 7) != 2 if learn is None else learn
    counts = count(base, learn)
    known = vocabulary(counts)
    p = train(base, learn, known)
    floor_mass = np.concatenate([np.zeros(SINGLES), np.log10(known.mass), np.zeros(len(known.start) - SINGLES - BUCKETS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, "text"):
                data, at = utf8(piece.column(2))
                place, edge, each = known.places([data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])
                head = place >= 0
                logs = np.where(head, known.logs[np.maximum(place, 0)] if len(known.logs) else 0, 0)
                inner = log_probabilities(known, p, place, edge) - floor_mass[known.class_of(place)] + np.where(place >= known.vectors, logs, 0)
                by = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[edge])  # noqa: B023, E731
                sums = [by(np.ones(len(place))).astype(np.int64), by(head).astype(np.int64), by(logs), by(inner)]
                ids, rows = piece.column(1), piece.column(0).to_pylist()
                owner, words, times = [], [], []
                for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
                    for w, m in Counter(each[i][j] for j in np.flatnonzero(~head[a:b]).tolist()).items():
                        owner.append(i)
                        words.append(w)
                        times.append(m)
                zero = [pa.nulls(len(words), t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                yield pa.RecordBatch.from_arrays([piece.column(0), ids, pa.array([f" {r}" for r in rows]), pa.array([0] * len(rows), pa.int64()), *map(pa.array, sums)], names=NAMES)
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(owner, pa.int64())), ids.take(pa.array(owner, pa.int64())), pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64()), *zero], names=NAMES)

    kind = base.schema["id"].dataType.simpleString()
    spread = base.select(F.monotonically_increasing_id().alias("row"), "id", "text").mapInArrow(run, f"row long, id {kind}, word string, m long, n long, known long, logs double, inner double")
    tail = spread.join(counts, "word", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    more = F.col("m") * F.log10(zero(F.col("c")) + 1.0)
    out = tail.groupBy("row", "id").agg(
        F.sum("n").alias("n_tokens"), (F.sum(zero(F.col("known"))) + F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0))).alias("n_known"),
        F.sum(zero(F.col("logs")) + more).alias("logs"), F.sum(zero(F.col("inner")) + more).alias("score"),
    )
    floor = float(np.log10(known.tokens + known.distinct + 1))
    return out.select("id", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"), (F.col("logs") - F.col("n_tokens") * floor).alias("base_score"), "score")


NAMES = ["row", "id", "word", "m", "n", "known", "logs", "inner"]


def digest(docs: DataFrame) -> DataFrame:
    """The columns of ``op4_lm_scoring``."""
    r = score(docs)
    return r.select(F.col("id").alias("doc_id"), (remainder(F.col("id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
