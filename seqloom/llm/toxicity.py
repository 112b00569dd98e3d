"""Toxicity by non-negative positive-unlabelled learning: a numpy classifier from confirmed toxic texts and unlabelled ones.

Only rows marked toxic are used as examples; the unlabelled texts are a draw from all rows, whatever their marks. The risk is
``prior * R+(P) + max(0, R-(U) - prior * R-(P))``: what the positives hidden among the unlabelled add to the negative risk is taken off,
and where the estimate falls below zero the step goes the other way, which stops over-fitting.

Inputs of a score are the text's distinct words by presence, and how many of them begin alike (4 to 7 bytes: inflected forms share a
stem; one, two and three words at least are inputs of their own), and nothing else. Fitting is on a bounded sample, drawn by a hash of the
id: about ``MAX_POSITIVE`` confirmed and ``MAX_UNLABELLED`` unlabelled rows; scoring covers every row and the whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm.shared import drawn, free_name, in_pieces, materialise, maybe_broadcast, release, remainder, utf8

MAX_POSITIVE, MAX_UNLABELLED = 4_000, 12_000
THRESHOLD = 0.3
#: Inputs are chosen by test, not by number: those commoner in confirmed texts by so many standard errors that stand in so many sampled texts.
LEAST_Z, LEAST_TEXTS = 5.0, 5
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> set[bytes]:
    return set(text.translate(_TABLE).split())


BEGINNINGS, LEVELS = (4, 5, 6, 7), 3


def inputs(text: bytes) -> dict[int, dict[bytes, int]]:
    """Distinct words under 0, and under each length how many of them begin alike, up to LEVELS."""
    whole = words(text)
    return {0: dict.fromkeys(whole, 1)} | {k: Counter(w[:k] for w in whole if len(w) > k) for k in BEGINNINGS}


def named(text: bytes) -> list[bytes]:
    """The inputs that are on: kind, level, word or beginning."""
    return [bytes([k, level]) + w for k, each in inputs(text).items() for w, n in each.items() for level in range(1, min(n, LEVELS) + 1)]


@dataclass
class Model:
    weights: dict[bytes, float]
    bias: float

    def __post_init__(self) -> None:
        self.sums: dict[int, dict[bytes, list[float]]] = {}
        for x, w in sorted(self.weights.items()):  # what the first one, two and three levels add up to
            at = self.sums.setdefault(x[0], {}).setdefault(x[2:], [0.0] * (LEVELS + 1))
            for level in range(x[1], LEVELS + 1):
                at[level] += w

    def score(self, texts: list[bytes]) -> np.ndarray:
        """P(toxic); inputs count by presence, so a long text is not diluted."""
        g = []
        for t in texts:
            total = self.bias
            for k, found in inputs(t).items():
                known = self.sums.get(k, {})
                total += sum(known[x][min(found[x], LEVELS)] for x in sorted(found.keys() & known.keys()))
            g.append(total)
        return 1 / (1 + np.exp(-np.clip(np.array(g, np.float64), -40, 40)))


class Rows:
    """A sparse 0/1 matrix: for each row the columns that are on."""

    def __init__(self, rows: list[np.ndarray], width: int) -> None:
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def back(self, s: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, s[self.row], self.width)


def fit(positive: Rows, unlabelled: Rows, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear model with the smallest non-negative risk; rows are texts, columns inputs.

    The loss is the sigmoid, whose bound keeps the estimate's own error within bounds."""
    prior = min(max(prior, 1e-4), 0.999)
    w, b = np.zeros(positive.width), -2.0
    m, v = np.zeros(positive.width + 1), np.zeros(positive.width + 1)
    for t in range(1, steps + 1):
        on_p, on_u = (1 / (1 + np.exp(-np.clip(x.times(w) + b, -40, 40))) for x in (positive, unlabelled))
        d_p, d_u = on_p * (1 - on_p) / positive.n, on_u * (1 - on_u) / unlabelled.n
        rise_p, rise_u = np.append(positive.back(d_p), d_p.sum()), np.append(unlabelled.back(d_u), d_u.sum())
        negative = on_u.mean() - prior * on_p.mean()
        minus = rise_u - prior * rise_p
        grad = minus - prior * rise_p if negative >= 0 else -minus
        grad[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", learn: Column | None = None, rows: int | None = None) -> Model:
    """A model from the rows of docs for which ``learn`` holds (default: crc32 of the id modulo 4 is not 2).

    Labels for unknown ids, null ids and null labels are ignored; of repeated labels the largest counts. The class prior is the share of
    toxic rows among the labelled ones. Without a confirmed row, an unlabelled one, or an input that tells them apart, every score is 0. ``rows`` is the number of
    docs, counted if it is not given; a draw from a table so large that gives no row is an error."""
    learn = remainder(F.col("id"), 4) != 2 if learn is None else learn
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.max("y").alias("y"))
    marks = marks.where(learn)
    seen = marks.agg(F.count("*"), F.coalesce(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)), F.lit(0))).first()
    nothing = Model({}, -40.0)
    if not seen[1]:
        return nothing
    rows = docs.count() if rows is None else rows
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    positive = marks.where((F.col("y") == 1) & drawn(F.col("id"), MAX_POSITIVE, seen[1], 6)).select(F.col("id").alias("of"))
    both = texts.join(maybe_broadcast(positive), F.col("id") == F.col("of"), "left")
    as_what = F.array_compact(F.array(F.when(F.col("of").isNotNull(), 1), F.when(learn & drawn(F.col("id"), MAX_UNLABELLED, rows, 6), 0)))
    chosen = both.select("text", as_what.alias("as")).where("size(as) > 0")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, "text"):
                data, at = utf8(piece.column(0))
                found = [named(data[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(1), pa.array(found, pa.list_(pa.binary()))], names=["as", "words"])

    sample = materialise(chosen.mapInArrow(sets, "as array<int>, words array<binary>").select(F.explode("as").alias("p"), "words"), "sample")
    size = {r.p: r.n for r in sample.groupBy("p").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = size.get(1, 0), size.get(0, 0)
    if rows > MAX_UNLABELLED and not n_u:
        raise ValueError("no unlabelled row was drawn")
    if not n_p or not n_u:
        return nothing
    rates = sample.select("p", F.explode("words").alias("word")).groupBy("word").agg(F.sum("p").alias("a"), F.sum(1 - F.col("p")).alias("b")).where(f"a + b >= {LEAST_TEXTS}")
    pooled = (F.col("a") + F.col("b")) / (n_p + n_u)
    z = (F.col("a") / n_p - F.col("b") / n_u) / F.sqrt(pooled * (1 - pooled + 1e-9) * (1 / n_p + 1 / n_u))
    place = {bytes(r.word): i for i, r in enumerate(rates.where(z >= LEAST_Z).select("word").orderBy("word").collect())}
    if not place:
        return nothing

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[place[w] for w in row if w in place] for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["p", "at"])

    got = [(r.p, sorted(r["at"])) for r in sample.mapInArrow(columns, "p int, at array<int>").collect()]  # about MAX_POSITIVE + MAX_UNLABELLED rows
    release(sample)
    made = [Rows([np.array(at, np.int64) for p, at in sorted(got) if p == k], len(place)) for k in (1, 0)]  # rows arrive in any order
    weights, bias = fit(*made, seen[1] / seen[0])
    return Model({x: float(weights[i]) for x, i in place.items()}, bias)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with P(toxic) of each whole text, in the same task and row; null and empty texts get the bias alone. A column of that name
    is replaced; all others stay as they are."""
    keep = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, text):
                data, at = utf8(piece.column(piece.schema.get_field_index(text)))
                got = model.score([data[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)])
                yield pa.RecordBatch.from_arrays([*piece.select(keep).columns, pa.array(got, pa.float64())], names=[*keep, name])

    return docs.select(*keep).mapInArrow(run, docs.select(*keep).schema.add(name, "double"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``op6_toxicity``."""
    r = score(docs.select("doc_id", "text"), train(docs, labels))
    return r.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows whose score reaches the threshold; all their columns stay, whatever their names.

    Each row is judged by its own text: null and empty texts get the bias alone, repeated rows the same verdict. Without a confirmed
    toxic label nothing is dropped; an empty table stays empty."""
    name = free_name("toxicity_score", docs)
    return score(docs, train(docs, labels, text=text), text, name).where(F.col(name) < THRESHOLD).drop(name)
