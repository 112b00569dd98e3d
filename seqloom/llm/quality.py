"""Quality by a generalised additive model with pairwise interactions.

Shallow trees, boosted in turn feature by feature with a small step, add up to one lookup table for each feature; the pairs that
explain most of what is left get two-way tables the same way. A score is a sum of table cells, taken for whole batches at once.

Inputs are figures of the whole text alone (``FEATURES``). Fitting takes at most about ``MAX_ROWS`` labelled rows, drawn by a hash of the
id, and only their figures reach the driver; scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from seqloom.llm.shared import drawn, free_name, in_pieces, maybe_broadcast, remainder, utf8

MAX_ROWS = 20_000
THRESHOLD = 0.7
BINS, PAIR_BINS, PAIRS = 48, 12, 4
FEATURES = ("log_bytes", "log_words", "word_length", "upper", "symbols", "digits", "stops", "beyond_ascii", "words_a_line", "distinct_words", "distinct_lines", "shouted", "marked", "middle_word")
_CLASS = np.zeros(256, np.uint8)
for _c, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".,;:?'\"()-", b"!#$%&*@^_~|<>={}[]\\/+`"), 1):
    _CLASS[list(_chars)] = _c
_CLASS[128:] = 6
_CLASS[[32, *range(9, 14)]] = 7


def figures(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text; an empty text has zeros but for its one line.

    middle_word is the share of the words that equal the one in the middle, a cheap sign of endless repetition."""
    n = len(at) - 1
    kind = _CLASS[data[at[0] : at[-1]]]
    edge = at - at[0]
    size = np.diff(edge).astype(np.float64)
    count = {}
    for c in range(1, 7):
        total = np.concatenate([[0], np.cumsum(kind == c)])
        count[c] = np.diff(total[edge]).astype(np.float64)
    by_word = np.zeros((n, 6))
    for i in range(n):
        text = data[at[i] : at[i + 1]].tobytes()
        each = text.split()
        if each:
            lines = text.split(b"\n")
            tally = len(set(each))
            shouted = sum(map(bytes.isupper, each))
            marked = sum(w[-1] in b"!#$%&*@" for w in each)
            top = each.count(each[len(each) // 2])
            by_word[i] = len(each), tally / len(each), len(set(lines)) / len(lines), shouted / len(each), marked / len(each), top / len(each)
    lines = 1 + np.diff(np.concatenate([[0], np.cumsum(data[at[0] : at[-1]] == 10)])[edge])
    full, letters = np.maximum(size, 1), np.maximum(count[1] + count[2] + count[6], 1)
    w = np.maximum(by_word[:, 0], 1)
    return np.stack([
        np.log1p(size), np.log1p(by_word[:, 0]), size / w, count[1] / letters, count[5] / full, count[3] / full, count[4] / full,
        count[6] / full, by_word[:, 0] / lines, by_word[:, 1], by_word[:, 2], by_word[:, 3], by_word[:, 4], by_word[:, 5],
    ], axis=1)


@dataclass
class Gam:
    bias: float
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    told: bool = False  # True if it has seen both classes

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(self.cuts)], axis=1) if self.cuts else np.zeros((len(x), 0), int)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.bias)
        for f, table in enumerate(self.tables):
            out += table[bins[:, f]]
        for f, g, table in self.pairs:
            out += table[_coarse(bins[:, f], self.cuts[f]), _coarse(bins[:, g], self.cuts[g])]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -40, 40)))


def _coarse(bins: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    return bins * PAIR_BINS // (len(cuts) + 1)


def _tree(grad: np.ndarray, hess: np.ndarray, depth: int, least: float = 5.0) -> np.ndarray:
    """Newton values of a tree of that depth over ordered bins."""
    out = np.zeros(len(grad))

    def grow(a: int, b: int, d: int) -> None:
        g, h = np.cumsum(grad[a:b]), np.cumsum(hess[a:b])
        value = g[-1] / (h[-1] + 1.0)
        if d and b - a > 1:
            gain = g[:-1] ** 2 / (h[:-1] + 1) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + 1)
            gain = np.where((h[:-1] >= least) & (h[-1] - h[:-1] >= least), gain, -np.inf)
            k = int(gain.argmax())
            if gain[k] > g[-1] * value + 1e-9:
                grow(a, a + k + 1, d - 1)
                grow(a + k + 1, b, d - 1)
                return
        out[a:b] = value

    grow(0, len(grad), depth)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.1) -> Gam:
    """The model for figures x and labels y in 0 and 1. No rows: every score is 0.5; one class: its smoothed rate."""
    rate_1 = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(rate_1 / (1 - rate_1))))
    if not len(y):
        return model
    model.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    bins, margin = model.bins(x), np.full(len(y), model.bias)
    if 0 < y.sum() < len(y):
        model.told = True
        for _ in range(rounds):
            for f, table in enumerate(model.tables):
                p = 1 / (1 + np.exp(-margin))
                step = rate * _tree(np.bincount(bins[:, f], y - p, len(table)), np.bincount(bins[:, f], p * (1 - p), len(table)), 2, 1.0)
                table += step
                margin += step[bins[:, f]]
        p = 1 / (1 + np.exp(-margin))
        coarse = [_coarse(bins[:, f], c) for f, c in enumerate(model.cuts)]
        grid = lambda f, g, v: np.bincount(coarse[f] * PAIR_BINS + coarse[g], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
        gain = {(f, g): (grid(f, g, y - p) ** 2 / (grid(f, g, p * (1 - p)) + 1)).sum() for f in range(x.shape[1]) for g in range(f)}
        model.pairs = [(f, g, np.zeros((PAIR_BINS, PAIR_BINS))) for f, g in sorted(gain, key=lambda k: (-gain[k], k))[:PAIRS]]
        for _ in range(rounds // 3):
            for f, g, table in model.pairs:
                p = 1 / (1 + np.exp(-margin))
                a, b = grid(f, g, y - p), grid(f, g, p * (1 - p))
                cut = _tree(a.sum(axis=1), b.sum(axis=1), 1, 1.0)
                step = np.zeros_like(table)
                for value in np.unique(cut):
                    rows = cut == value
                    step[rows] = _tree(a[rows].sum(axis=0), b[rows].sum(axis=0), 1, 1.0)
                table += rate * step
                margin += rate * step[coarse[f], coarse[g]]
    return model


def _figures_of(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, text):
                x = figures(*utf8(piece.column(piece.schema.get_field_index(text))))
                yield pa.RecordBatch.from_arrays([*piece.select(keep).columns, pa.array(list(x), pa.list_(pa.float64()))], names=[*keep, "x"])

    return df.mapInArrow(run, df.select(*keep).schema.add("x", ArrayType(DoubleType())))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", learn: Column | None = None, marked: int | None = None) -> Gam:
    """A model from the labelled rows of docs for which ``learn`` holds (default: crc32 of the id modulo 4 is not 2).

    Labels for unknown ids, null ids and null labels are ignored; of repeated labels the smallest counts. ``marked`` is the number of
    labelled ids, counted if it is not given; a draw from more labels than MAX_ROWS that gives none is an error."""
    learn = remainder(F.col("id"), 4) != 2 if learn is None else learn
    marks = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.min("y").cast("int").alias("y")).where(learn)
    marked = marks.count() if marked is None else marked
    marks = marks.where(drawn(F.col("id"), MAX_ROWS, marked, 9))
    if marked > MAX_ROWS and marks.isEmpty():
        raise ValueError("no labelled row was drawn")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(maybe_broadcast(marks), "id")
    got = _figures_of(rows, "text", ["y"]).toPandas()  # about MAX_ROWS rows of figures
    x = np.stack(list(got["x"])) if len(got) else np.zeros((0, len(FEATURES)))
    y = got["y"].to_numpy(np.float64)
    order = np.lexsort((y, *x.T))  # rows arrive in any order
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Gam, text: str = "text", name: str = "score") -> DataFrame:
    """docs with P(good) of each whole text; null counts as empty. A column of that name is replaced; all others stay."""
    keep = [c for c in docs.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, text):
                got = model.score(figures(*utf8(piece.column(piece.schema.get_field_index(text)))))
                yield pa.RecordBatch.from_arrays([*piece.select(keep).columns, pa.array(got, pa.float64())], names=[*keep, name])

    return docs.select(*keep).mapInArrow(run, docs.select(*keep).schema.add(name, "double"))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of ``op9_quality_classifier``."""
    r = score(docs.select("doc_id", "text"), train(docs, labels))
    return r.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """docs without the rows whose score is below the threshold; all their columns stay, whatever their names.

    Each row is judged by its own text: null counts as empty, repeated rows get the same verdict. Labels of one class only, or none, teach
    nothing to tell apart, so all rows stay; an empty table stays empty."""
    model = train(docs, labels, text=text)
    if not model.told:
        return docs
    name = free_name("quality_score", docs)
    return score(docs, model, text, name).where(F.col(name) >= THRESHOLD).drop(name)
