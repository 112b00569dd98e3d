"""Byte-level BPE by a tree of joins: halves are encoded for themselves and neighbours are joined by encoding again what lies around their boundary.

Two facts make the joins exact. *Within a piece of text*: tokens are what the merges give for their bytes if and only if each two neighbours are
what the merges give for these two alone, since the first merge across any boundary would be made there as well. So a join tests the pair at
the boundary; if it does not hold, a window of 1, 2, 4, ... tokens on each side is encoded again until the pairs at both its ends hold.
*Between pieces*: the pattern that cuts a text looks no further than AHEAD characters beyond a match and never back, so the left side's
matches that end so far before its end stay, and from the first new match that starts where one of the right side starts all the rest is the same.

Decoding concatenates the bytes of tokens up the same kind of tree. Rows are independent, so nothing is shuffled; a task holds one text at a
time with its tokens. Odd rows: a null text is empty, an empty one has no tokens, bytes that are not UTF-8 count as U+FFFD.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from seqloom.llm.shared import in_pieces

#: Characters beyond its end that a match of the pattern may depend on: two, for the longest of the endings 's, 're and so on, or one after a run of space.
AHEAD = 2
#: Characters and bytes that are encoded without halving; pieces that a task remembers.
SEGMENT, LEAF, REMEMBERED = 1 << 15, 64, 1 << 18
#: A vocabulary travels with the tasks, so it has a bound.
VOCABULARY_BYTES = 64 << 20

#: Tokens are kept packed: four bytes each, the least first.
WIDTH = 4
Part = tuple[np.ndarray, np.ndarray, bytes]


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


class _Known(dict):
    """The packed tokens of the pieces met so far; a piece is encoded when it is first asked for."""

    def __init__(self, encode: Callable[[str], bytes], longest: int):
        super().__init__()
        self.encode, self.longest = encode, longest

    def __missing__(self, piece: str) -> bytes:
        out = self.encode(piece)
        if len(piece) <= self.longest:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = out
        return out


class Codec:
    """Encoder and decoder of one vocabulary, from the bytes of its file of ranks."""

    def __init__(self, ranks: bytes, pattern: str, segment: int = SEGMENT, leaf: int = LEAF):
        pairs = (line.split() for line in ranks.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern, self.segment, self.leaf = regex.compile(pattern), segment, leaf
        self.known = _Known(self._piece, leaf)
        self.fits = lru_cache(1 << 16)(lambda a, b: self.merged(self.tokens[a] + self.tokens[b]) == [a, b])

    def merged(self, piece: bytes) -> list[int]:
        """The merges by definition: always the pair of least rank, of equals the leftmost."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at i
        waiting = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(waiting)
        while waiting:
            _, i, stop = heapq.heappop(waiting)
            middle = end[i]
            if middle < 0 or middle >= n or end[middle] != stop or middle == stop:
                continue
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(waiting, (r, i, end[stop]))
            if (j := before[i]) >= 0 and (r := ranks.get(piece[j:stop])) is not None:
                heapq.heappush(waiting, (r, j, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def halved(self, piece: bytes) -> list[int]:
        """The same for pieces of any length."""
        if len(piece) <= self.leaf:
            return self.merged(piece)
        half = -(-len(piece) // (2 * self.leaf)) * self.leaf
        return self.joined(self.halved(piece[:half]), self.halved(piece[half:]))

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        if self.fits(left[-1], right[0]):
            return left + right
        k = 1
        while True:
            window = self.merged(b"".join(map(self.tokens.__getitem__, left[-k:] + right[:k])))
            if (k >= len(left) or self.fits(left[-k - 1], window[0])) and (k >= len(right) or self.fits(window[-1], right[k])):
                return left[:-k] + window + right[k:]
            k *= 2

    def _piece(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        return packed([whole] if whole is not None else self.halved(data))

    def _of_pieces(self, pieces: list[str]) -> Part:
        """Lengths of the pieces, how many tokens each has, and the tokens."""
        ids = list(map(self.known.__getitem__, pieces))
        n = len(pieces)
        return np.fromiter(map(len, pieces), np.int64, n), np.fromiter(map(len, ids), np.int64, n) // WIDTH, b"".join(ids)

    def _part(self, text: str, lo: int, hi: int) -> Part:
        """(where pieces start in the text, how many tokens each has, the tokens) of text[lo:hi] for itself."""
        if hi - lo <= self.segment:
            lengths, counts, ids = self._of_pieces(self.pattern.findall(text[lo:hi]))
            return lo + np.cumsum(lengths) - lengths, counts, ids
        middle = (lo + hi) // 2
        return self._adjoined(text, middle, hi, self._part(text, lo, middle), self._part(text, middle, hi))

    def _adjoined(self, text: str, middle: int, hi: int, left: Part, right: Part) -> Part:
        """The part of two neighbours."""
        starts, counts, ids = left
        ends = np.append(starts[1:], middle)
        keep = int(np.searchsorted(ends, middle - AHEAD, side="right"))  # the matches that what follows can't change
        begin = int(starts[keep]) if keep < len(starts) else middle
        reach = 64
        while True:
            stop = min(hi, middle + reach)
            sure = hi if stop == hi else stop - AHEAD
            fresh, at = [], begin
            for piece in self.pattern.findall(text[begin:stop]):
                if at >= middle and ((j := int(np.searchsorted(right[0], at))) < len(right[0]) and right[0][j] == at):
                    break
                if at + len(piece) > sure:
                    at = -1
                    break
                fresh.append(piece)
                at += len(piece)
            if at >= 0:
                break
            reach *= 2
        lengths, more, tokens = self._of_pieces(fresh)
        again = begin + np.cumsum(lengths) - lengths
        j = int(np.searchsorted(right[0], at))
        a, b = int(counts[keep:].sum()), int(right[1][:j].sum())
        return np.concatenate([starts[:keep], again, right[0][j:]]), np.concatenate([counts[:keep], more, right[1][j:]]), ids[: len(ids) - WIDTH * a] + tokens + right[2][WIDTH * b :]

    def encode(self, text: str) -> bytes:
        """The packed tokens of a text."""
        if len(text) <= self.segment:
            return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))
        return self._part(text, 0, len(text))[2]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed tokens; a number that is no token raises KeyError."""
        if len(ids) <= WIDTH * self.segment:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        half = len(ids) // (2 * WIDTH) * WIDTH
        return self.decode(ids[:half]) + self.decode(ids[half:])


@lru_cache(2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def read_ranks(path: str) -> bytes:
    """The file of ranks (a line for each token: base 64, rank), read where the driver is; tasks get its bytes."""
    with open(path, "rb") as f:
        out = f.read(VOCABULARY_BYTES + 1)
    if len(out) > VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary has at most {VOCABULARY_BYTES} bytes")
    return out


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but ``ids``, unless named) and ``ids``: the tokens as little-endian unsigned 32-bit numbers, packed."""
    keep = [c for c in docs.columns if c.lower() != ids.lower()] if keep is None else keep
    given = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("binary").alias("_text_of_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for part in in_pieces(batch, "_text_of_ids"):
                out = [codec.encode(t.as_py().decode("utf-8", "replace") if t.is_valid else "") for t in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(out, pa.binary())], names=[*keep, ids])

    return given.mapInArrow(run, StructType([*given.schema[:-1], StructField(ids, BinaryType())]))


def decode(encoded: DataFrame, ranks: bytes, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """encoded with ``data``: the bytes of its tokens; null tokens have none."""
    keep = [c for c in encoded.columns if c.lower() != data.lower()]
    given = encoded.select(*(F.col(f"`{c}`") for c in keep))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks, pattern)
        for batch in batches:
            for part in in_pieces(batch, ids):
                out = [codec.decode(t.as_py()) if t.is_valid else b"" for t in part.column(keep.index(ids))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*keep, data])

    return given.mapInArrow(run, StructType([*given.schema, StructField(data, BinaryType())]))


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The rows of ``op12_byte_bpe``: digests of the tokens and of what they decode to."""
    ranks = read_ranks(path)
    x = decode(encode(docs, ranks, pattern, keep=["doc_id"]), ranks, pattern)
    return x.select("doc_id", F.floor(F.octet_length("ids") / WIDTH).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))

