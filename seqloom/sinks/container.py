"""Model containers: one binary file of metadata, an index and chain models, written from rows and read back to rows.

Both directions walk the same description of fields. Texts are followed by zeros up to a multiple of eight bytes of the file.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The first four bytes, the version, the header's fields and the size that it states.
MAGIC, VERSION, STATED = 0x314D564E, 0x00010000, 64
HEADER = struct.Struct("<IIIIQQQQQII8x")
HEADER_FIELDS = ["magic", "version", "chunks", "header_size", "file_size", "models_at", "metadata_at", "index_at", "created", "checksum", "compression"]

#: Fields of a model in the order of the file: s text, I and i 32-bit numbers, d a double.
MODEL = [
    ("name", "s"), ("model_id", "I"), ("left", "s"), ("current", "s"), ("right", "s"), ("position_in_syllable", "i"), ("syllable_length", "i"),
    ("position_in_word", "i"), ("word_length", "i"), ("pitch_cents", "d"), ("note_duration_ms", "d"), ("lyric", "s"), ("tempo_bpm", "d"), ("beat_position", "i"),
]
STATES = "array<struct<state_id: int, self_loop: double, next_state: double, exit: double, mixture: array<struct<weight: double, mean: array<double>, cov: array<array<double>>>>>>"
_KINDS = {"s": "string", "I": "bigint", "i": "int", "d": "double"}
MODEL_SCHEMA = ", ".join(f"{n} {_KINDS[k]}" for n, k in MODEL) + f", states {STATES}"
MOST_MODELS = 65_536


class _Out:
    def __init__(self, start: int):
        self.start, self.parts, self.size = start, [], 0

    def raw(self, data: bytes) -> None:
        self.parts.append(data)
        self.size += len(data)

    def put(self, kind: str, value) -> None:
        if kind != "s":
            self.raw(struct.pack("<" + kind, value or 0))
            return
        body = (value or "").encode()
        self.raw(struct.pack("<I", len(body)) + body)
        self.raw(bytes(-(self.start + self.size) % 8))

    def doubles(self, values) -> None:
        self.raw(struct.pack(f"<{len(values)}d", *values))


class _In:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def get(self, kind: str):
        if kind != "s":
            (value,) = struct.unpack_from("<" + kind, self.data, self.at)
            self.at += struct.calcsize("<" + kind)
            return value
        size = self.get("I")
        if self.at + size > len(self.data):
            raise ValueError("text beyond the end")
        body = self.data[self.at : self.at + size]
        self.at += size
        self.at += -self.at % 8
        return body.decode(errors="replace")

    def doubles(self, n: int) -> list[float]:
        found = struct.unpack_from(f"<{n}d", self.data, self.at)
        self.at += 8 * n
        return list(found)


def _put_states(out: _Out, states) -> None:
    out.put("I", len(states or []))
    for s in states or []:
        out.put("i", s["state_id"])
        out.doubles([s["self_loop"] or 0, s["next_state"] or 0, s["exit"] or 0])
        mixture = s["mixture"] or []
        out.put("I", len(mixture))
        out.put("i", len(mixture[0]["mean"]) if mixture else 0)
        out.doubles([c["weight"] for c in mixture])
        for c in mixture:
            out.put("I", len(c["mean"]))
            out.doubles(c["mean"])
            out.put("I", len(c["cov"]))
            out.put("I", len(c["cov"][0]) if c["cov"] else 0)
            for row in c["cov"]:
                out.doubles(row)
            out.doubles([c["weight"]])


def _get_states(found: _In) -> list[dict]:
    states = []
    for _ in range(found.get("I")):
        s = {"state_id": found.get("i"), **dict(zip(("self_loop", "next_state", "exit"), found.doubles(3), strict=True)), "mixture": []}
        n = found.get("I")
        found.get("i")
        found.doubles(n)
        for _ in range(n):
            mean = found.doubles(found.get("I"))
            rows, columns = found.get("I"), found.get("I")
            cov = [found.doubles(columns) for _ in range(rows)]
            s["mixture"].append({"weight": found.doubles(1)[0], "mean": mean, "cov": cov})
        states.append(s)
    return states


def encode(models: list[dict], metadata: str = "{}", created: int = 0) -> bytes:
    """The bytes of a container; offsets and the file's size are set, the index holds each model's place, size and its label's CRC-32."""
    if len(models) > MOST_MODELS:
        raise ValueError(f"{len(models)} models, more than the {MOST_MODELS} that a container holds")
    head = _Out(HEADER.size)
    head.put("s", metadata)
    index_at = HEADER.size + head.size
    # An index entry's size doesn't depend on its numbers, so the models' places are known once it is written with zeros.
    index = _index(index_at, models, [(0, 0)] * len(models))
    models_at = index_at + index.size
    body, places = _Out(models_at), []
    body.put("I", len(models))
    for m in models:
        at = body.size
        for name, kind in MODEL:
            body.put(kind, m.get(name))
        _put_states(body, m.get("states"))
        places.append((models_at + at, body.size - at))
    index = _index(index_at, models, places)
    header = HEADER.pack(MAGIC, VERSION, 3, STATED, models_at + body.size, models_at, HEADER.size, index_at, created, 0, 0)
    return header + b"".join(head.parts + index.parts + body.parts)


def _index(start: int, models: list[dict], places: list[tuple[int, int]]) -> _Out:
    out = _Out(start)
    out.put("I", len(models))
    for m, (at, size) in zip(models, places, strict=True):
        out.put("s", m.get("name"))
        out.put("Q", at)
        out.put("I", size)
        out.put("I", zlib.crc32((m.get("current") or "").encode()))
    return out


def header(data: bytes) -> dict[str, int] | None:
    """The header's fields; None for what is no container of a known version."""
    if len(data) < HEADER.size:
        return None
    found = dict(zip(HEADER_FIELDS, HEADER.unpack_from(data), strict=True))
    return found if found["magic"] == MAGIC and found["version"] >= VERSION and found["header_size"] == STATED else None


def decode(data: bytes) -> tuple[str, list[dict]] | None:
    """(metadata, models) of a container; None for what is none or ends too early. Parts follow the header, whatever offsets it states."""
    if header(data) is None:
        return None
    try:
        found = _In(data, HEADER.size)
        text = found.get("s")
        for _ in range(found.get("I")):
            for kind in "sQII":
                found.get(kind)
        return text, [{**{name: found.get(kind) for name, kind in MODEL}, "states": _get_states(found)} for _ in range(found.get("I"))]
    except (struct.error, ValueError):
        return None


def estimated_size(states: str = "states", name: str = "name") -> Column:
    """SQL for the bytes a model takes by a rule of thumb: its name, 208 for identity and context, then states and their mixtures."""
    part = "aggregate(s.mixture, 0L, (a, c) -> a + 16 + 8 * size(c.mean) + 8 * size(c.mean) * size(c.mean))"
    return F.expr(f"octet_length({name}) + 4 + 4 + 200 + 4 + aggregate({states}, 0L, (b, s) -> b + 36 + {part})")


def write_rows(models: DataFrame, container: str, metadata: dict | None = None) -> DataFrame:
    """(container, content): each container's models by name in one file; their number, at most 65,536, bounds what meets in one task."""
    text = json.dumps(metadata or {}, ensure_ascii=False, sort_keys=True)
    kind = dict(models.dtypes)[container]

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["name"] or "", r["model_id"] or 0))
        return pa.table({container: table.column(container).slice(0, 1), "content": pa.array([encode(rows, text)], pa.binary())})

    return models.select(container, *(n for n, _ in MODEL), "states").groupBy(container).applyInArrow(run, f"{container} {kind}, content binary")


def read_rows(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, the fields of a model, states): one row a model; files that are no containers, and null contents, give none."""
    schema = StructType.fromDDL(f"{path} {dict(files.dtypes)[path]}, {MODEL_SCHEMA}")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = decode(data) if data else None
                if found and found[1]:
                    yield pa.RecordBatch.from_pylist([{path: where, **m} for m in found[1]], schema=arrow)

    return files.select(path, content).mapInArrow(run, schema)
