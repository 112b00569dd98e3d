"""Baseline JPEG media columns: markers, Huffman-coded scans, DC-only luminance thumbnails and their hashes.

The decoder works on whole batches: every restart interval of every image is a lane, and one numpy step decodes one Huffman symbol
of all lanes. Progressive, lossless, arithmetic and 12-bit files are reported as errors, row by row, and never fail the job.

``store_payload`` keeps arbitrary bytes without loss in the format's own unit, the quantised coefficient: byte b is coefficient
b-128, or b-127 from 128 upwards, so that none is zero; nine blocks hold 576 bytes, and each block is a restart interval.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from seqloom.llm.shared import chunks, utf8

# The typical luminance Huffman tables of ITU-T T.81, Annex K.3.
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_VALUES = bytes(range(12))
AC_BITS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 0x7D)
AC_VALUES = bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
    "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
    "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
)
UNIT, WIDE = 576, 9  # bytes and blocks in a row of blocks


#: Rows of blocks in a stored image at most, blocks that are encoded, and decoded, together.
MOST_ROWS, SLICE, TOGETHER = 8_191, 16_384, 65_536


class BadImage(ValueError):
    pass


def codes(bits: tuple[int, ...], values: bytes) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length): canonical codes, shortest first."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[values[k]] = (code, length)
            code, k = code + 1, k + 1
        code <<= 1
    return out


def lookup(bits: tuple[int, ...], values: bytes) -> np.ndarray:
    """For each 16-bit window: code length * 256 + symbol, or 0 where no code begins."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, (code, length) in codes(bits, values).items():
        out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
    return out


def _byte_codes(table: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """For each payload byte: Huffman code and value bits in one, and their length."""
    out = []
    for b in range(256):
        v = b - 128 if b < 128 else b - 127
        size = abs(v).bit_length()
        code, length = table[size]
        out.append((code << size | (v if v > 0 else v + (1 << size) - 1), length + size))
    return out


DC_CODE, AC_CODE = (tuple(np.array(x) for x in zip(*_byte_codes(codes(*t)), strict=True)) for t in ((DC_BITS, DC_VALUES), (AC_BITS, AC_VALUES)))
#: Rows 0-255: the bits of a byte as DC; 256-511: as AC; 512-519: so many one bits, which fill the last byte of a block.
_ROWS = [*zip(*DC_CODE, strict=True), *zip(*AC_CODE, strict=True), *((2**n - 1, n) for n in range(8))]
BIT_USED = np.array([[j < n for j in range(18)] for _, n in _ROWS])
BIT_ROWS = np.array([[(w >> max(n - 1 - j, 0)) & 1 for j in range(18)] for w, n in _ROWS], np.uint8)
MARKS = [bytes([255, 0xD0 + k]) for k in range(8)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(n_bytes: int, rows: int) -> bytes:
    return b"".join([
        b"\xff\xd8", _segment(0xFE, b"payload %d" % n_bytes), _segment(0xDB, b"\0" + b"\1" * 64),
        _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, WIDE * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, b"\0" + bytes(DC_BITS) + DC_VALUES), _segment(0xC4, b"\x10" + bytes(AC_BITS) + AC_VALUES),
        _segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


def encode(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload; at most 65,535 / 8 rows of 576 bytes, and longer payloads as several images one after another."""
    images = []
    for p in payloads:
        full, made = p + b"\xff" * (-len(p) % UNIT if p else UNIT), []
        for k in range(0, len(full), MOST_ROWS * UNIT):
            part = full[k : k + MOST_ROWS * UNIT]
            made += [_header(max(0, min(len(p) - k, MOST_ROWS * UNIT)), len(part) // UNIT), _scan_of(np.frombuffer(part, np.uint8).reshape(-1, 64)), b"\xff\xd9"]
        images.append(b"".join(made))
    return images


def _scan_of(data: np.ndarray) -> bytes:
    """The entropy-coded blocks, a restart marker between any two, SLICE blocks at a time: their bits take 40 times their size."""
    scan, k = [], 0
    for i in range(0, len(data), SLICE):
        rows = data[i : i + SLICE]
        size = np.concatenate([DC_CODE[1][rows[:, :1]], AC_CODE[1][rows[:, 1:]]], axis=1).sum(axis=1)
        fill = -size % 8
        of = np.concatenate([rows[:, :1].astype(np.int16), rows[:, 1:].astype(np.int16) + 256, (fill + 512).astype(np.int16)[:, None]], axis=1)
        raw, start = np.packbits(BIT_ROWS[of][BIT_USED[of]]).tobytes(), 0
        for end in np.cumsum((size + fill) // 8).tolist():
            scan += (raw[start:end].replace(b"\xff", b"\xff\0"), MARKS[k & 7])
            start, k = end, k + 1
    return b"".join(scan[:-1])


def parse(data: bytes, start: int = 0, found: dict | None = None) -> dict:
    """Markers up to the next scan: of the image that begins at ``start``, or, given what was found of it, those after a scan.

    Gives frame, tables, restart interval, comment, the scan's parts and tables (``of``, ``tables``) and the place of its bytes; at the end
    of the image ``scan`` is None and ``end`` the place after it."""
    if found is None:
        if data[start : start + 2] != b"\xff\xd8":
            raise BadImage("no start of image")
        found = {"dc": {}, "ac": {}, "q": {}, "restart": 0, "comment": b""}
        at = start + 2
    else:
        at = start
    while True:
        while at + 1 < len(data) and data[at] == 255 and data[at + 1] == 255:
            at += 1
        if data[at : at + 2] == b"\xff\xd9" and "parts" in found:
            return found | {"scan": None, "end": at + 2}
        if at + 4 > len(data) or data[at] != 255:
            raise BadImage("a marker is missing")
        kind, (length,) = data[at + 1], struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + length]
        if length < 2 or len(body) != length - 2:
            raise BadImage("a segment is cut off")
        at += 2 + length
        try:
            if kind == 0xC4:
                while body:
                    n = sum(body[1:17])
                    found["ac" if body[0] >> 4 else "dc"][body[0] & 15] = (tuple(body[1:17]), bytes(body[17 : 17 + n]))
                    body = body[17 + n :]
            elif kind == 0xDB:
                while body:
                    wide = 2 if body[0] >> 4 else 1
                    found["q"][body[0] & 15] = int.from_bytes(body[1 : 1 + wide], "big")
                    body = body[1 + 64 * wide :]
            elif kind in (0xC0, 0xC1):
                precision, found["height"], found["width"], n = struct.unpack_from(">BHHB", body)
                found["parts"] = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
                if precision != 8 or not n or not found["width"] or not found["height"] or any(not 1 <= x <= 4 for p in found["parts"] for x in p[1:3]):
                    raise BadImage("unsupported frame")
            elif 0xC2 <= kind <= 0xCF and kind not in (0xC8, 0xCC):
                raise BadImage("not baseline")
            elif kind == 0xDD:
                (found["restart"],) = struct.unpack(">H", body)
            elif kind == 0xFE:
                found["comment"] = bytes(body)
            elif kind == 0xDA:
                chosen = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                known = [p[0] for p in found["parts"]]
                if not chosen or any(c not in known for c in chosen):
                    raise BadImage("a scan of unknown parts")
                found["of"] = [i for i, p in enumerate(known) if p in chosen]
                found["tables"] = [chosen[known[i]] for i in found["of"]]
                break
        except (IndexError, KeyError, struct.error) as e:
            raise BadImage("a segment is malformed") from e
    found["scan"] = at
    return found


def _scan(data: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The scan's bytes without stuffing and markers, the edges of its restart intervals, and where the scan ends."""
    ff = np.flatnonzero(data[at:-1] == 255) + at
    after = data[ff + 1]
    other = ff[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))]
    end = int(other[0]) if len(other) else len(data)
    cuts = ff[(after >= 0xD0) & (after <= 0xD7) & (ff < end)]
    keep = np.ones(end - at, bool)
    keep[ff[(ff + 1 < end) & (after == 0)] + 1 - at] = False
    keep[cuts - at] = False
    keep[cuts + 1 - at] = False
    body, count = data[at:end][keep], np.cumsum(keep, dtype=np.int64)
    return body, np.concatenate([[0], count[cuts - at], [len(body)]]), end


def decode(images: list[bytes]) -> list[list[dict] | str]:
    """For each row the images that follow one another in its bytes, or the error that stopped it.

    An image has width, height, comment, q (the luminance DC step), luma (rows of DC values) and coefficients (blocks in coding
    order, scan after scan, zigzag order within). Its parts may come in one scan or in several."""
    out: list[list[dict] | str] = []
    scans: list[tuple[np.ndarray, np.ndarray, dict]] = []  # bytes, edges of restart intervals, scan
    tables: dict[tuple, int] = {}
    for raw in images:
        try:
            row, at = [], 0
            data = np.frombuffer(raw, np.uint8)
            mine = []
            while at < len(raw):
                image = parse(raw, at)
                image["scans"] = []
                while image["scan"] is not None:
                    scan, at = _plan(image, data, tables)
                    image["scans"].append(scan[2])
                    mine.append(scan)
                    image = parse(raw, at, image)
                at = image["end"]
                if sorted(i for x in image["scans"] for i in x["of"]) != list(range(len(image["parts"]))):
                    raise BadImage("a part has no scan, or several")
                row.append(image)
            if not row:
                raise BadImage("empty")
            scans += mine
            out.append(row)
        except (BadImage, KeyError) as e:
            out.append(str(e) if isinstance(e, BadImage) else "a table is missing")
    every = [lookup(*k[1:]) for k in tables]
    i = 0
    while i < len(scans):  # some scans at a time, by their blocks
        j, total = i, 0
        while j < len(scans) and (j == i or total + scans[j][2]["n"] <= TOGETHER):
            scans[j][2]["blocks"] = (total, total + scans[j][2]["n"])
            total, j = total + scans[j][2]["n"], j + 1
        got = _symbols(scans[i:j], every, total)
        for _, _, x in scans[i:j]:
            x["coefficients"] = got[slice(*x["blocks"])]
        i = j
    for k, row in enumerate(out):
        if isinstance(row, list):
            for image in row:
                image["coefficients"] = image["scans"][0]["coefficients"] if len(image["scans"]) == 1 else np.concatenate([x["coefficients"] for x in image["scans"]])
                first = next(x for x in image["scans"] if 0 in x["of"])
                (h, v), across, down = first["luma_hv"], first["across"], first["down"]
                mine = first["coefficients"][:, 0].reshape(across * down, -1)[:, : h * v]
                image["luma"] = mine.reshape(down, across, v, h).transpose(0, 2, 1, 3).reshape(down * v, across * h)
                image["q_dc"] = image["q"].get(image["parts"][0][3], 1)
            if bad := next((x["bad"] for image in row for x in image["scans"] if x["bad"]), ""):
                out[k] = bad
    return out


def _plan(image: dict, data: np.ndarray, tables: dict[tuple, int]) -> tuple[tuple[np.ndarray, np.ndarray, dict], int]:
    """The bytes and shape of the scan that ``parse`` stands before, and where it ends.

    A scan of one part has that part's own blocks in rows; one of several has units that hold the blocks of each."""
    high, wide = max(p[2] for p in image["parts"]), max(p[1] for p in image["parts"])
    parts = [image["parts"][i] for i in image["of"]]
    if len(parts) == 1:
        _, h, v, _ = parts[0]
        columns, rows = -(-image["width"] * h // wide), -(-image["height"] * v // high)
        across, down, order, first = -(-columns // 8), -(-rows // 8), [0], (1, 1)
    else:
        across, down = -(-image["width"] // (8 * wide)), -(-image["height"] // (8 * high))
        order, first = [i for i, p in enumerate(parts) for _ in range(p[1] * p[2])], parts[0][1:3]
    mcus, body_at = across * down, image["scan"]
    n = mcus * len(order)
    body, edges, end = _scan(data, body_at)
    if 2 * n > 8 * len(body):  # a block takes two bits at least
        raise BadImage("the scan is too short")
    step = (image["restart"] or mcus) * len(order)
    if len(edges) - 1 != -(-n // step):
        raise BadImage("restart intervals are missing")
    index = [[tables.setdefault(("dc", *image["dc"][d]), len(tables)), tables.setdefault(("ac", *image["ac"][a]), len(tables))] for d, a in image["tables"]]
    return (body, edges, {"of": image["of"], "across": across, "down": down, "order": order, "luma_hv": first, "index": index, "step": step, "n": n, "bad": ""}), end


SHORT = 18


def _whole(table: np.ndarray, dc: bool) -> np.ndarray:
    """For each 18-bit window that holds a code with no run and its value bits: value << 8 | bits taken; else 0."""
    seen = np.arange(1 << SHORT)
    got = table[seen >> (SHORT - 16)].astype(np.int64)
    length, symbol = got >> 8, got & 255
    bits = symbol & 15
    value = (seen >> np.maximum(SHORT - length - bits, 0)) & ((1 << bits) - 1)
    value = np.where((bits > 0) & (value < (1 << np.maximum(bits - 1, 0))), value - (1 << bits) + 1, value)
    plain = (length > 0) & (length + bits <= SHORT) & ((symbol <= 11) if dc else (symbol < 16) & (bits > 0))
    return np.where(plain, value << 8 | length + bits, 0).astype(np.int32)


def _symbols(scans: list[tuple[np.ndarray, np.ndarray, dict]], tables: list[np.ndarray], total: int) -> np.ndarray:
    """All coefficients; one pass of a loop takes one symbol from every lane that is not at its end."""
    flat = np.concatenate([*(x for x, *_ in scans), np.zeros(8, np.uint8)])
    base = np.cumsum([0, *(len(x) for x, *_ in scans)])
    owner = np.repeat(np.arange(len(scans)), [len(e) - 1 for _, e, _ in scans])
    start, stop = (np.concatenate([b + e[c] for (_, e, _), b in zip(scans, base, strict=False)]) for c in (slice(None, -1), slice(1, None)))
    block = np.concatenate([x["blocks"][0] + x["step"] * np.arange(len(e) - 1) for _, e, x in scans])
    last = np.minimum(block + np.array([x["step"] for *_, x in scans])[owner], np.array([x["blocks"][1] for *_, x in scans])[owner])
    position, limit = start * 8, stop * 8
    out = np.zeros((64, total), np.int16)
    one = {tuple(x["index"][0]) for *_, x in scans}
    if len(one) == 1 and all(len(x["order"]) == 1 for *_, x in scans) and (last - block == 1).all():
        done = _even(flat, position, limit, block, [_whole(tables[t], not i) for i, t in enumerate(one.pop())], out)
        if done.all():
            return out.T
        owner, position, limit, block, last = (x[~done] for x in (owner, position, limit, block, last))
        out[:, block] = 0
    _any(flat, owner, position, limit, block, last, scans, tables, out)
    return out.T


def _even(flat: np.ndarray, position: np.ndarray, limit: np.ndarray, block: np.ndarray, tables: list[np.ndarray], out: np.ndarray) -> np.ndarray:
    """Lanes of one block each without zero coefficients, all in step; true for those that are done."""
    window = np.zeros(len(flat), np.uint32)
    for j in range(4):
        window[: len(flat) - j] |= flat[j:].astype(np.uint32) << np.uint32(24 - 8 * j)
    p, good = position.astype(np.int32), np.ones(len(position), bool)
    whole = len(block) == out.shape[1]
    for k in range(64):
        got = tables[k > 0][(window[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - SHORT)]
        out[k, slice(None) if whole else block] = got >> 8
        good &= got != 0
        p += got & 255
        np.minimum(p, len(flat) * 8 - 64, out=p)
    return good & (p <= limit)


def _any(flat: np.ndarray, owner: np.ndarray, position: np.ndarray, limit: np.ndarray, block: np.ndarray, last: np.ndarray, scans: list, tables: list[np.ndarray], out: np.ndarray) -> None:
    """Lanes of any shape."""
    window = np.zeros(len(flat), np.uint64)
    for j in range(5):
        window[: len(flat) - j] |= flat[j:].astype(np.uint64) << np.uint64(32 - 8 * j)
    lane = np.arange(len(position))
    images = [x for *_, x in scans]
    wide, most = max(len(x["order"]) for x in images), max(len(x["index"]) for x in images)
    per = np.array([len(x["order"]) for x in images])[owner]
    order = np.array([x["order"] + [0] * (wide - len(x["order"])) for x in images])[owner]
    index = np.array([x["index"] + [[0, 0]] * (most - len(x["index"])) for x in images])[owner]
    first, every = block.copy(), np.stack(tables)
    k, before = np.zeros(len(lane), np.int64), np.zeros((len(lane), most), np.int64)
    while len(lane):
        part = order[lane, (block - first[lane]) % per[lane]]
        dc = k == 0
        seen = (window[np.minimum(position >> 3, len(flat) - 8)] << (position & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFFFF)
        got = every[index[lane, part, (~dc).astype(np.int64)], (seen >> np.uint64(24)).astype(np.int64)].astype(np.int64)
        length, symbol = got >> 8, got & 255
        bits, run = symbol & 15, np.where(dc, 0, symbol >> 4)
        value = ((seen >> (40 - length - bits).astype(np.uint64)) & ((1 << bits) - 1).astype(np.uint64)).astype(np.int64)
        value = np.where((bits > 0) & (value < (1 << np.maximum(bits - 1, 0))), value - (1 << bits) + 1, value)
        position = position + length + bits
        k = k + run
        bad = (length == 0) | (position > limit[lane]) | (k > 63) | (dc & (symbol > 11))
        if bad.any():
            for i in owner[lane[bad]]:
                images[i]["bad"] = "the scan is damaged"
            value, k = np.where(bad, 0, value), np.where(bad, 63, k)
        if dc.any():
            value[dc] += before[lane[dc], part[dc]]
            before[lane[dc], part[dc]] = value[dc]
        put = dc | (bits > 0)
        out[k[put], block[put]] = value[put]
        k = np.where(~dc & (bits == 0) & (run < 15), 64, k + 1)
        ended = k > 63
        block, k = block + ended, np.where(ended, 0, k)
        stay = (block < last[lane]) & ~bad
        if not stay.all():
            lane, position, block, k = lane[stay], position[stay], block[stay], k[stay]


def payload_of(images: list[dict]) -> tuple[bytes, int]:
    """The padded payload that ``encode`` stored, and its length without padding."""
    values = np.concatenate([x["coefficients"].reshape(-1) for x in images])
    return np.where(values < 0, values + 128, values + 127).astype(np.uint8).tobytes(), sum(int(x["comment"].removeprefix(b"payload ")) for x in images)


def thumbnail(image: dict) -> np.ndarray:
    """DC-only luminance: one pixel for each 8 x 8 block."""
    return np.clip(image["luma"].astype(np.float64) * image["q_dc"] / 8 + 128, 0, 255)


def _shrink(pixels: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Mean of each of rows x columns cells; small images repeat their pixels."""
    def cut(a: np.ndarray, n: int) -> np.ndarray:
        if len(a) < n:
            return a[np.arange(n) * len(a) // n]
        edge = np.arange(n) * len(a) // n
        return np.add.reduceat(a, edge, axis=0) / np.diff([*edge, len(a)])[:, None]

    return cut(cut(pixels, rows).T, columns).T


def hashes(images: list[dict]) -> tuple[str, str]:
    """Average hash and difference hash of the images' thumbnails below one another, 64 bits each, in hex; narrower ones are filled up
    with middle grey."""
    parts = [thumbnail(x) for x in images]
    wide = max(p.shape[1] for p in parts)
    small = np.concatenate([np.pad(p, ((0, 0), (0, wide - p.shape[1])), constant_values=128) for p in parts])
    square, rows = _shrink(small, 8, 8), _shrink(small, 8, 9)
    pack = lambda bits: np.packbits(bits.ravel()).tobytes().hex()
    return pack(square > square.mean()), pack(rows[:, 1:] > rows[:, :-1])


def _tail(batch: pa.RecordBatch, keep: list[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(c)) for c in keep]


def store_payload(df: DataFrame, text: str, media: str = "media") -> DataFrame:
    """df with a binary column ``media``: the whole text as UTF-8 (null: empty), without loss, as a baseline JPEG.

    An existing column of that name is replaced. Equal texts give equal bytes; empty tables give empty tables."""
    keep = [c for c in df.columns if c != media]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(batch.schema.get_field_index(text)))
            for i, j in chunks(at):
                made = encode([data[at[r] : at[r + 1]].tobytes() for r in range(i, j)])
                yield pa.RecordBatch.from_arrays([*_tail(batch.slice(i, j - i), keep), pa.array(made, pa.binary())], names=[*keep, media])

    kinds = df.select(*keep).schema.add(media, "binary")
    return df.select(*keep).mapInArrow(run, kinds)


ABOUT = "struct<width:int,height:int,thumb_ahash:string,thumb_dhash:string,error:string>"
STORED = "struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string>"


def describe(df: DataFrame, media: str = "media", payload: bool = False, drop: bool = True) -> DataFrame:
    """df with ``jpeg``: width, height, thumbnail hashes and error of the media column's images, all of a row below one another.

    Null, empty, cut-off or unsupported media give nulls and the error. With ``payload`` the column ``stored`` is what
    ``store_payload`` kept: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256. ``drop`` leaves the media
    column out. Clashing columns ``jpeg`` and ``stored`` are replaced."""
    keep = [c for c in df.columns if c not in ("jpeg", "stored") and (c != media or not drop)]
    more = {"jpeg": pa.struct([("width", pa.int32()), ("height", pa.int32()), ("thumb_ahash", pa.string()), ("thumb_dhash", pa.string()), ("error", pa.string())])}
    kinds = StructType(df.select(*keep).schema.fields + StructType.fromDDL(f"jpeg {ABOUT}").fields)
    if payload:
        more["stored"] = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])
        kinds = StructType(kinds.fields + StructType.fromDDL(f"stored {STORED}").fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = utf8(batch.column(batch.schema.get_field_index(media)))
            for i, j in chunks(at, 1 << 21):
                raw = [data[at[r] : at[r + 1]].tobytes() for r in range(i, j)]
                about, stored = [], []
                for bytes_, found in zip(raw, decode(raw), strict=True):
                    if isinstance(found, str):
                        about.append({"error": found})
                        stored.append(None)
                        continue
                    a, d = hashes(found)
                    about.append({"width": max(x["width"] for x in found), "height": sum(x["height"] for x in found), "thumb_ahash": a, "thumb_dhash": d, "error": None})
                    if payload:
                        kept, n = payload_of(found)
                        stored.append({"n_bytes": n, "payload_bytes": len(kept), "payload_sha256": hashlib.sha256(kept).hexdigest(), "tail_crc32": zlib.crc32(kept[-32:]), "media_bytes": len(bytes_), "media_sha256": hashlib.sha256(bytes_).hexdigest()})
                new = [pa.array(about, more["jpeg"])] + ([pa.array(stored, more["stored"])] if payload else [])
                yield pa.RecordBatch.from_arrays([*_tail(batch.slice(i, j - i), keep), *new], names=[*keep, *more])

    return df.mapInArrow(run, kinds)


def payload_digest(docs: DataFrame) -> DataFrame:
    """The digest of ``op1_media_columns``: every whole text stored as media, read back and described."""
    read = describe(store_payload(docs.select("doc_id", "text"), "text").drop("text"), payload=True)
    feature = F.format_string("%dx%d:%s:%s", "jpeg.width", "jpeg.height", "jpeg.thumb_ahash", "jpeg.thumb_dhash")
    return read.select("doc_id", "stored.*", feature.alias("feature"))
