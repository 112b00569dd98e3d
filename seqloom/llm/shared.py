"""What the operators of this package share: tables kept between jobs, size checks, byte views of Arrow text.

Tables that cut lineage are Parquet files in the folder that the session names in ``spark.checkpoint.dir``; they survive the
loss of any executor. Where the setting is absent a session on one machine (master ``local``) gets a temporary folder; any other is refused.
Tables that no result reads any more are removed with ``release``, those of a whole stage with ``scratch``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as Spark estimates a row) up to which a side may be broadcast; beyond either every operator has a shuffled way.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="seqloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/seqloom/{label}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read again."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes the files of materialised tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_kept_at", None):
            remove(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Removes at its end the tables that were materialised inside, but for those appended to the list it gives."""
    kept: list[DataFrame] = []
    _SCOPES.append([])
    try:
        yield kept
    finally:
        paths, stay = _SCOPES.pop(), {getattr(df, "_kept_at", None) for df in kept}
        for path in paths:
            if path not in stay:
                remove(spark, path)
        if _SCOPES:
            _SCOPES[-1].extend(p for p in paths if p in stay)


def free_name(name: str, *tables: DataFrame) -> str:
    """The name, or a longer one, that no column of the tables has in any case."""
    taken = {c.lower() for df in tables for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drawn(key: Column, bound: int, rows: int, seed: int) -> Column:
    """True for about ``bound`` of ``rows`` keys, by an exact threshold on a 64-bit hash; for all where there are no more than that."""
    if rows <= bound:
        return F.lit(True)
    return F.xxhash64(key, F.lit(seed)) < F.lit((bound << 64) // rows - (1 << 63))


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """True if df has at most so many rows and so many bytes of text, binary and array values; reads no more than one row beyond."""
    wide = [F.length(F.col(f.name).cast("binary")) if f.dataType.typeName() in ("string", "binary") else F.size(f.name) * 24 for f in df.schema if f.dataType.typeName() in ("string", "binary", "array")]
    held = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(8 * len(df.columns))).cast("long")
    n, total = df.limit(rows + 1).select(held.alias("b")).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    return n <= rows and total <= size


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its size is within the bounds, else as it is: the join then shuffles and AQE splits hot keys."""
    return F.broadcast(df) if fits(df, rows) else df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """Lower-cased (A-Z) runs of anything but space and bytes 9 to 13; null gives an empty array."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "[ \\t-\\r]+"), "")


def remainder(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal text, modulo ``of``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % of


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string or binary column (nulls: empty), and where each row's bytes start and end."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes at most, or one row."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def in_pieces(batch: pa.RecordBatch, text: str, limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about ``limit`` bytes at most, or one row."""
    column = batch.column(batch.schema.get_field_index(text))
    for i, j in chunks(utf8(column)[1], limit):
        yield batch.slice(i, j - i)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
