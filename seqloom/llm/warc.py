"""WARC archives: writing, reading, and assembly of transactions.

Writing: Spark's own text writer puts one record in each row, so any file system that Spark knows will do; a record ends with CR LF CR
and the writer's line feed. Files are compressed with gzip and bounded by bytes: pages of like size are written together, so many to a
file that it holds ``FILE_BYTES`` or one page. Reading: whole files through Spark's binary reader, records by their stated length, so
that payloads may hold anything.

Assembly: WARC-Concurrent-To, which a record may repeat, links two records whichever of them names the other; requests and metadata belong
to the nearest response or revisit over those links. Everything of a capture, payload included, becomes one nested row.

For deduplication only digests and ids are shuffled; equal payloads meet as a minimum by digest, so no group is gathered. What repeats
goes back to the pages by a broadcast if it is within the bounds of ``shared``, else by a shuffled join.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.shared import in_pieces, materialise, maybe_broadcast, new_path, release, remove, utf8

FILE_BYTES = 64 << 20
#: Bytes of html up to which pages are written together; the last kind has a file for each page.
KINDS = (1 << 16, 1 << 20, None)
DATE = "2024-01-01T00:00:00Z"
FIELDS = {"record_id": "string", "type": "string", "concurrent_to": "array<string>", "target_uri": "string", "refers_to": "string", "payload_digest": "string", "payload_bytes": "bigint", "payload": "binary", "fields": "string"}


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, block: bytes, **named: str | None) -> bytes:
    """A record up to the last line feed, which the writer adds."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}"]
    head += [f"WARC-{k.replace('_', '-')}: {v}" for k, v in named.items() if v is not None]
    head += [f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"Content-Length: {len(block)}"]
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r"


def _uri(url: str | None) -> str:
    """A header value: no line may break it."""
    return " ".join((url or "").split())


def capture(page: int | None, url: str | None, payload: bytes, original: int | None) -> list[bytes]:
    """Response or revisit, request, and metadata of one page. A record's id has the page's id and the payload's digest; a page without
    an id gets a random one in its stead."""
    sha = sha1_base32(payload)
    name, digest = f"urn:page:{page if page is not None else f'none-{uuid.uuid4().hex}'}:{sha}", f"sha1:{sha}"
    uri = _uri(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if original is None:
        main = record("response", name, http + payload, Target_URI=uri, Payload_Digest=digest)
    else:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        main = record("revisit", name, http, Target_URI=uri, Payload_Digest=digest, Refers_To=f"<urn:page:{original}:{sha}>", Profile=profile)
    ask = record("request", f"{name}:request", f"GET {uri or '/'} HTTP/1.1\r\n\r\n".encode(), Target_URI=uri, Concurrent_To=f"<{name}>")
    about = record("metadata", f"{name}:metadata", f"page: {'' if page is None else page}\r\n".encode(), Target_URI=uri, Concurrent_To=f"<{name}:request>")
    return [ask, main, about]


def write_pages(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> None:
    """An archive of all pages under ``path``: for each a request, a response or revisit, and metadata.

    Of pages with equal payloads of at least ``least`` bytes the smallest id is the response and the others revisit it; null html is an
    empty payload, a null url an empty one. A page with a null id is a response under a random id, and nobody's original. Rows that repeat
    an id with different html are captures of their own; those that repeat id and html share their record ids."""
    rows = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).alias("url"), F.coalesce(F.col(html).cast("binary"), F.lit(b"")).alias("html"))
    key = F.sha1("html")
    same = rows.where(F.col("page").isNotNull() & (F.length("html") >= least)).groupBy(key.alias("key")).agg(F.min("page").alias("first"), F.max("page").alias("last"), F.max(F.length("html")).alias("size"))
    same = materialise(same, "payloads")
    largest = max(rows.where("page IS NULL OR length(html) < " + str(least)).agg(F.max(F.length("html"))).first()[0] or 0, same.agg(F.max("size")).first()[0] or 0)
    first = maybe_broadcast(materialise(same.where("first < last").select("key", "first"), "originals"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in in_pieces(batch, "html"):
                data, at = utf8(piece.column(2))
                rows = zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), at[:-1], at[1:], piece.column(3).to_pylist(), strict=True)
                made = [r for page, url, a, b, original in rows for r in capture(page, url, data[a:b].tobytes(), original)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    low = -1
    for high in KINDS:
        mine = rows.where(F.length("html") > low) if high is None else rows.where((F.length("html") > low) & (F.length("html") <= high))
        marked = mine.withColumn("sha", key).join(first, F.col("sha") == F.col("key"), "left").select("page", "url", "html", F.when(F.col("first") < F.col("page"), F.col("first")).alias("original"))
        made = marked.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
        records = 3 * max(1, FILE_BYTES // high if high else 1)
        made.write.mode("append").option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", "\n").option("maxRecordsPerFile", records).text(path)
        if high is None or largest <= high:
            break
        low = high
    release(same)


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """Records of an archive; a record that is cut off, has no length or does not match its digest raises ValueError."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head, beside = {}, []
        while (line := stream.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.partition(b":")
            head[name.strip().lower().decode()] = value.strip().decode()
            if name.strip().lower() == b"warc-concurrent-to":
                beside.append(value.strip().decode().strip("<>"))
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record is cut off")
        if (stated := head.get("warc-block-digest", "")).startswith("sha1:") and stated[5:] != sha1_base32(block):
            raise ValueError("a block digest does not match")
        plain = lambda k: head[k].strip("<>") if k in head else None  # noqa: B023, E731
        out = {"record_id": plain("warc-record-id"), "type": head.get("warc-type"), "concurrent_to": beside, "target_uri": head.get("warc-target-uri"), "refers_to": plain("warc-refers-to"), "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None, "payload_bytes": None, "payload": None, "fields": None}
        if out["type"] in ("response", "revisit"):
            http, _, payload = block.partition(b"\r\n\r\n")
            lengths = [int(x.partition(b":")[2]) for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")]
            if out["type"] == "response":
                found = sha1_base32(payload)
                if out["payload_digest"] not in (None, found):
                    raise ValueError("a payload digest does not match")
                out |= {"payload": payload, "payload_bytes": len(payload), "payload_digest": found}
            else:
                out["payload_bytes"] = lengths[0] if lengths else None
        else:
            out["fields"] = block.decode("utf-8", "replace")
        yield out


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row for each record of the archives under ``path`` (plain or gzip); ``payload`` False leaves payloads out of the rows."""
    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "bigint": pa.int64(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data = content.as_buffer()
                raw = io.BytesIO(data)
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 16) if bytes(data[:2]) == b"\x1f\x8b" else raw
                rows = []
                for r in parse(stream):
                    rows.append(r if payload else r | {"payload": None})
                    if len(rows) == 500:
                        yield _batch(rows, kinds)
                        rows = []
                if rows:
                    yield _batch(rows, kinds)

    return files.mapInArrow(run, ", ".join(f"{k} {t}" for k, t in FIELDS.items()))


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, t in FIELDS.items()], names=list(FIELDS))


def _node(name: Column) -> Column:
    """16 bytes that stand for a record's name in links."""
    return F.unhex(F.md5(name.cast("binary")))


def _owners(named: DataFrame, main: DataFrame) -> DataFrame:
    """(node, owner): each node's nearest main records over undirected links, one ring of links around them after another."""
    one_way = named.select(_node(F.col("node")).alias("a"), F.explode(F.transform("concurrent_to", _node)).alias("b")).where("a <> b")
    links = materialise(one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    own = _node(F.col("record_id"))
    ring = found = main.select(own.alias("node"), own.alias("owner")).distinct()
    before = ring.limit(0)
    while True:
        # the neighbours of a ring are in it, in the one before or in the next
        beyond = ring.join(links, ring.node == links.a).select(F.col("b").alias("node"), "owner").distinct()
        beyond = materialise(beyond.join(ring.unionByName(before).select("node"), "node", "left_anti"), "ring")
        if beyond.isEmpty():
            return found
        before, ring, found = ring, beyond, found.unionByName(beyond)


def assemble(records: DataFrame) -> DataFrame:
    """One row for each capture, that is each response or revisit with an id: ``main`` (the record), ``requests`` and ``metadata`` (arrays
    by record id, empty if there are none).

    A request or metadata record belongs to the response or revisit that the fewest concurrent-to links, in either direction, lead to,
    and to each of several at the same distance; without one it belongs to no capture. A response or revisit without an id is none.
    Repeated records repeat in the arrays, repeated responses give a capture each."""
    if not hasattr(records, "_kept_at"):
        records = materialise(records, "records")
    main = records.where("type IN ('response', 'revisit') AND record_id IS NOT NULL")
    # records without an id that name the same ones share a node
    node = F.coalesce("record_id", F.concat(F.lit("no id: "), F.array_join("concurrent_to", " ")))
    rest = records.where("type IN ('request', 'metadata')").select(_node(node).alias("node"), "record_id", "type", "target_uri", "fields")
    owned = rest.join(_owners(records.select(node.alias("node"), "concurrent_to"), main.select("record_id")), "node")
    item = F.struct("record_id", "target_uri", "fields")
    of = lambda kind: F.sort_array(F.collect_list(F.when(F.col("type") == kind, item)))
    parts = owned.groupBy("owner").agg(of("request").alias("requests"), of("metadata").alias("metadata"))
    none = lambda c: F.coalesce(c, F.array().cast("array<struct<record_id:string,target_uri:string,fields:string>>"))
    joined = main.select(F.struct(*main.columns).alias("main")).join(parts, _node(F.col("main.record_id")) == F.col("owner"), "left")
    return joined.select("main", none(F.col("requests")).alias("requests"), none(F.col("metadata")).alias("metadata"))


def _page(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, "^urn:page:(-?[0-9]+):", 1), F.lit(""))


def digest(pages: DataFrame) -> DataFrame:
    """The columns of ``op7_warc``: pages written to an archive in the shared folder, read back, assembled with their payloads, and the
    nested rows described. Payload length and digest of a response are those of the payload it holds, of a revisit those it states."""
    path = new_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    records = materialise(read(pages.sparkSession, path), "records")
    remove(pages.sparkSession, path)  # the records stand for the archive from here
    captures = assemble(records)
    return captures.select(
        _page(F.col("main.record_id")).cast("long").alias("page_id"), F.coalesce(F.length("main.payload").cast("long"), "main.payload_bytes").alias("payload_bytes"), "main.payload_digest",
        F.col("main.type").alias("record_type"), _page(F.col("main.refers_to")).cast("long").alias("refers_to"), F.size("requests").alias("n_requests"), F.size("metadata").alias("n_metadata"),
    )
