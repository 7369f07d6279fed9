"""WARC archives through a chunked record table.

A payload is handled as rows of (record identifier, chunk number, chunk), and
each chunk becomes one record of the archive: the first a ``response``, the
others its ``continuation`` segments. Which page revisits which is
worked out without payloads; a bit field of the revisits then lets pages be
written where they are read, and what it stops by chance is joined exactly. A
writing task holds the batch of rows it has been given, whose payloads are cut in place, and at most 64 chunks of
records; when read, digests run along the chunks. Pages
whose payload equals that of a page with a larger key become ``revisit``
records. Archives are written and read by Spark's text source, to and from any
store it knows: every record starts with a line that holds an identifier drawn
for the archive, and that line is the separator when it is read. So archives
stay splittable, and a payload may contain anything, record headers included.

When read, a record in one piece is checked in place. Chunks of oversized
records stay rows: they are sorted by record and chunk number and their digest
is carried from row to row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.workers import importable
from lanewise.storage import shared_folder, stored

CHUNK = 1 << 16
MOST_BITS = 1 << 28
BITMAP_BITS = 1 << 15  # fixed value: of one of Spark's bitmaps
DATE = "2000-01-01T00:00:00Z"
VERSION = "WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format

RECORDS = (
    "record string, chunk_no int, page string, kind string, refers_to string,"
    "payload_bytes bigint, payload_digest string, chunk binary"
)


def first_line(archive: str) -> str:
    return f"{VERSION}WARC-Archive-ID: {archive}\r\n"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunks(payload: bytes | memoryview, most: int) -> Iterator[bytes | memoryview]:
    """The payload in parts of at most ``most`` bytes that end between characters; one for no bytes.

    Where no character begins within a part, as in bytes that are not UTF-8, it is cut at ``most``.
    """
    at = 0
    while True:
        whole = end = min(len(payload), at + most)
        while at < end < len(payload) and payload[end] & 0xC0 == 0x80:
            end -= 1
        end = end if end > at else whole
        yield payload[at:end]
        at = end
        if at >= len(payload):
            return


def record(archive: str, headers: list[tuple[str, str | None]], *block: bytes | memoryview) -> bytes:
    """A record without the last byte of its end, which the text source adds."""
    lines = [f"{name}: {value}\r\n" for name, value in headers if value is not None]
    head = first_line(archive) + "".join(lines) + f"Content-Length: {sum(map(len, block))}\r\n\r\n"
    return b"".join((head.encode(), *block, b"\r\n\r"))


def page_records(
    archive: str,
    row: int,
    page: str | None,
    url: bytes | None,
    payload: bytes | memoryview,
    of: str | None,
    most: int,
    sha: str | None = None,
    size: int | None = None,
) -> Iterator[bytes]:
    """The records of a page; ``of`` is the page that holds an equal payload, ``row`` tells copies of a row apart.

    With ``sha`` and ``size`` known, a page with ``of`` needs no payload.
    """
    name = f"row {row}" if page is None else page
    identity = f"<urn:uuid:{uuid.uuid5(uuid.UUID(archive), name)}>"
    digest = bytes.fromhex(sha) if sha else hashlib.sha1(payload).digest()
    uri = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]-._~")
    common = [
        ("WARC-Type", "response" if of is None else "revisit"),
        ("WARC-Record-ID", identity),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Page-ID", page),
        ("WARC-Row", str(row)),
        ("WARC-Payload-Digest", "sha1:" + base32(digest)),
        ("WARC-Payload-Length", str(len(payload) if size is None else size)),
    ]
    if of is not None:
        told = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.UUID(archive), of)}>")]
        yield record(archive, [*common, *told, ("WARC-Refers-To-Page-ID", of)], b"")
        return
    kind = ("Content-Type", "application/http; msgtype=response")
    done = 0
    for number, part in enumerate(chunks(payload, most), 1):
        done += len(part)
        if number == 1:
            split = [("WARC-Segment-Number", "1")] if done < len(payload) else []
            yield record(archive, [*common, kind, *split], HTTP.encode(), part)
            continue
        headers = [
            ("WARC-Type", "continuation"),
            ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.UUID(archive), f'{name}#{row}#{number}')}>"),
            ("WARC-Date", DATE),
            ("WARC-Segment-Origin-ID", identity),
            ("WARC-Row", str(row)),
            ("WARC-Segment-Number", str(number)),
        ]
        if done == len(payload):
            headers.append(("WARC-Segment-Total-Length", str(len(HTTP) + len(payload))))
        yield record(archive, headers, part)


def places(marks: pa.Array, bits: int) -> np.ndarray:
    """Two places of each mark in a field of ``bits`` bits, a power of two."""
    seen = marks.to_numpy(zero_copy_only=False).view(np.uint64)
    return np.stack([seen, seen >> np.uint64(32)]).astype(np.uint64) & np.uint64(bits - 1)


def within(marks: pa.Array, field: bytes) -> np.ndarray:
    """Whether a field may hold the marks; it never misses one it holds."""
    at, seen = places(marks, 8 * len(field)), np.frombuffer(field, np.uint8)
    return (seen[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)


def passes(mark: Column, field: Broadcast) -> Column:
    def inside(marks: pa.Array) -> pa.Array:
        return pa.array(within(marks, field.value))

    inside.__annotations__ = {"marks": pa.Array, "return": pa.Array}
    return F.arrow_udf(inside, "boolean")(mark)


def field_of(marks: DataFrame) -> Broadcast:
    """The marks as a bit field of 32 bits for each, but at most ``MOST_BITS``, sent to all tasks."""
    number = marks.count()
    bits = min(MOST_BITS, max(BITMAP_BITS, 1 << (32 * number - 1).bit_length() if number else 0))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places(batch["mark"], bits).ravel().astype(np.int64))], ["place"])

    bucket, bit = F.floor(F.col("place") / BITMAP_BITS).cast("int"), F.col("place") % BITMAP_BITS
    spots = marks.select("mark").mapInArrow(spread, "place bigint")
    field = bytearray(bits // 8)
    for at, part in spots.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits")).collect():
        field[at * BITMAP_BITS // 8 : at * BITMAP_BITS // 8 + len(part)] = part
    return marks.sparkSession.sparkContext.broadcast(bytes(field))


def revisited(bare: DataFrame, least: int) -> tuple[DataFrame, DataFrame | None, Broadcast, Broadcast | None]:
    """What to write, from pages without their payloads.

    The revisits with their ``response``; the other pages whose mark the field
    of the revisits' marks holds by chance (None without any); that field and a
    field of these pages. Only pages in the second field are moved with their
    payloads, to an exact join that tells them from revisits.
    """
    groups = bare.where(F.col("size") >= least).groupBy("sha", "size")
    groups = groups.agg(F.count("*").alias("n"), F.max("page").alias("response")).where("n > 1 AND response IS NOT NULL")
    joined = bare.join(groups.drop("n"), ["sha", "size"], "left")
    decided = stored(joined.withColumn("again", F.col("response").isNotNull() & ~F.col("page").eqNullSafe(F.col("response"))), "decided-pages")
    again, others = decided.where("again"), decided.where("NOT again")
    known = field_of(again.select("mark"))
    others = others.where(passes(F.col("mark"), known)).select("page", "sha", "size", "mark").distinct()
    chance = stored(others, "chance-pages")
    if chance.isEmpty():
        return again, None, known, None
    return again, chance, known, field_of(chance)


def write_archive(
    pages: DataFrame, folder: str, key: str, url: str, html: str, least: int = 0, most: int = CHUNK
) -> str:
    """Write a record per page to ``folder``; the identifier of the archive."""
    importable(pages.sparkSession)
    archive = str(uuid.uuid4())
    payload = F.coalesce(F.col(f"`{html}`"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(f"`{key}`").alias("page"), F.col(f"`{url}`").cast("string").cast("binary").alias("url"), payload.alias("payload")
    )
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    rows = rows.withColumn("mark", F.xxhash64("page", "sha"))
    bare = stored(rows.drop("payload"), "bare-pages")
    again, chance, known, lucky = revisited(bare, least)
    nothing = F.lit(None).cast("string").alias("of")
    size = F.col("size").cast("bigint").alias("size")

    def part(df: DataFrame, number: int, payload: Column, of: Column) -> DataFrame:
        row = (F.monotonically_increasing_id() * 3 + number).alias("row")
        return df.select(row, F.col("page").cast("string"), "url", payload, of, "sha", size, "mark")

    empty = F.lit(b"").alias("payload")
    # Most pages are written where they are read; those that the filter stops are revisits, or come by the way of `chance`.
    parts = [(part(rows, 0, F.col("payload"), nothing), known)]
    parts.append((part(again, 1, empty, F.col("response").cast("string").alias("of")), None))
    if chance is not None:
        met = rows.where(passes(F.col("mark"), lucky)).alias("a")
        same = "a.mark = b.mark AND a.page <=> b.page AND a.sha = b.sha AND a.size = b.size"
        stopped = met.join(chance.alias("b"), F.expr(same), "left_semi")
        parts.append((part(stopped, 2, F.col("payload"), nothing), None))

    def lines(out: list[bytes]) -> pa.RecordBatch:
        # Seen as text without a look at the bytes, which need not be UTF-8; Spark writes them as they are.
        return pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).view(pa.string())], ["value"])

    def writer(stops: Broadcast | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                stopped = [False] * batch.num_rows if stops is None else within(batch["mark"], stops.value).tolist()
                out, held = [], 0
                told = zip(*(batch[c].to_pylist() for c in ("row", "page", "url", "of", "sha", "size")))
                for stop, payload, (row, page, url, of, sha, size) in zip(stopped, batch["payload"], told):
                    if stop:
                        continue
                    for data in page_records(archive, row, page, url, memoryview(payload.as_buffer()), of, most, sha, size):
                        out.append(data)
                        held += len(data)
                        if held > most << 6:
                            yield lines(out)
                            out, held = [], 0
                yield lines(out)

        return write

    for ready, stops in parts:
        ready.mapInArrow(writer(stops), "value string").write.mode("append").option("lineSep", "\n").text(folder)
    return archive


def parsed(data: bytes) -> dict:
    """A row of the record table from what follows a record's first line."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n"))
    size = int(headers["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {headers['WARC-Record-ID']} does not have {size} bytes")
    kind, block, number = headers["WARC-Type"], rest[:size], headers.get("WARC-Segment-Number")
    row = {
        "record": f"{headers.get('WARC-Segment-Origin-ID', headers['WARC-Record-ID'])} {headers['WARC-Row']}",
        "chunk_no": int(number or 1),
        "page": headers.get("WARC-Page-ID"),
        "kind": kind,
        "refers_to": headers.get("WARC-Refers-To-Page-ID"),
        "payload_bytes": int(headers.get("WARC-Payload-Length", 0)),
        "payload_digest": headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None,
        "chunk": None,
    }
    if kind == "response":
        block = block.partition(b"\r\n\r\n")[2]
    if number:
        row["chunk"] = block
    elif kind == "response":
        checked(row, hashlib.sha1(block), len(block))
    return row


def checked(row: dict, digest, size: int) -> None:
    if base32(digest.digest()) != row["payload_digest"] or size != row["payload_bytes"]:
        raise ValueError(f"the payload of record {row['record']} is not what its header says")


def read_records(spark: SparkSession, folder: str, archive: str) -> DataFrame:
    """The record table of an archive: one row per record, with the chunk if the payload has several."""
    importable(spark)
    lines = spark.read.option("lineSep", first_line(archive)).text(folder).where("value != ''")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([parsed(data) for data in batch["value"].to_pylist()], TABLE)

    return lines.select(F.col("value").cast("binary")).mapInArrow(parse, RECORDS)


TABLE = pa.schema(
    [
        ("record", pa.string()),
        ("chunk_no", pa.int32()),
        ("page", pa.string()),
        ("kind", pa.string()),
        ("refers_to", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("chunk", pa.binary()),
    ]
)


def joined_chunks(records: DataFrame) -> DataFrame:
    """One checked row, without chunks, for every record that has several."""
    several = records.where("chunk IS NOT NULL")
    several = several.repartition("record").sortWithinPartitions("record", "chunk_no")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: dict | None = None
        digest, size, number = hashlib.sha1(), 0, 0
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if head is None or row["record"] != head["record"]:
                    if head:
                        checked(head, digest, size)
                        done.append(head | {"chunk": None})
                    head, digest, size, number = row, hashlib.sha1(), 0, 0
                number += 1
                if row["chunk_no"] != number:
                    raise ValueError(f"record {row['record']} lacks chunk {number}")
                digest.update(row["chunk"])
                size += len(row["chunk"])
            yield pa.RecordBatch.from_pylist(done, TABLE)
        if head:
            checked(head, digest, size)
            yield pa.RecordBatch.from_pylist([head | {"chunk": None}], TABLE)

    return several.mapInArrow(follow, RECORDS)


def round_trip(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0, most: int = CHUNK
) -> DataFrame:
    """Archive the pages in the shared folder and list what the archive holds.

    One row per row of ``pages``: its key, ``payload_bytes``,
    ``payload_digest``, ``record_type`` and ``refers_to``. A null page is an
    empty payload; bytes that are not UTF-8 are archived as they are. Of equal payloads of at least ``least`` bytes, the page with
    the largest key is the response and others revisit it; rows that repeat its
    key are responses too. Without any key in a group, all are responses. A
    null address is left out of the record. Other columns are left out,
    whatever their names. The archive is written while the result is being
    built, and a payload that does not match its digest ends the job.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archive = write_archive(pages, folder, key, url, html, least, most)
    records = stored(read_records(spark, folder, archive), "records")
    whole = records.where("chunk IS NULL").unionByName(joined_chunks(records))
    kind = dict(pages.dtypes)[key]
    return whole.select(
        F.col("page").cast(kind).alias(key),
        "payload_bytes",
        "payload_digest",
        F.col("kind").alias("record_type"),
        F.col("refers_to").cast(kind).alias("refers_to"),
    )


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, strlen(html) AS payload_bytes, cast(cast(from_hex(sha1(html)) AS bit) AS varchar) AS bits,
             max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * cast(bits[5 * i + 1] AS int) + 8 * cast(bits[5 * i + 2] AS int) + 4 * cast(bits[5 * i + 3] AS int)
           + 2 * cast(bits[5 * i + 4] AS int) + cast(bits[5 * i + 5] AS int), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM q
"""
