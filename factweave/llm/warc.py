"""WARC archives with an index that is written first and read first.

``write`` makes gzip-compressed archives, one member per record, and an index of file, offset, length,
URL and digest per record. ``read`` sorts the chosen index rows by file and offset, joins neighbouring
byte ranges into one read each, and parses the records out of these ranges; nothing else is read.

The task that writes an archive yields its index rows, and Spark commits these rows. Archives have unique
names, so what a lost or repeated attempt has written is named by no index row and is never read.
Archives go to any store that pyarrow's file systems reach; the path must be one that all executors share.

Defined results: a null payload is empty; a null or empty URL is written as an empty target URI and read as null;
a run of line breaks in a URL is written as %0A and read as such; the digest of a payload that is read is made anew, and
``intact`` says whether it is the recorded one (null for a revisit, which has no payload);
equal payloads of at least ``min_revisit_bytes`` bytes have one response, that of the largest id, and
revisits that refer to it (rows that share this id and the payload are all responses, null ids are revisits
if another id has the payload); payloads may hold any bytes, blank lines and WARC headers included,
since records are cut by length; an empty table gives an empty index; other columns are ignored.
A record is held whole by the task that writes or reads it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Fixed values of the format: RFC 4648 base32, WARC/1.1 and its profile for identical payloads.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

INDEX = "record_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, file string, offset bigint, length bigint"
RECORD = "record_id bigint, url string, record_type string, payload_digest string, payload_bytes bigint, refers_to bigint, payload binary, intact boolean"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hexadecimal digits in four parts of 40 bits each."""
    hexed = F.sha1(data)
    parts = [F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 10).cast("long") for k in range(4)]
    letter = lambda n, by: F.substring(F.lit(BASE32), F.shiftright(n, by).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    return F.concat(*[letter(n, by) for n in parts for by in range(35, -1, -5)])


def plan(pages: DataFrame, id_col: str, url_col: str, payload: Column, min_revisit_bytes: int) -> DataFrame:
    """Type, reference and payload of every record. Payloads are dealt out once at most."""
    rows = pages.select(
        F.col(id_col).cast("long").alias("record_id"), F.col(url_col).alias("url"),
        F.coalesce(payload.cast("binary"), F.lit("").cast("binary")).alias("payload"),
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    # One row per payload of which there are copies; a hot payload is summed up before it is dealt out.
    firsts = (
        rows.where(F.col("payload_bytes") >= min_revisit_bytes)
        .groupBy(F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b"))
        .agg(F.max("record_id").alias("first_id"), F.count("*").alias("n"))
        .where("n > 1")
    )
    linked = rows.join(firsts, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")), "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("record_id").eqNullSafe(F.col("first_id"))
    return linked.select(
        "record_id", "url", "payload_digest", "payload_bytes",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def record(row: dict) -> bytes:
    """A WARC record. A revisit has the HTTP headers only."""
    name = lambda n: f"<urn:x-record:{'none' if n is None else n}>"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}{END}".encode() + (row["payload"] or b"")
    url = re.sub(r"[\r\n]+", "%0A", row["url"] or "")
    head = [VERSION, f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {name(row['record_id'])}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{row['payload_digest']}"]
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {name(row['refers_to'])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END.encode() + block + END.encode()


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


_INDEX = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload: Column | None = None, min_revisit_bytes: int = 0, roll: int = 1 << 30) -> DataFrame:
    """Writes ``path/records`` and ``path/index``; returns the index. An archive is closed at ``roll`` bytes."""
    rows = plan(small_batches(pages), id_col, url_col, F.col("html") if payload is None else payload, min_revisit_bytes)

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(f"{path}/records")
        store.create_dir(top, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            index = []
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                if out is None or at >= roll:
                    if out is not None:
                        out.close()
                    name, at = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                data = gzip.compress(record(row), 6, mtime=0)
                out.write(data)
                del row["payload"]
                index.append(row | {"file": name, "offset": at, "length": len(data)})
                at += len(data)
            yield pa.RecordBatch.from_pylist(index, _INDEX)
        if out is not None:
            out.close()

    rows.mapInArrow(archive, INDEX).write.parquet(f"{path}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


def parse(data: bytes) -> dict:
    """A record; ``data`` ends with its blank line."""
    head, _, rest = data.partition(END.encode())
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(END.encode())
    number = lambda s: int(s[len("<urn:x-record:") : -1]) if s and s != "<urn:x-record:none>" else None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {
        "record_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"] or None, "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number(fields.get("WARC-Refers-To")),
        "payload_bytes": int(re.search(rb"Content-Length: (\d+)", http)[1]), "payload": payload,
        "intact": None if fields["WARC-Type"] == "revisit" else fields["WARC-Payload-Digest"] == f"sha1:{digest}",
    }


def read(selected: DataFrame, path: str, gap: int = 65536, most: int = 1 << 20) -> DataFrame:
    """The records of the given index rows, by coalesced byte ranges.

    Neighbours at most ``gap`` bytes apart are read at once, in reads of about ``most`` bytes. Index rows are dealt out
    by file and stretch, so that a large archive is read by many tasks: as many as there are shuffle partitions, fewer if
    that leaves less than ``most`` bytes to one, more if it leaves over 64 times as many. A revisit's payload is empty.
    """
    total = selected.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // most)), -(-total // (64 * most)))
    wanted = small_batches(selected).select("file", F.floor(F.col("offset") / most).alias("stretch"), "offset", "length")
    placed = wanted.repartition(tasks, "file", "stretch").sortWithinPartitions("file", "offset")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, int, int]]]:
        run: list[tuple[str, int, int]] = []
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in ("file", "offset", "length")), strict=True):
                if run and (row[0] != run[-1][0] or row[1] - sum(run[-1][1:]) > gap or row[1] + row[2] - run[0][1] > most):
                    yield run
                    run = []
                run.append(row)
        if run:
            yield run

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*(_INDEX.field(k) for k in ("record_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to")), ("payload", pa.binary()), ("intact", pa.bool_())])
        store, top = store_of(f"{path}/records")
        now, source = None, None
        for run in ranges(batches):
            if run[0][0] != now:
                if source is not None:
                    source.close()
                now, source = run[0][0], store.open_input_file(f"{top}/{run[0][0]}")
            start = run[0][1]
            source.seek(start)
            data = source.read(sum(run[-1][1:]) - start)
            yield pa.RecordBatch.from_pylist([parse(gzip.decompress(data[o - start : o - start + n])) for _, o, n in run], schema)
        if source is not None:
            source.close()

    return placed.mapInArrow(fetch, RECORD)


def round_trip(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Writes all pages, and reads all records back through the index."""
    return read(write(pages, path, min_revisit_bytes=min_revisit_bytes), path)
