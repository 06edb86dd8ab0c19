"""Web archives: records written with an index first, then read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listwright.llm.sharding import named_rows
from listwright.llm.storage import Scratch, open_folder, small_batches

C = F.col
#: A task starts a new archive after so many bytes.
ARCHIVE = 1 << 30
#: Ranges closer than GAP bytes are read together, up to READ bytes at once.
GAP, READ = 1 << 16, 1 << 23
#: Stored bytes that one reading task gets, about.
SHARE = 1 << 24
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string, refers_to bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page/{page_id}')}>"


def one_line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """One record. A revisit (``first`` given) has the response's header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    fields = [
        ("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", date),
        ("WARC-Target-URI", one_line(url) if url else f"urn:page:{page_id}"), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if first is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page", str(first))]
    if page_id is not None:
        fields.append(("X-Page", str(page_id)))
    if url is None:
        fields.append(("X-No-URL", "1"))
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields, HTTP fields and the payload that the record holds."""
    head, rest = raw.split(b"\r\n\r\n", 1)
    version, *lines = head.decode("utf-8").split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError("not an archive record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    return fields, dict(line.split(": ", 1) for line in http.decode("utf-8").split("\r\n")[1:]), payload


def compressed(raw: bytes) -> bytes:
    """A gzip member without time stamp: equal records have equal bytes."""
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(raw) + press.flush()


def roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``(page_id, digest, first, holder)`` of payloads that several records share.

    ``first`` is their least id and ``holder`` the key of the one row that keeps the payload, the first stored one of
    rows that repeat that id.

    Only ids and digests are grouped and joined; a payload that a third of all pages share makes its rows narrow
    and the group's side of the join a single row.
    """
    named = F.when(C("page_id").isNotNull(), F.struct("page_id", "row_key"))
    shared = pages.filter(C("size") >= least_bytes).groupBy("digest").agg(F.min(named).alias("m"), F.count(F.lit(1)).alias("n"))
    shared = shared.filter("n > 1 and m is not null").select("digest", C("m.page_id").alias("first"), C("m.row_key").alias("holder"))
    return pages.select("page_id", "digest").join(shared, "digest").distinct()


def write_archives(
    spark: SparkSession, pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Write a record per row of ``pages (page_id, url, html, ...)``; return the index, a row per record.

    Of records whose payloads of at least ``least_bytes`` bytes are equal, that of the least ``page_id`` is the
    response and the others are revisits of it; smaller ones are all responses. Null html is an empty payload, a
    null url becomes a page urn. Rows that repeat an id with its payload revisit that id's first stored row, wherever
    they lie. Equal
    payloads of which no row has an id are all responses. An empty table writes no file. A file is named by the
    attempt that wrote it, and only finished tasks return index rows.
    """
    small_batches(spark, 256)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    pages = named_rows(Scratch(spark, "pages"), pages.select("page_id", "url", "html"))
    rows = pages.select(C("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"), "row_key")
    # Two hashes of different kinds and the size: equal for equal payloads only.
    digest = F.concat_ws(":", F.sha1("payload"), F.xxhash64("payload"), F.octet_length("payload"))
    rows = rows.withColumn("digest", digest)
    found = roles(rows.select("page_id", "digest", "row_key", F.octet_length("payload").alias("size")), least_bytes)
    found = found.select(C("page_id").alias("p"), C("digest").alias("d"), "first", "holder")
    rows = rows.join(found, rows["page_id"].eqNullSafe(C("p")) & (rows["digest"] == C("d")), "left")
    refers = F.when(C("row_key") != C("holder"), C("first"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers")).sortWithinPartitions("page_id", "url")

    def run(batches):
        part, system, path, file, name, at = TaskContext.get().partitionId(), None, "", None, "", 0
        for batch in batches:
            out = []
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                digest = base32_sha1(payload)
                raw = compressed(record(page_id, url, payload, digest, refers, date))
                if file is None or at >= ARCHIVE:
                    if file is not None:
                        file.close()
                    if system is None:
                        system, path = open_folder(folder)
                    name, at = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                    file = system.open_output_stream(f"{path}/{name}", compression=None)
                file.write(raw)
                out.append((name, at, len(raw), url, digest, page_id, "response" if refers is None else "revisit", refers))
                at += len(raw)
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            columns = list(zip(*out)) if out else [[]] * 8
            names = ["file", "offset", "length", "url", "digest", "page_id", "record_type", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        if file is not None:
            file.close()

    return rows.mapInArrow(run, INDEX)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Records of the index rows given: ``page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest``.

    Rows are sorted by file and offset over tasks of about equal bytes, and neighbours are read in one range. A
    response's payload must have the digest that its header and the index name. A revisit's payload is null; its
    size and digest are those of the payload it refers to.
    """
    total = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    wanted = index.select("file", "offset", "length", "digest")
    wanted = wanted.repartitionByRange(max(1, min(20_000, total // SHARE + 1)), "file", "offset").sortWithinPartitions("file", "offset")

    def run(batches):
        system = path = None
        for batch in batches:
            if system is None:
                system, path = open_folder(folder)
            rows, group = list(zip(*(c.to_pylist() for c in batch.columns))), []
            for row in [*rows, None]:
                if group and (row is None or row[0] != group[0][0] or row[1] > group[-1][1] + group[-1][2] + GAP or row[1] + row[2] > group[0][1] + READ):
                    with system.open_input_file(f"{path}/{group[0][0]}") as file:
                        file.seek(group[0][1])
                        raw = file.read(group[-1][1] + group[-1][2] - group[0][1])
                    yield _records(raw, group)
                    group = []
                if row is not None:
                    group.append(row)

    return wanted.mapInArrow(
        run, "page_id bigint, url string, record_type string, refers_to bigint, payload binary, payload_bytes bigint, payload_digest string"
    )


def _records(raw: bytes, group: list[tuple]) -> pa.RecordBatch:
    base, out = group[0][1], []
    for _, offset, length, digest in group:
        fields, http, payload = parse_record(zlib.decompress(raw[offset - base : offset - base + length], 31))
        named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = fields["WARC-Type"] == "revisit"
        if named != digest or not revisit and base32_sha1(payload) != named:
            raise ValueError(f"digest of {fields['WARC-Record-ID']} does not fit")
        page, first = fields.get("X-Page"), fields.get("X-Refers-To-Page")
        out.append((
            int(page) if page else None, None if "X-No-URL" in fields else fields["WARC-Target-URI"], fields["WARC-Type"],
            int(first) if first else None, None if revisit else payload, int(http["Content-Length"]), named,
        ))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def archive_and_read(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the archives to a new shared folder, keep their index there and read all records back."""
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    index = scratch.keep(write_archives(spark, pages, folder), "index")
    return read_records(index, folder)
