"""WARC archives as a chunked record table.

A payload travels as rows (record, chunk number, bytes) of bounded size, each
carrying the digest of all bytes up to its end, so neither writing nor reading an
archive holds a whole record. Archives are WARC/1.1 files in the shared folder;
tasks write and read them through pyarrow's file systems.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, arrow_store, partitions, spread_join

#: Bytes of payload in a row of the chunk table.
CHUNK_BYTES = 32 * 1024
#: Payloads of at least so many bytes are stored once and revisited.
REVISIT_BYTES = 1000
#: Bytes of html that one archive gets, about.
ARCHIVE_BYTES = 64 * 1024 * 1024
#: Bytes that are read, or unpacked, at once.
READ_BYTES = 1 << 16
#: Bytes in which the head of an HTTP message is looked for.
MOST_HEAD = 1 << 20
_END = b"\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def payload_chunks(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """record columns without ``payload`` plus chunk (number from 0), n_chunks, data (bytes); an empty payload is one empty chunk.

    Chunks are cut one by one, so no row but the record's own carries the whole payload.
    """
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("payload") / chunk_bytes)).cast("int")
    others = [c for c in records.columns if c != "payload"]
    each = records.withColumn("n_chunks", n).select(*others, "payload", "n_chunks", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"))
    return each.select(*others, "n_chunks", "chunk", F.substring("payload", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data"))


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """The pages as records with payload, and which of them revisit another.

    records: page_id, url, payload, payload_bytes, payload_digest, copy (tells equal
    rows apart). revisits: page_id, payload_digest, refers_to, refers_url. The
    payload is the body in UTF-8 (null: empty). Of records with equal payloads of at
    least REVISIT_BYTES bytes, that with the largest page_id is the response and the
    others revisit it; null ids are always responses. Rows that repeat the winning id
    are responses too.
    """
    payload = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    keyed = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1("payload"))
    small = keyed.drop("payload").filter((F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
    groups = small.groupBy("payload_digest").agg(F.max(F.struct("page_id", "url")).alias("best"), F.min("page_id").alias("least"))
    # Only digests that several pages share travel back; a hot one is spread.
    shared = groups.filter(F.col("least") < F.col("best.page_id")).select("payload_digest", F.col("best.page_id").alias("refers_to"), F.col("best.url").alias("refers_url"))
    revisits = spread_join(small.select("page_id", "payload_digest"), shared, ["payload_digest"]).filter(F.col("page_id") < F.col("refers_to")).distinct()
    return keyed.withColumn("copy", F.monotonically_increasing_id()), revisits


def plan_chunks(pages: DataFrame, n_files: int, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table to write: page_id, url, payload_bytes, payload_digest, copy, n_chunks, chunk, data, record_type, refers_to, refers_url.

    Payloads are cut in the scan and move once, as chunks: that dealing into
    ``n_files`` partitions serves the join and the archives. A revisit keeps one empty chunk.
    """
    records, revisits = plan_records(pages, id_col, url_col, body_col)
    dealt = payload_chunks(records, chunk_bytes).repartition(n_files, "page_id", "payload_digest")
    again = F.col("refers_to").isNotNull()
    met = dealt.join(revisits, ["page_id", "payload_digest"], "left").filter(~again | (F.col("chunk") == 0))
    return met.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "data": F.when(again, F.lit(b"")).otherwise(F.col("data")), "n_chunks": F.when(again, 1).otherwise(F.col("n_chunks"))})


def record_uuid(page_id: int | None, digest: str, url: str | None, n: int) -> str:
    """The identifier of the n-th record of a page, payload and url."""
    return str(uuid.UUID(hashlib.md5(json.dumps([page_id, digest, url, n]).encode()).hexdigest()))


def _uri(url: str | None) -> str:
    return "".join(c if c > " " else "%20" for c in (url or ""))


def _header(r: dict, n: int, length: int, http: bytes) -> bytes:
    again = r["record_type"] == "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {r['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{record_uuid(r['page_id'], r['payload_digest'], r['url'], n)}>",
        f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {_uri(r['url'])}",
        f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
        f"X-Payload-Bytes: {r['payload_bytes']}",
        *([] if r["page_id"] is None else [f"X-Page-Id: {r['page_id']}"]),
    ]
    if again:
        lines += [
            f"X-Refers-To-Page-Id: {r['refers_to']}",
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:uuid:{record_uuid(r['refers_to'], r['payload_digest'], r['refers_url'], 0)}>",
            f"WARC-Refers-To-Target-URI: {_uri(r['refers_url'])}",
            f"WARC-Refers-To-Date: {_DATE}",
        ]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {length + len(http)}"]
    return "\r\n".join(lines).encode() + _END + http


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes a chunk table (plan_chunks) as .warc.gz archives below ``folder``, one for each partition (each record its own gzip member); returns the manifest (path, records, bytes), still lazy.

    One task writes one archive, under a name of its attempt, and moves it to its
    final name when it is whole, so a repeated task replaces it. A payload whose
    digest differs from the planned one fails the task. Equal rows (same page, payload
    and url) are records of their own, numbered in their identifiers.
    """
    schema = "path string, records long, bytes long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = arrow_store(folder)
        store.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}.warc.gz"
        part = f"{root}/.part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        n = size = 0
        before, number, digest, member = None, -1, None, None
        http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + _END
        with store.open_output_stream(part, compression=None) as out:
            for batch in batches:
                names = batch.schema.names
                for i in range(len(batch)):
                    r = {c: batch.column(k)[i].as_py() for k, c in enumerate(names)}
                    response = r["record_type"] == "response"
                    if r["chunk"] == 0:
                        own = (r["page_id"], r["payload_digest"], r["url"])
                        number = number + 1 if own == before else 0
                        before, n = own, n + 1
                        digest, member = hashlib.sha1(), zlib.compressobj(6, zlib.DEFLATED, 31)
                        out.write(member.compress(_header(r, number, r["payload_bytes"] if response else 0, http)))
                    digest.update(r["data"])
                    out.write(member.compress(r["data"]))
                    if r["chunk"] == r["n_chunks"] - 1:
                        if response and digest.hexdigest() != r["payload_digest"]:
                            raise OSError(f"payload of page {r['page_id']} changed while it was written")
                        out.write(member.compress(_END) + member.flush())
            size = out.tell()
        if n:
            if store.get_file_info(name).type != fs.FileType.NotFound:  # an earlier attempt's
                store.delete_file(name)
            store.move(part, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n], "bytes": [size]})
        else:
            store.delete_file(part)

    return chunks.sortWithinPartitions("payload_digest", "page_id", "url", "copy", "chunk").mapInArrow(write, schema)


class _Lines:
    """Reads a WARC file, gzip of many members or plain, piece by piece.

    No step reads or unpacks more than READ_BYTES, however well the file is packed;
    what is not used yet is ``buffer`` from ``at`` on.
    """

    def __init__(self, raw) -> None:
        self.raw, self.at = raw, 0
        begin = raw.read(READ_BYTES)
        packed = begin[:2] == b"\x1f\x8b"
        self.z, self.packed, self.buffer = (zlib.decompressobj(31), begin, b"") if packed else (None, b"", begin)

    def _next(self) -> bytes:
        if self.z is None:
            return self.raw.read(READ_BYTES)
        while data := self.packed or self.raw.read(READ_BYTES):
            if self.z.eof:
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(data, READ_BYTES)
            self.packed = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if got:
                return got
        return b""

    def _more(self) -> bool:
        got = self._next()
        self.buffer, self.at = self.buffer[self.at :] + got, 0
        return bool(got)

    def head(self) -> dict[str, str] | None:
        """The header block up to its empty line, None at the end of the file."""
        while (end := self.buffer.find(_END, self.at)) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise OSError("archive ends inside a header")
                return None
        block, self.at = self.buffer[self.at : end], end + len(_END)
        lines = block.decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        return {"": lines[0]} | {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}

    def body(self, n: int, most: int) -> Iterator[bytes]:
        while n:
            step = min(n, most)
            while len(self.buffer) - self.at < step and self._more():
                pass
            piece = self.buffer[self.at : self.at + step]
            if not piece:
                raise OSError("archive ends inside a payload")
            self.at += len(piece)
            n -= len(piece)
            yield piece


def _without_http_head(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """What follows the HTTP head; all of it where there is none."""
    held: bytes | None = b""
    for piece in pieces:
        if held is None:
            yield piece
            continue
        held += piece
        at = held.find(_END)
        if at >= 0 or len(held) > MOST_HEAD:
            yield held[at + len(_END) :] if at >= 0 else held
            held = None
    if held:
        yield held


def _chunks(pieces: Iterator[bytes], size: int) -> Iterator[tuple[bytes, bool]]:
    """Chunks of ``size`` bytes, and whether each is the last; without any bytes one empty chunk."""
    held = b""
    for piece in pieces:
        held += piece
        while len(held) > size:
            yield held[:size], False
            held = held[size:]
    yield held, True


def _digest(text: str) -> str:
    """Hex digits of a digest header, which other writers give in base 32."""
    value = text.partition(":")[2] or text
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()
    except ValueError:
        return value


CHUNK_SCHEMA = "record_id string, record_type string, page_id long, refers_to long, url string, header_digest string, header_bytes long, chunk int, data binary, digest string, upto long, last boolean"


def read_archives(manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The chunk table of the archives that ``manifest`` (path) names.

    Each row holds one chunk, the SHA-1 and the number of bytes of the payload up to
    its end; ``last`` marks a record's final row. The payload of an HTTP message is
    what follows its head, that of any other record its whole block. A record without
    payload, a revisit say, is one row without bytes. Archives of other writers may be
    plain or compressed and hold records of any type; what they do not tell is null.
    ``with_data`` False leaves the bytes out.
    """
    store_uri = "file://"
    names = [x.split(" ")[0] for x in CHUNK_SCHEMA.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    kinds = [types[x.split(" ")[1]] for x in CHUNK_SCHEMA.split(", ")]

    def whole(h: dict[str, str], name: str) -> int | None:
        return int(h[name]) if h.get(name, "").isdigit() else None

    def rows_of(h: dict[str, str], lines: _Lines) -> Iterator[list]:
        length = int(h["content-length"])
        body = lines.body(length, chunk_bytes)
        if h.get("content-type", "").startswith("application/http"):
            body = _without_http_head(body)
        found = h.get("warc-payload-digest") or h.get("warc-block-digest")
        name = h.get("warc-record-id", "").strip("<>")
        first = [name.removeprefix("urn:uuid:"), h.get("warc-type"), whole(h, "x-page-id"), whole(h, "x-refers-to-page-id"), h.get("warc-target-uri"), found and _digest(found), whole(h, "x-payload-bytes")]
        digest, upto = hashlib.sha1(), 0
        for n, (piece, last) in enumerate(_chunks(body, chunk_bytes)):
            digest.update(piece)
            upto += len(piece)
            yield [*first, n, piece if with_data else None, digest.hexdigest(), upto, last]
        if next(lines.body(4, 4)) != _END:
            raise OSError("record does not end where its length says")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, where = arrow_store(path if "://" in path else store_uri + path)
                rows, held = [], 0
                with store.open_input_stream(where, compression=None) as raw:
                    lines = _Lines(raw)
                    while (h := lines.head()) is not None:
                        if not h[""].startswith("WARC/1."):
                            raise OSError(f"not a WARC record: {h['']!r}")
                        for row in rows_of(h, lines):
                            rows.append(row)
                            held += (len(row[8]) if with_data else 0) + 300
                            if held > 8 << 20:
                                yield pack(rows)
                                rows, held = [], 0
                if rows:
                    yield pack(rows)

    return manifest.select("path").mapInArrow(read, CHUNK_SCHEMA)


def archive_pages(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Writes every page as a WARC record, reads the archives back and returns the records found.

    page_id, payload_bytes, payload_digest (of the full payload), record_type,
    refers_to. Nulls, empty payloads, repeated rows and empty tables are allowed;
    every row is a record.
    """
    scratch = Scratch(pages.sparkSession, name)
    total = pages.select(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    # With fewer partitions than a shuffle has, the join would deal the payloads again.
    n_files = max(partitions(pages.sparkSession), -(-total // ARCHIVE_BYTES))
    # The written manifest is what later reads use: archives are made once.
    manifest = scratch.save(write_archives(plan_chunks(pages, n_files), f"{scratch.root}/archives"), "manifest")
    chunks = read_archives(manifest.repartition(max(1, manifest.count())), with_data=False)
    response = F.col("record_type") == "response"
    return chunks.filter("last").select(
        "page_id",
        F.when(response, F.col("upto")).otherwise(F.col("header_bytes")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(F.col("header_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS best FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN best > page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN best > page_id THEN best END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000
"""
