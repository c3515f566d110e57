import glob
import gzip
import hashlib
import time
import zlib

from corpusgraph.llm import warc as W
from tests.compare import assert_same
from tests.conftest import rows

DIR = "/root/testdata/sf0.001"


def brute(pages):
    best = {}
    for i, _, html in pages:
        data = (html or "").encode()
        if len(data) >= 1000 and i is not None:
            best[data] = max(best.get(data, i), i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        to = best.get(data) if i is not None else None
        to = to if to is not None and to > i else None
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=repr)


PAGES = [(1, "u", "x" * 200_000), (2, "v", "x" * 200_000), (2, "v", "x" * 200_000), (3, None, None), (None, "a b\r\n", "y" * 1000), (8, "s", "s" * 999), (7, "s", "s" * 999), (5, "w", "é" * 700), (4, "w", "é" * 700), (6, "", ""), (9, "c", "a\r\n\r\nWARC/1.1\r\n\r\n" * 90)]


def test_pages_against_brute_force(spark):
    table = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, record_type string")
    assert rows(W.archive_pages(table)) == brute(PAGES)
    assert W.archive_pages(table.limit(0)).count() == 0


def archives(text, name):
    return [x.split(b": ", 1)[1] for x in text.split(b"\r\n") if x.startswith(name + b": ")]


def test_chunks_carry_running_digests_and_files_are_warc(spark, tmp_path):
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    manifest = spark.createDataFrame(W.write_archives(W.plan_chunks(table, 4), f"file://{tmp_path}").collect())
    chunks = W.read_archives(manifest).filter("page_id = 2").orderBy("record_id", "chunk").collect()
    by_record = {}
    for c in chunks:
        by_record.setdefault(c.record_id, []).append(c)
    assert len(by_record) == 2, "equal rows have identifiers of their own"
    for mine in by_record.values():
        seen, upto = hashlib.sha1(), 0
        assert [c.chunk for c in mine] == list(range(-(-200_000 // W.CHUNK_BYTES)))
        for c in mine:
            assert len(c.data) <= W.CHUNK_BYTES
            seen.update(c.data)
            upto += len(c.data)
            assert (c.digest, c.upto, c["last"]) == (seen.hexdigest(), upto, upto == 200_000)
        assert seen.hexdigest() == hashlib.sha1(b"x" * 200_000).hexdigest()
    data = b"".join(gzip.open(f).read() for f in glob.glob(f"{tmp_path}/*.warc.gz"))
    assert data.count(b"WARC-Type: ") == len(PAGES) and data.count(b"WARC-Type: revisit") == 2
    ids = archives(data, b"WARC-Record-ID")
    assert len(set(ids)) == len(PAGES) and set(archives(data, b"WARC-Refers-To")) <= set(ids)
    assert sorted(archives(data, b"WARC-Refers-To-Target-URI")) == [b"v", b"w"]


def test_archives_of_other_writers(spark, tmp_path):
    def record(kind, headers, block):
        lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{kind}>", *headers, f"Content-Length: {len(block)}"]
        return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    body = b"<html>\r\n\r\n" + b"z" * 70_000
    http = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + body
    base32 = "sha1:" + __import__("base64").b32encode(hashlib.sha1(body).digest()).decode()
    records = [
        record("warcinfo", ["Content-Type: application/warc-fields"], b"software: other\r\n"),
        record("request", ["Content-Type: application/http; msgtype=request", "WARC-Target-URI: http://a/"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        record("response", ["Content-Type: application/http; msgtype=response", "WARC-Target-URI: http://a/", f"WARC-Payload-Digest: {base32}"], http),
        record("metadata", ["Content-Type: text/plain"], b""),
        record("resource", ["Content-Type: image/png", "WARC-Target-URI: http://a/i"], bytes(range(256)) * 10),
    ]
    (tmp_path / "plain.warc").write_bytes(b"".join(records))
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    for name in ("plain.warc", "packed.warc.gz"):
        rows_ = W.read_archives(spark.createDataFrame([(str(tmp_path / name),)], "path string")).collect()
        last = {r.record_type: r for r in rows_ if r["last"]}
        assert {k: r.upto for k, r in last.items()} == {"warcinfo": 17, "request": 0, "response": len(body), "metadata": 0, "resource": 2560}
        assert last["response"].digest == last["response"].header_digest == hashlib.sha1(body).hexdigest()
        assert b"".join(r.data for r in sorted(rows_, key=lambda r: r.chunk) if r.record_type == "response") == body
        assert last["resource"].page_id is None and last["resource"].header_bytes is None


def test_query(spark):
    assert_same(W.op4_warc(spark, DIR), DIR, W.OP4_SQL)


def test_well_packed_payloads_are_read_in_steps(spark, tmp_path):
    """256 MB of zeros in one member: flat memory, and time in proportion."""
    n, packer = 256 << 20, zlib.compressobj(9, zlib.DEFLATED, 31)
    with open(tmp_path / "zeros.warc.gz", "wb") as out:
        out.write(packer.compress(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:uuid:z>\r\nContent-Length: {n}\r\n\r\n".encode()))
        for _ in range(n >> 20):
            out.write(packer.compress(bytes(1 << 20)))
        out.write(packer.compress(b"\r\n\r\n") + packer.flush())
    with open(tmp_path / "zeros.warc.gz", "rb") as raw:
        lines, began = W._Lines(raw), time.time()
        assert lines.head()["content-length"] == str(n)
        read = most = 0
        for piece in lines.body(n, W.CHUNK_BYTES):
            read, most = read + len(piece), max(most, len(lines.buffer))
        assert read == n and most <= W.CHUNK_BYTES + W.READ_BYTES and time.time() - began < 20
        assert next(lines.body(4, 4)) == b"\r\n\r\n" and lines.head() is None
    last = W.read_archives(spark.createDataFrame([(str(tmp_path / "zeros.warc.gz"),)], "path string"), with_data=False).filter("last").collect()
    assert [(r.record_id, r.upto) for r in last] == [("z", n)]
