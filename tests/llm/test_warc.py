import hashlib
import random

import pytest

from timberline.llm import warc


def test_round_trip_with_revisits(spark):
    random.seed(5)
    big = "<p>é " * 400
    pages = [(i, f"http://a.example/{i}?q=ü x\r\n", f"<html>{i} " + "abc " * random.randrange(900)) for i in range(120)]
    pages += [(200 + i, "http://b.example/", big) for i in range(30)] + [(300, None, big), (301, "http://c/", None), (302, "", ""), (None, "http://n/", "small"), (400, "http://d/", "tiny"), (401, "http://d/", "tiny"), (500, "u", "y" * 300_000)]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    archives = warc.write_archives(warc.plan(df), archive_bytes=100_000)
    content = [r.content for r in archives.collect()]
    assert len(content) > 3 and all(c[:4] == b"\x5d\x2a\x4d\x18" for c in content)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert len(got) == len(pages)
    for page, url, html in pages:
        r, body = got[page], (html or "").encode()
        assert r.error is None and r.payload_bytes == len(body) and r.payload_digest == hashlib.sha1(body).hexdigest()
        again = html == big and page != 300
        assert r.record_type == ("revisit" if again else "response") and r.refers_to == (300 if again else None)
        assert bytes(r.payload) == (b"" if again else body)


def test_reader_refuses_what_is_not_valid(spark):
    good = warc.record(1, "http://a/", b"hello", hashlib.sha1(b"hello").digest(), 5, None, False, "1970-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"hello"
    for bad in (good[:-1], good.replace(b"hello", b"hellO"), good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"WARC-Date", b"Date"), good.replace(b"Content-Length: 5", b"Content-Length: 6"), b""):
        with pytest.raises(ValueError):
            warc.parse(bad)
    cut = warc.archive([good, good])[:-3]
    rows = warc.read_archives(spark.createDataFrame([("x", cut), ("y", None)], warc.ARCHIVE)).collect()
    assert [r.error is None for r in rows] == [True, False]


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "http://a/", "x" * 5000)], "page_id long, url string, html string")
    (tmp_path / "one.warc.zst").write_bytes(warc.write_archives(warc.plan(rows)).first().content)
    got = warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path))).first()
    assert got.page_id == 1 and got.payload_bytes == 5000


def test_empty_table(spark):
    assert warc.write_archives(warc.plan(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def test_reading_goes_on_after_damaged_frames(spark):
    records = [warc.record(i, f"http://a/{i}", b"body %d " % i * 50, hashlib.sha1(b"body %d " % i * 50).digest(), len(b"body %d " % i * 50), None, False, "1970-01-01T00:00:00Z") for i in range(10)]
    whole = warc.archive(records)
    ends, at = [], warc.frame_end(memoryview(whole), 0)
    while at < len(whole):
        at = warc.frame_end(memoryview(whole), at)
        ends.append(at)
    flipped, headless, junk = bytearray(whole), bytearray(whole), whole[: ends[4]] + b"between frames" + whole[ends[4] :]
    flipped[ends[2] - 2] ^= 0xFF
    headless[ends[2] : ends[2] + 4] = b"oops"
    for content, lost in ((bytes(flipped), {2}), (bytes(headless), {3}), (junk, set()), (whole[:-3], {9}), (whole + b"xx", set())):
        got = warc.read_archives(spark.createDataFrame([("x", content)], warc.ARCHIVE)).collect()
        assert sorted(r.page_id for r in got if not r.error) == sorted(set(range(10)) - lost)
        assert len([r for r in got if r.error]) == 1


def _raw(kind, rid, block, *fields):
    head = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", "WARC-Date: 2020-01-01T00:00:00Z", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers(spark):
    sha = hashlib.sha1(b"hello world")
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nhello\r\n6;x=1\r\n world\r\n0\r\n\r\n"
    http = "Content-Type: application/http; msgtype=response"
    records = [
        _raw("warcinfo", "<urn:uuid:1>", b"software: x\r\n", "Content-Type: application/warc-fields"),
        _raw("response", "<urn:uuid:2>", chunked, http, "WARC-Payload-Digest: sha1:" + sha.hexdigest(), "WARC-Target-URI: <http://a/b>"),
        _raw("response", "<urn:uuid:3>", b"HTTP/1.0 200 OK\r\nServer: y\r\n\r\nno length", http, "X-Long: one", " two"),
        _raw("request", "<urn:uuid:4>", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", "Content-Type: application/http; msgtype=request"),
        _raw("metadata", "<urn:uuid:5>", b"k: v", "WARC-Concurrent-To: <urn:uuid:2>"),
        _raw("revisit", "<urn:uuid:6>", b"HTTP/1.1 200 OK\r\nContent-Length: 11\r\n\r\n", http, "WARC-Refers-To: <urn:uuid:2>", f"WARC-Profile: {warc._PROFILE}", "WARC-Payload-Digest: sha1:" + sha.hexdigest()),
        _raw("resource", "<urn:uuid:7>", b"\x00\xff", "WARC-Payload-Digest: sha256:" + hashlib.sha256(b"\x00\xff").hexdigest()),
        _raw("response", "<urn:uuid:8>", chunked, http, "WARC-Payload-Digest: sha1:" + hashlib.sha1(b"other").hexdigest()),
        _raw("response", "<urn:uuid:9>", b"HTTP/1.1 200 OK\r\nContent-Length: 99\r\n\r\ncut", http, "WARC-Truncated: length"),
    ]
    got = {r.record_id: r for r in warc.read_archives(spark.createDataFrame([("x", warc.archive(records))], warc.ARCHIVE)).collect()}
    assert [got[f"<urn:uuid:{k}>"].error is None for k in range(1, 10)] == [k != 8 for k in range(1, 10)]
    assert bytes(got["<urn:uuid:2>"].payload) == b"hello world" and got["<urn:uuid:2>"].payload_digest == sha.hexdigest() and got["<urn:uuid:2>"].url == "http://a/b"
    assert bytes(got["<urn:uuid:3>"].payload) == b"no length" and got["<urn:uuid:4>"].payload_bytes == 0 and bytes(got["<urn:uuid:5>"].payload) == b"k: v"
    six = got["<urn:uuid:6>"]
    assert (six.record_type, six.refers_to_id, six.refers_to, six.payload_bytes, six.payload_digest) == ("revisit", "<urn:uuid:2>", None, 11, sha.hexdigest())
    assert bytes(got["<urn:uuid:9>"].payload) == b"cut" and got["<urn:uuid:1>"].page_id is None


def test_rows_that_repeat_the_largest_id_are_responses(spark):
    rows = spark.createDataFrame([(k, "u", "z" * 2000) for k in (1, 7, 7)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(warc.plan(rows))).collect())
    assert got == [(1, "revisit", 7), (7, "response", None), (7, "response", None)]
