import gzip
import hashlib
import io

import pytest

from quern.llm.warc import WarcError, archive_pages, gzip_member, payload_of, read_archives, read_records, record_bytes


def member(payload=b"x" * 10, page=1, revisit=False):
    return gzip_member(record_bytes(page, "http://a/", payload, hashlib.sha256(payload).hexdigest(), 1 if revisit else None, revisit))


@pytest.mark.parametrize("size", [1, 7, 100, 1 << 20])
def test_reader_takes_any_read_size(size):
    payloads = [b"", b"a\r\n\r\nWARC/1.1\r\n\r\n", bytes(range(256)) * 400]
    f = io.BytesIO(b"".join(member(p, i) for i, p in enumerate(payloads)))
    records = list(read_records(lambda n: f.read(min(n, size))))
    assert [payload_of(r)[0] for r in records] == payloads
    assert [r.headers["warc-record-id"] for r in records] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:2>"]


def test_each_record_is_a_gzip_member():
    raw = member(b"1") + member(b"2")
    assert gzip.decompress(raw).count(b"WARC/1.1") == 2


def test_faults_are_found():
    def read(raw):
        return [payload_of(r) for r in read_records(io.BytesIO(raw).read)]

    good = gzip.decompress(member(b"hello"))
    read(gzip_member(good))
    for bad in (good.replace(b"hello", b"hellO"), good.replace(b"Content-Length: ", b"Content-Length: 1", 1), good[:-1], good.replace(b"WARC/1.1", b"WARX/1.1"), good + good):
        with pytest.raises(WarcError):
            read(gzip_member(bad))
    with pytest.raises(WarcError):
        read(member(b"hello")[:-9])


def test_edges(spark):
    big, small = "<p>é</p>" * 50, "<p>small</p>"
    rows = [(5, "u5", big, 1), (3, "u\n3", big, 1), (9, None, big, 1), (1, "u1", small, 1), (2, "u2", small, 1), (4, "u4", None, 1), (6, "u6", "", 1), (7, "u7", "x" * 300000, 1), (3, "u3", "other" * 30, 1), (8, "u8", big, 1), (8, "u8", big, 1), (None, "n", big, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    files = archive_pages(pages)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in read_archives(files).collect()), key=str)
    expected = []
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        revisit = html == big and page_id not in (3, None)
        expected.append((page_id, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert got == sorted(expected, key=str)
    stored = read_archives(files, with_payload=True).filter("page_id = 7").head()
    assert bytes(stored.payload) == b"x" * 300000
    assert read_archives(archive_pages(pages.filter("page_id < 0"))).count() == 0


def test_large_tasks_roll_files(spark, tmp_path):
    from quern.llm.warc import plan_records, write_archives

    pages = spark.range(200).selectExpr("id as page_id", "'u' as url", "concat('page ', id, repeat(md5(cast(id as string)), 20)) as html").coalesce(1)
    files = write_archives(plan_records(pages), f"file://{tmp_path}/w", file_bytes=5000).cache()
    assert files.count() > 3 and read_archives(files).count() == 200
