import hashlib

import pytest
import zstandard

from stemma.llm.warc import (
    DICTIONARY_FRAME, ArchiveError, archive_files, page_records, parse_record, read_archive, read_archives, record_bytes,
    write_archive, write_archives,
)

HEAD = [("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2020-01-01T00:00:00Z")]


def some(n=40):
    return [record_bytes([*HEAD, ("X-Number", str(i))], (f"<p>page {i} of the archive</p>" * (i % 30)).encode()) for i in range(n)]


def test_archive_round_trip_with_and_without_a_dictionary():
    for records in (some(), some(3), [], [record_bytes(HEAD, b"")]):
        archive = write_archive(records)
        assert archive[:4] == DICTIONARY_FRAME
        read = list(read_archive(archive))
        assert [r.block for r in read] == [parse_record(x).block for x in records]
    assert int.from_bytes(write_archive(some())[4:8], "little") > 0
    assert list(read_archive(b"")) == []


def test_one_frame_per_record_and_other_writers():
    records = some(5)
    plain = b"".join(zstandard.ZstdCompressor(write_content_size=False).compress(r) for r in records)
    assert len(list(read_archive(plain))) == 5
    skip = b"\x50\x2a\x4d\x18" + (3).to_bytes(4, "little") + b"abc"
    assert len(list(read_archive(skip + plain + skip))) == 5
    raw = zstandard.train_dictionary(2000, some(200)).as_bytes()
    coder = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    uncompressed = DICTIONARY_FRAME + len(raw).to_bytes(4, "little") + raw + b"".join(map(coder.compress, records))
    assert [r.block for r in read_archive(uncompressed)] == [parse_record(x).block for x in records]


@pytest.mark.parametrize(
    "data",
    [
        b"no record",
        b"WARC/9\r\n\r\n\r\n\r\n",
        record_bytes(HEAD[:2], b"x"),
        record_bytes([*HEAD, HEAD[0]], b"x"),
        record_bytes([*HEAD, ("bad name", "x")], b"x"),
        record_bytes(HEAD, b"xyz")[:-1],
        record_bytes(HEAD, b"xyz") + b"more",
        record_bytes(HEAD, b"xyz").replace(b"Content-Length: 3", b"Content-Length: 4"),
        record_bytes(HEAD, b"xyz").replace(b"Content-Length: 3", b"Content-Length: -3"),
    ],
)
def test_bad_records_are_refused(data):
    with pytest.raises(ArchiveError):
        parse_record(data)


def test_damaged_archives_are_refused():
    archive = write_archive(some())
    for broken in (archive[:-1], archive[:5], archive + b"xxxx", archive[:-40] + b"\0" * 40, archive[:4] + b"\xff\xff\xff\x7f" + archive[8:]):
        with pytest.raises(ArchiveError):
            list(read_archive(broken))


def test_pages(spark):
    big, twin = "<p>" + "x" * 200, "<p>é" + "y" * 200
    rows = [
        (1, "http://a/", big), (2, "http://b/", big), (0, "http://c/", big), (3, None, None), (4, "u\r\nX: y", ""), (5, "s", "short"),
        (6, "s", "short"), (8, "t", twin), (7, "t", twin), (7, "t", twin), (None, "n", twin), (None, "n", "z" * 150), (9, "l", "<p>" * 300_000),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as digest").repartition(3)
    got = page_records(read_archives(write_archives(pages, archive_bytes=20_000))).collect()
    first = {hashlib.sha256(big.encode()).hexdigest(): 0, hashlib.sha256(twin.encode()).hexdigest(): 7}
    want = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        refers = first.get(digest) if first.get(digest, page_id) != page_id else None
        want.append((page_id, len(payload), digest, "response" if refers is None else "revisit", refers))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert write_archives(pages.limit(0)).count() == 0


def test_archive_files(spark, tmp_path):
    (tmp_path / "a.warc.zst").write_bytes(write_archive(some(12)))
    (tmp_path / "b.warc.zst").write_bytes(b"")
    read = read_archives(archive_files(spark, f"file://{tmp_path}"))
    assert read.count() == 12 and read.where("sha2(block, 256) <> block_sha256").count() == 0
    (tmp_path / "c.warc.zst").write_bytes(b"broken")
    with pytest.raises(Exception, match="c.warc.zst"):
        read_archives(archive_files(spark, f"file://{tmp_path}")).count()
