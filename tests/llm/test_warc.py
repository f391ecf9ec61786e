"""Archives: exact round trips, files, and the plan of revisits."""

import gzip
import hashlib
import io

import pytest

from tidemark.llm import warc


def rows():
    big = "é<p>" * 400
    return [
        (1, "http://a", "x"), (2, None, "x"), (3, "http://b", None), (4, "http://c", ""), (5, "u", big), (6, "u", big), (9, "u", big),
        (9, "u", big), (7, "u", "y" * 999), (8, "u", "y" * 999), (10, "u", "y" * 1000), (11, "u", "y" * 1000), (None, "n", big), (12, "a\r\nb: c", "\r\n\r\nContent-Length: 3\r\n\r\n" * 9), (13, "u", "z" * 3_000_000),
    ]


@pytest.mark.parametrize(("archive", "chunk"), [(64 << 20, 1 << 20), (2000, 64)])
def test_round_trip(spark, monkeypatch, archive, chunk):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive)
    monkeypatch.setattr(warc.records_of, "__defaults__", (chunk,))
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows()], "page_id long, url string, html string, digest string, salt int").repartition(2)
    archives, index, folder = warc.archive_pages(pages)
    assert sum(r.records for r in archives.collect()) == len(rows())
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index, folder).collect()), key=repr)
    refers = {5: 9, 6: 9, 10: 11}
    want = []
    for page, _, html in rows():
        body = (html or "").encode()
        to = refers.get(page)
        want.append((page or 0, len(body), hashlib.sha1(body).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=repr)
    # Every archive is a valid gzip file; the sidecar lists what the index holds.
    store, base = warc.open_store(folder)
    for name in {r.archive for r in index.collect()}:
        data = store.open_input_stream(f"{base}/{name}", compression=None).read()
        lines = store.open_input_stream(f"{base}/{name}.idx").read().decode().splitlines()
        mine = sorted((r.offset, r.length) for r in index.collect() if r.archive == name)
        assert [tuple(map(int, x.split()[:2])) for x in lines] == mine
        assert len(list(warc.records_of(io.BytesIO(data), 100))) == len(mine) == gzip.decompress(data).count(b"WARC/1.1\r\n")


def test_empty_table_and_broken_stream(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archives, index, folder = warc.archive_pages(pages)
    assert archives.count() == 0 and warc.read_records(index, folder).count() == 0
    whole = gzip.compress(warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None))
    assert len(list(warc.records_of(io.BytesIO(whole)))) == 1
    with pytest.raises(ValueError):
        list(warc.records_of(io.BytesIO(whole[:-20])))
