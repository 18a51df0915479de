import base64
import hashlib

import zstandard

from cairn.llm import files, warc


def test_round_trip(spark, tmp_path):
    page = lambda i: f"<html><head><title>Page {i}</title></head><body>{'körper ' * 40}{i}</body></html>"
    rows = [(i, f"http://a.example/{i}", page(i % 70)) for i in range(100)]
    rows += [(200, None, None), (201, "http://x/ y\r\nz", ""), (202, "u", "x" * 700_000), (None, "n", page(3)), (None, "n", "only"), (5, "again", page(5))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    made = warc.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=20_000)
    got = warc.read_archives(made).collect()
    assert len(got) == len(rows) == sum(r.n_records for r in made.collect())
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    want = []
    for i, _, html in rows:
        data, least = (html or "").encode(), first.get(html or "")
        again = least is not None and i != least
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", least if again else None, None if again else data))
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, ((r[0], r[1], r[2], r[3], r[4], bytes(r[5]) if r[5] is not None else None) for r in got))) == sorted(map(key, want))


def test_dictionary_leads_large_archives(tmp_path):
    archive = warc.Archive(f"file://{tmp_path}", "a")
    sent = [warc.record(i, "u", f"{i} some page text {i * 7919} ".encode() * 20, False, None) for i in range(3000)]
    for x in sent:
        archive.add(x)
    uri, n = archive.close()
    data = files.read(uri)
    assert n == 3000 and data[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.records(data)) == sent
    assert len(data) < sum(map(len, sent)) / 3


def test_archives_on_disk(spark, tmp_path):
    """What the contract's own writer leaves, read with nothing but open() and a Zstandard decoder."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    made = warc.write_archives(pages, f"file://{tmp_path}/w").collect()
    seen = 0
    for row in made:
        with open(row.uri.removeprefix("file://"), "rb") as f:
            raw = f.read()
        assert raw[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(raw[4:8], "little")
        own, at = zstandard.ZstdCompressionDict(raw[8 : 8 + size]), 8 + size
        while at < len(raw):  # every record is a frame of its own and can be read from its offset alone
            one = zstandard.ZstdDecompressor(dict_data=own).decompressobj()
            assert one.decompress(raw[at:]).startswith(b"WARC/1.1\r\n") and raw[at : at + 4] == b"\x28\xb5\x2f\xfd"
            at, seen = len(raw) - len(one.unused_data), seen + 1
    assert seen == pages.count()


def test_small_archives_have_a_dictionary(tmp_path):
    for k, sent in enumerate(([b""], [b"one record"], [b"same"] * 9, [b"x" * 500] * 20)):
        archive = warc.Archive(f"file://{tmp_path}", f"s{k}")
        for x in sent:
            archive.add(x)
        data = files.read(archive.close()[0])
        assert data[:4] == b"\x5d\x2a\x4d\x18" and list(warc.records(data)) == sent


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, f"file://{tmp_path}/w")).count() == 0
