import base64
import hashlib
import io
import struct
import zipfile

import pytest

from lodestrata.llm import archives


def payload_row(t):
    b = (t or "").encode()
    return len(b), base64.b32encode(hashlib.sha1(b).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(3, "http://a/x y", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (4, "u", ""), (5, "v", "long " * 50000), (None, "w", "<p>é</p>"), (None, "w", "alone"), (1, "http://b", "<p>é</p>")]
    return spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' AS sha1", "1 AS first")


def test_round_trip(pages, uri):
    got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in archives.read_archives(archives.write_archives(pages, uri("a"))).collect())
    least = {}
    for r in pages.collect():
        if r.page_id is not None:
            least[r.html or ""] = min(least.get(r.html or "", r.page_id), r.page_id)
    want = []
    for r in pages.collect():
        first = least.get(r.html or "")
        refers = first if first is not None and first != r.page_id else None
        want.append((str(r.page_id), *payload_row(r.html), "revisit" if refers is not None else "response", refers))
    assert got == sorted(want, key=lambda x: tuple(map(str, x))) or sorted(got, key=str) == sorted(want, key=str)


def test_payloads_and_empty(pages, uri):
    back = archives.read_archives(archives.write_archives(pages, uri("a")), payload=True)
    assert back.filter("page_id = 5").first().payload == "long " * 50000
    assert archives.read_archives(archives.write_archives(pages.limit(0), uri("b"))).count() == 0
    assert archives.write_archives(pages, uri("c"), least=10**6).count() > 0
    assert archives.read_archives(archives.write_archives(pages, uri("d"), least=10**6)).filter("record_type = 'revisit'").count() == 0


def package(records):
    out = io.BytesIO()
    archives.write_package(out, iter(records))
    return out.getvalue()


def test_package_is_zip_and_range_read():
    records = [(i, archives.warc_record(i, "u", b"x" * i, None, False, archives.digest32(b"x" * i)), "response") for i in range(20)]
    raw = package(records)
    reads = []

    def read_at(n, at):
        reads.append(n)
        return raw[at : at + n]

    p = archives.Package(len(raw), read_at)
    index = p.index()
    reads.clear()
    warc, _, body = archives.parse_record(p.record(*index[7][1:3]))
    assert body == b"x" * 7 and warc["WARC-Type"] == "response" and sum(reads) < 600
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.namelist() == [archives.ARCHIVE, archives.INDEX]


def test_records_after_a_full_package(monkeypatch):
    """A package that is full leaves the other records to the next one."""
    monkeypatch.setattr(archives, "PACKAGE_RECORDS", 3)
    rest, sizes = (x for x in [(i, b"x", "response") for i in range(10)]), []
    while (first := next(rest, None)) is not None:
        sizes.append(archives.write_package(io.BytesIO(), archives._with_first(first, rest)))
    assert sizes == [3, 3, 3, 1]


def test_zip64_directory():
    """Fields that overflow are read from the ZIP64 extra field, the ZIP64 end record and its locator."""
    data = b"hello"
    name = b"m"
    local = struct.pack("<4sHHHHHIIIHH", b"PK\x03\x04", 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, 20) + name + struct.pack("<HHQQ", 1, 16, 5, 5)
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\x01\x02", 45, 45, 0, 0, 0, 0, 0, 0xFFFFFFFF, 0xFFFFFFFF, 1, len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(data)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, 1, 1, len(central), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(central), 1)
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"pk!"
    raw = local + data + central + end64 + locator + end
    p = archives.Package(len(raw), lambda n, o: raw[o : o + n])
    o, n = p.locate("m")
    assert raw[o : o + n] == data


def test_damage_is_an_error():
    raw = package([(1, archives.warc_record(1, "u", b"x", None, False, "D"), "response")])
    with pytest.raises(ValueError, match="not a ZIP"):
        archives.Package(10, lambda n, o: b"\0" * n)
    with pytest.raises(ValueError, match="not a WARC"):
        archives.parse_record(b"HTTP/1.1\r\n\r\n")
    assert archives.Package(len(raw), lambda n, o: raw[o : o + n]).index()[0][0] == "1"


def records_of(manifest):
    out = []
    for r in manifest.collect():
        with open(r.file.removeprefix("file://"), "rb") as f:
            raw = f.read()
        p = archives.Package(len(raw), lambda n, o, raw=raw: raw[o : o + n])
        out += [archives.parse_record(p.record(offset, length))[0] for _, offset, length, _ in p.index()]
    return out


def test_records_have_dates_and_names_of_their_own(pages, uri):
    told = records_of(archives.write_archives(pages, uri("n"), date="2020-02-03T04:05:06Z"))
    assert len({w["WARC-Record-ID"] for w in told}) == len(told) == pages.count()
    assert {w["WARC-Date"] for w in told} == {"2020-02-03T04:05:06Z"}
    for w in told:  # a record that is referred to by name is there
        assert "WARC-Refers-To" not in w or w["WARC-Refers-To"] in {x["WARC-Record-ID"] for x in told}


def test_files_of_lost_attempts_do_not_count(pages, uri):
    """What another attempt of a task left beside the committed packages is not read."""
    place = uri("l")
    manifest = archives.write_archives(pages, place)
    first = manifest.first().file.removeprefix("file://")
    with open(first, "rb") as f, open(first.replace(".wacz", "-lost.wacz"), "wb") as g:
        g.write(f.read())
    assert archives.read_archives(manifest).count() == pages.count()


def test_hot_pages_and_digests(spark, uri, monkeypatch):
    """One page id and payload on a third of all rows, one payload on another third."""
    monkeypatch.setattr(archives, "HOT", 20)
    rows = [(7 if i % 3 == 0 else i, "u", "same" if i % 3 < 2 else f"own {i}") for i in range(900)]
    back = archives.read_archives(archives.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6), uri("h")))
    got = back.groupBy("record_type").count().collect()
    # page 1 has the smallest id of the common payload; all others that have it revisit it
    assert {r["record_type"]: r["count"] for r in got} == {"response": 301, "revisit": 599}
    assert {r.refers_to for r in back.filter("record_type = 'revisit'").collect()} == {1}


def test_records_side_by_side_come_by_one_request(monkeypatch):
    monkeypatch.setattr(archives, "AHEAD", 100)
    raw, asked = bytes(range(250)), []

    def read_at(n, offset):
        asked.append((n, offset))
        return raw[offset : offset + n]

    near = archives.Ahead(len(raw), read_at)
    assert [near(n, at) for n, at in ((10, 0), (30, 10), (60, 40), (20, 90), (150, 100), (5, 245), (0, 250))] == [raw[:10], raw[10:40], raw[40:100], raw[90:110], raw[100:250], raw[245:], b""]
    assert asked == [(100, 0), (100, 90), (150, 100)] and near(3, 0) == raw[:3]
