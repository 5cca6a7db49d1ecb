import base64
import gzip
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plenum.llm import warc

PAGES = "page_id long, url string, html string, path string, start long"


@pytest.fixture()
def archive(spark, tmp_path):
    def make(rows, splits=1):
        folder = str(tmp_path / f"w{random.random()}")
        pages = spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES).repartition(splits)
        warc.write_archives(warc.plan_records(pages), folder)
        return folder

    return make


def test_round_trip(spark, archive):
    rng = random.Random(3)
    rows = [(i, f"https://h{i % 5}.example/{i}", rng.choice(["<p>same</p>", "", None, f"<p>é {i}</p>", "x" * rng.randint(0, 5000)])) for i in range(200)]
    out = warc.read_archives(spark, archive(rows, 3)).collect()
    assert len(out) == 200 and all(r["intact"] for r in out)
    first = {}
    for i, _, html in rows:
        first.setdefault(html or "", i)
    seen = {int(r["record_id"][len("<urn:page:"):-1]): r for r in out}
    for i, url, html in rows:
        body, r = (html or "").encode(), seen[i]
        assert r["url"] == url and r["payload_bytes"] == len(body) and r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        if first[html or ""] == i:
            assert r["record_type"] == "response" and bytes(r["payload"]) == body and r["refers_to"] is None
        else:
            assert r["record_type"] == "revisit" and r["refers_to"] == f"<urn:page:{first[html or '']}>"


def test_files_are_plain_gzip(archive, tmp_path):
    import glob

    folder = archive([(1, "u", "one"), (2, "u", "two")])
    data = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{folder}/part-*")))
    assert data.count(b"WARC/1.1\r\n") == 2


def member(number, body, level=6):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    digest = base64.b32encode(hashlib.sha1(body).digest())
    head = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (number, digest, len(block))
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)  # level 0 stores, so magic bytes of the body are in the file
    return packer.compress(head + block + b"\r\n\r\n") + packer.flush()


def numbers(spark, folder, sizes=(97, 331, 1000, 10_000_000)):
    """The page numbers read from ``folder``, the same for all sizes of ranges."""
    before, found = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in sizes:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            out = warc.read_archives(spark, str(folder)).collect()
            assert all(r["intact"] for r in out)
            found.append(sorted(int(r["record_id"][len("<urn:page:"):-1]) for r in out))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(f == found[0] for f in found)
    return found[0]


def put(tmp_path, **files):
    folder = tmp_path / f"foreign{random.random()}"
    folder.mkdir()
    for name, data in files.items():
        (folder / name.replace("_", ".")).write_bytes(data)
    return folder


def test_ranges_split_anywhere_and_magic_inside_members(spark, tmp_path):
    """Members whose data hold the gzip magic by chance, cut into ranges of a few bytes."""
    members = [member(i, (b"\x1f\x8b\x08" + bytes([i])) * (1 + i % 4) + b"tail%d" % i, level=0) for i in range(40)]
    assert numbers(spark, put(tmp_path, a_warc_bin=b"".join(members))) == list(range(40))


def test_files_named_gz_are_split(spark, tmp_path):
    rng = random.Random(5)
    parts = [member(i, rng.randbytes(rng.randint(0, 400))) for i in range(60)]
    folder = put(tmp_path, a_warc_gz=b"".join(parts[:40]), b_warc_GZ=b"".join(parts[40:]), c_warc_gz=b"")
    assert numbers(spark, folder) == list(range(60))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        raw = spark.read.options(**warc.RAW_BYTES).text(str(folder / "a.warc.gz"))
        assert raw.select(F.spark_partition_id()).distinct().count() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_archives_within_records(spark, tmp_path):
    """A stored record whose payload is an archive is one record, wherever the ranges are cut."""
    inner = b"".join(member(100 + i, b"inner %d" % i) for i in range(5))
    parts = [member(1, b"before"), member(2, inner, level=0), member(3, b"between"), member(4, inner * 3, level=0), member(5, b"after")]
    assert numbers(spark, put(tmp_path, a_warc_gz=b"".join(parts))) == [1, 2, 3, 4, 5]


def test_damaged_and_cut_members(spark, tmp_path):
    """Only the damaged members are lost, not those behind them."""
    rng = random.Random(9)
    parts = [member(i, rng.randbytes(300) + b"end") for i in range(12)]
    spoilt = bytearray(parts[3])
    spoilt[150:160] = b"\xff" * 10
    cut = b"".join([*parts[:3], bytes(spoilt), parts[4], parts[5][:200], *parts[6:11], parts[11][:-20]])
    assert numbers(spark, put(tmp_path, a_warc_gz=cut)) == [0, 1, 2, 4, 6, 7, 8, 9, 10]
    stored = b"".join([member(0, b"x" * 400, level=0)[:250], *parts[1:3]])
    assert numbers(spark, put(tmp_path, b_warc_gz=stored)) == [1, 2]


def test_an_archive_in_one_member(spark, tmp_path):
    whole = b"".join(gzip.decompress(member(i, b"text\r\n\r\n%d" % i)) for i in range(7))
    assert numbers(spark, put(tmp_path, a_warc_gz=gzip.compress(whole) + member(9, b"alone")), (100, 10_000_000)) == [*range(7), 9]
    assert [r["payload"] for r in warc.parse_records(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200\r\n\r\nab")] == [b"ab"]
    assert [r["record_id"] for r in warc.parse_records(b"WARC/1.0\r\nContent-Length: 5")] == [None]


def test_many_inner_magics_take_linear_time():
    import time

    def seconds(n):
        body = b"".join(b"\x1f\x8b\x08" + i.to_bytes(4) * 50 for i in range(n))
        pieces, work, start = member(1, body, level=0).split(warc.MAGIC)[1:], warc._Stitcher(False), time.perf_counter()
        for piece in pieces:
            work.add(piece)
        assert len(work.records) == 1
        return time.perf_counter() - start

    assert seconds(20_000) < 5


def test_records_of_other_kinds():
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 14\r\n\r\na: 1\r\n\r\nb: 2\r\n\r\n\r\n"
    got = warc.parse_record(info)
    assert (got["record_type"], got["payload"], got["payload_bytes"], got["intact"]) == ("warcinfo", b"a: 1\r\n\r\nb: 2\r\n", 14, True)
    short = warc.parse_record(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\nHTTP/1.1 200\r\n\r\nab")
    assert (short["payload"], short["intact"]) == (b"ab", False)
    unknown = warc.parse_record(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nHTTP/1.1 200\r\n\r\nab")
    assert (unknown["payload"], unknown["intact"]) == (b"ab", False)


def test_awkward_pages(spark, archive):
    rows = [(1, None, "a"), (1, None, "a"), (None, "bad\r\nurl", "a"), (2, "u", None), (3, "u", "z" * 3_000_000)]
    out = warc.read_archives(spark, archive(rows)).collect()
    assert len(out) == 5
    assert sorted(r["record_type"] for r in out) == ["response"] * 3 + ["revisit"] * 2
    assert {r["refers_to"] for r in out} == {None, "<urn:page:1>"}
    assert warc.read_archives(spark, archive([])).count() == 0


def test_small_payloads_never_revisit(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    kinds = {r["page_id"]: r["record_type"] for r in warc.plan_records(pages, least=4).collect()}
    assert kinds == {1: "response", 2: "response", 3: "response", 4: "revisit"}
