import base64
import gzip
import hashlib
import io
import random

import pytest

from chromloom.llm import warc

SCHEMA = "page_id long, url string, html string"


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_chunked_framing_round_trip():
    rng = random.Random(1)
    for n in (0, 1, 7, 100, 50_000):
        payload = "".join(rng.choice("aé€😀\r\n0") for _ in range(n)).encode()
        assert warc.unchunked(warc.chunked(payload, 64)) == payload
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\n\r\n") == b"abc"
    for broken in (b"3\r\nabcd\r\n0\r\n\r\n", b"zz\r\n", b"3\r\nab"):
        with pytest.raises(ValueError):
            warc.unchunked(broken)


def test_round_trip(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("xyz é€\r\nWARC/1.1\r\n") for _ in range(400_000))
    rows = [(1, "http://a/", "<p>x</p>"), (2, "http://b/\r\nX: y", long), (3, None, None), (4, "u", ""), (5, "u", "<p>x</p>"), (-7, "u", "<p>x</p>"),
            (None, "u", "<p>x</p>"), (8, "u", "only"), (8, "u", "only"), (9, "u", long), (None, "u", "lone")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA + ", payload_digest string")
    got = warc.round_trip(df).collect()
    assert len(got) == len(rows) and all(r.problem is None for r in got)
    html = {r[0]: r[2] for r in rows if r[0] is not None}
    by_id = {r.page_id: r for r in got if r.page_id is not None}
    for k, r in by_id.items():
        assert (r.payload_bytes, r.payload_digest) == (len((html[k] or "").encode()), digest(html[k]))
    kind = {k: (r.record_type, r.refers_to) for k, r in by_id.items()}
    assert kind == {-7: ("response", None), 1: ("revisit", -7), 5: ("revisit", -7), 2: ("response", None), 9: ("revisit", 2),
                    3: ("response", None), 4: ("revisit", 3), 8: ("response", None)}
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id is None) == [("response", None), ("revisit", -7)]


def test_payloads_come_back_and_short_ones_are_kept(spark, tmp_path):
    rows = [(k, f"u{k}", "é" * k) for k in range(30)] + [(100 + k, "v", "é" * k) for k in range(30)]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA), path, least_bytes=20)
    got = warc.read_payloads(spark, path).withColumn("page_id", warc.page_of(warc.F.col("record_id"))).collect()
    assert len(got) == 60
    for r in got:
        n = r.page_id % 100
        if r.page_id >= 100 and 2 * n >= 20:
            assert r.type == "revisit" and r.payload is None and r.payload_bytes == 2 * n
        else:
            assert r.type == "response" and bytes(r.payload).decode() == "é" * n
    records = []
    for f in (tmp_path / "w").glob("*.gz"):
        records += warc.parse(io.BytesIO(gzip.decompress(f.read_bytes())))
    assert len(records) == 60


def test_damage_is_reported(spark, tmp_path):
    page = list(warc.page_records(5, "u", ("x" * 200_000).encode(), None, "0-1"))
    assert len(page) > 3
    good = list(warc.page_records(6, "u", b"fine", None, "0-2"))
    wrong = [r.replace("fine", "fin3") for r in warc.page_records(7, "u", b"fine", None, "0-3")]
    (tmp_path / "a").mkdir()
    # segments out of order and over two archives, one missing
    (tmp_path / "a" / "1.warc").write_bytes("".join(r + "\r\n\r\n" for r in [page[2], good[0], page[0]]).encode())
    (tmp_path / "a" / "2.warc").write_bytes("".join(r + "\r\n\r\n" for r in [*page[3:], wrong[0]]).encode())
    got = {warc_id(r): r for r in warc.read_payloads(spark, str(tmp_path / "a")).collect()}
    assert got[5].payload is None and "add up" in got[5].problem
    assert bytes(got[6].payload) == b"fine" and got[6].problem is None
    assert "digest" in got[7].problem
    (tmp_path / "a" / "3.warc").write_bytes((page[1] + "\r\n\r\n").encode())
    got = {warc_id(r): r for r in warc.read_payloads(spark, str(tmp_path / "a")).collect()}
    assert bytes(got[5].payload) == b"x" * 200_000 and got[5].problem is None


def warc_id(r):
    return int(r.record_id.split(":")[2])


def test_no_pages(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_given_pages(spark):
    from __spark_entry__ import queries

    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    first = {}
    for k in sorted(pages):
        first.setdefault(pages[k], k)
    got = queries()["op4_warc_round_trip"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(pages)
    for r in got:
        h = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(h.encode()), digest(h))
        assert (r.record_type, r.refers_to) == (("response", None) if first[h] == r.page_id else ("revisit", first[h]))
