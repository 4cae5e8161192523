"""WARC archives: round trip, order, and the loser tree."""

import base64
import hashlib
import random

from pyspark.sql import functions as F

from tests.conftest import SF001
from vigil.llm import warc


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(3)
    for k in range(12):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def brute(rows):
    first = {}
    for i, _, _, p in rows:
        p = p or ""
        if p not in first or (i is not None and (first[p] is None or i < first[p])):
            first[p] = i
    out = []
    for i, _, _, p in rows:
        b = (p or "").encode()
        again = i != first[p or ""]
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response",
                    first[p or ""] if again else None))
    return sorted(out, key=str)


def indexed(spark, rows, **kw):
    df = spark.createDataFrame(rows, "capture_id long, url string, fetched string, payload string")
    return warc.archive_and_index(df, **kw)


def digest_rows(index):
    return sorted(((None if r["record_id"] == "null" else int(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"],
                    None if r["refers_to"] is None else int(r["refers_to"])) for r in index.collect()), key=str)


HARD = [
    (1, "http://a.example/x", "20200101000000", "same"), (2, "http://www.a.example:80/x#f", "20200102000000", "same"),
    (3, "https://u:p@b.example/", "20200101000000", "WARC/1.0\r\nContent-Length: 5\r\n\r\nx\r\n\r\n"), (4, None, "20200101000000", None),
    (5, "http://a.example/x\r\nEvil: y", "20200101000001", ""), (6, "nohost", None, "é" * 70000), (7, "http://a.example/x", "20190101000000", "same"),
    (7, "http://a.example/x", "20190101000000", "same"), (None, "http://c.example", "20200101000000", "same"),
    (None, "http://c.example", "20200101000000", "only without id\r\n\r\n"),
]


def test_round_trip(spark):
    index = indexed(spark, HARD)
    assert digest_rows(index) == brute(HARD)
    assert all(r["intact"] for r in index.collect())
    urls = {r["record_id"]: r["url"] for r in index.collect()}
    assert urls["4"] is None and urls["5"] == "http://a.example/x%0D%0AEvil: y"


def test_given_pages_come_back_and_ranges_are_ordered(spark):
    pages = spark.read.parquet(f"{SF001}/pages.parquet")
    rows = [(r["page_id"], r["url"], f"2020010{r['page_id'] % 7 + 1}000000", r["html"]) for r in pages.collect()]
    df = spark.createDataFrame(rows, "capture_id long, url string, fetched string, payload string").repartition(5)
    import vigil.session as session
    path = session.scratch_path(spark, "warc-test-" + str(random.random())[2:])
    warc.write_archives(df, path, archive_bytes=20_000)
    index = warc.read_index(spark, path, range_rows=8)
    assert digest_rows(index) == brute(rows)
    parts = index.select("url_key", "fetched", "record_id", "archive", F.spark_partition_id().alias("p")).collect()
    assert len({r["archive"] for r in parts}) > 3 and len({r["p"] for r in parts}) > 3
    keys = [(r["url_key"], r["fetched"], r["record_id"]) for r in sorted(parts, key=lambda r: r["p"])]
    assert keys == sorted(keys)


def test_minimum_size_and_empty(spark):
    rows = [(1, "u", "20200101000000", "ab"), (2, "u", "20200101000000", "ab"), (3, "u", "20200101000000", "long"), (4, "u", "20200101000000", "long")]
    got = {r["record_id"]: r["record_type"] for r in indexed(spark, rows, min_revisit_bytes=3).collect()}
    assert got == {"1": "response", "2": "response", "3": "response", "4": "revisit"}
    df = spark.createDataFrame([], "capture_id long, url string, fetched string, payload string")
    assert warc.archive_and_index(df).count() == 0
    more = spark.createDataFrame([(1, "u", "20200101000000", "x", "d", 9)],
                                 "capture_id long, url string, fetched string, payload string, digest string, bytes long")
    assert warc.archive_and_index(more).count() == 1


def foreign(version=b"WARC/1.0", digest=None):
    """Records of another writer: (bytes of each, payload of each)."""
    def record(kind, block, *lines):
        head = [version, b"warc-type: " + kind, b"WARC-Record-ID: <urn:uuid:" + kind + b">", b"WARC-Date: 2021-02-03T04:05:06Z", *lines,
                b"a line without a colon", b"Content-Length: " + str(len(block)).encode()]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>no length</p>"
    cased = b"HTTP/1.1 200 OK\r\ncontent-LENGTH: 4\r\n\r\nbody"
    uri = b"WARC-Target-URI: http://a.example/p"
    return [record(b"warcinfo", b"software: y\r\n", b"Content-Type: application/warc-fields"),
            record(b"response", page, uri, b"Content-Type: application/http; msgtype=response"),
            record(b"resource", b"plain text", uri), record(b"response", cased, uri, b"Content-Type: application/http")], \
        [b"software: y\r\n", b"<p>no length</p>", b"plain text", b"body"]


def entries(content):
    return list(warc.parse_archive(content, "x"))


def test_foreign_records_and_gzip_members():
    import gzip

    records, payloads = foreign(b"WARC/1.1")
    want = [base64.b32encode(hashlib.sha1(p).digest()).decode() for p in payloads]
    plain = b"".join(records)
    members = [gzip.compress(r) for r in records]
    for content in (plain, gzip.compress(plain), b"".join(members), gzip.compress(records[0] + records[1]) + b"".join(members[2:])):
        got = entries(content)
        assert [e[5] for e in got] == want and [e[6] for e in got] == [len(p) for p in payloads]
        assert all(e[12] for e in got) and [plain[e[9]:e[9] + e[10]] for e in got] == [r[:-4] for r in records]
    for e, r in zip(entries(b"".join(members)), records, strict=True):  # each record from its own member
        assert gzip.decompress(b"".join(members)[e[11]:])[:len(r)] == r


def test_truncated_and_damaged_archives():
    import gzip

    records, _ = foreign()
    plain, members = b"".join(records), [gzip.compress(r) for r in records]
    full = entries(plain)
    for cut in range(0, len(plain), 7):
        got = entries(plain[:cut])
        whole = [e for e in full if e[9] + e[10] <= cut]
        assert got[:len(whole)] == whole and len(got) <= len(whole) + 1 and not any(e[12] for e in got[len(whole):])
    packed = b"".join(members)
    for cut in (len(packed) - 5, len(packed) - len(members[3]) // 2, len(packed) - len(members[3])):
        assert [e[:9] for e in entries(packed[:cut])][:3] == [e[:9] for e in full[:3]]
    damaged = bytearray(packed)
    damaged[len(members[0]) + len(members[1]) + 20] ^= 255
    assert [e[:9] for e in entries(bytes(damaged))][:2] == [e[:9] for e in full[:2]]
    for bad in (b"not an archive\r\n\r\n", b"WARC/1.0\r\nno length: 1\r\n\r\n", b"text"):
        try:
            entries(bad)
        except ValueError:
            continue
        raise AssertionError(bad)
    assert entries(b"") == []


def test_large_ids_keep_their_results(spark, tmp_path):
    from vigil.llm.queries import QUERIES

    rows = [(i, "http://a.example/x/y", "p") for i in (1, 2**33, 2**50, 2**62, -(2**62), -3)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in QUERIES["op3_warc_index"](spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in rows} and all(len(r["fetched"]) == 14 for r in got.values())
    assert QUERIES["op10_url_filter"](spark, str(tmp_path)).count() == len(rows)
