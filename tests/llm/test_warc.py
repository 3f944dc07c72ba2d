"""WARC: against SQL, round trips, deduplication of archives, and broken ones."""

import gzip

import pytest

from sparkloom.llm import warc


def test_query_matches_duckdb(spark, small, duck, same):
    same(warc.op4_warc(spark, small).toPandas(), duck.execute(warc.SQL).df())


ROWS = [(1, "http://a/", "<p>x\r\n\r\nWARC/1.1\r\n</p>"), (5, "http://b/", "same ä"), (2, "http://c/", "same ä"), (3, None, None), (4, "u\r\nv", ""), (6, "http://d/", "y" * 300_000), (7, "http://e/", "same ä"), (7, "http://e/", "same ä"), (None, "http://f/", "same ä"), (None, "n", "alone")]


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    return warc.write_archive(pages, f"file://{tmp_path_factory.mktemp('w')}/a", records_per_file=3)


def test_round_trip(spark, archive):
    read = warc.read_archive(spark, archive, payloads=True).collect()
    assert len(read) == len(ROWS)
    responses = {r["page_id"]: r["payload"].decode() for r in read if r["record_type"] == "response"}
    assert responses == {1: ROWS[0][2], 2: "same ä", 3: "", 6: "y" * 300_000, None: "alone"}
    done = warc.resolve_revisits(warc.read_archive(spark, archive)).collect()
    assert sorted((str(r["page_id"]), r["refers_to"], r["payload_bytes"]) for r in done if r["record_type"] == "revisit") == [("4", 3, 0), ("5", 2, 7), ("7", 2, 7), ("7", 2, 7), ("None", 2, 7)]
    assert {r["target_uri"] for r in done if r["page_id"] in (3, 4)} == {None, "u v"}
    assert all(r["resolved"] for r in done)


def test_archives_are_rewritten(spark, archive, tmp_path):
    rest = warc.deduplicate_archive(spark, archive, f"file://{tmp_path}/b")
    assert rest.count() == 0
    key = lambda r: (str(r["page_id"]), r["record_type"], r["payload_digest"], r["payload_bytes"])
    one, two = ([key(r) for r in warc.resolve_revisits(warc.read_archive(spark, p)).collect()] for p in (archive, f"file://{tmp_path}/b"))
    assert sorted(one) == sorted(two)


def test_parser_takes_any_pieces_and_refuses_broken_archives():
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\na\r\n\r\n\r\n\r\n"
    whole = record * 3
    for step in (1, 7, 1000):
        pieces = (whole[i : i + step] for i in range(0, len(whole), step))
        assert [r["block"] for r in warc.parse_records(pieces, "x")] == [b"a\r\n\r\n"] * 3
    for bad in (whole[:-3], b"no" + whole, whole + b"WARC/1.1\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse_records(iter([bad]), "x"))
    members = gzip.compress(record) + gzip.compress(record)
    assert len(list(warc.parse_records(warc._unpacked(members), "x"))) == 2


def test_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string, extra int")
    path = warc.write_archive(pages, f"file://{tmp_path}/n")
    assert warc.resolve_revisits(warc.read_archive(spark, path)).count() == 0


def test_unpacking_takes_linear_time():
    import time

    data = bytes(range(256)) * (1 << 18)  # 64 MB
    packed = gzip.compress(data[: 32 << 20], 1) + gzip.compress(data[32 << 20 :], 1) + gzip.compress(b"")
    began = time.process_time()
    assert sum(map(len, warc._unpacked(packed))) == len(data)
    assert time.process_time() - began < 5
    noise = gzip.compress(bytes(x % 251 for x in range(100_000)) + b"end")
    assert b"".join(warc._unpacked(noise * 3, 100)) == gzip.decompress(noise) * 3


def test_payloads_of_other_charsets_are_rewritten_byte_by_byte(spark, tmp_path):
    payload = "Grüße".encode("latin-1") + b"\xff\x00"
    (tmp_path / "in").mkdir()
    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nWARC-Page-ID: 4\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (len(payload), payload)
    (tmp_path / "in" / "a.warc.gz").write_bytes(gzip.compress(record))
    assert warc.deduplicate_archive(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").count() == 0
    assert [bytes(r["payload"]) for r in warc.read_archive(spark, f"file://{tmp_path}/out", payloads=True).collect()] == [payload]


def test_extra_columns_whose_names_clash(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "x", 1, True) for r in ROWS], "page_id long, url string, html string, payload_digest string, first_id int, shared boolean")
    got = warc.resolve_revisits(warc.read_archive(spark, warc.write_archive(pages, f"file://{tmp_path}/c"))).collect()
    assert sorted(str(r["page_id"]) for r in got) == sorted(str(r[0]) for r in ROWS)
