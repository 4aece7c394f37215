import hashlib
import struct

import pytest
import zstandard

from rillstone.llm import warc as Z


def page(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


BIG = "<html>" + "x" * 200


def test_round_trip(spark):
    rows = [
        (4, "http://a/é\r\nInjected: 1", BIG), (2, "http://b", BIG), (3, None, BIG), (1, "http://c", "small"), (5, "http://d", "small"),
        (6, "http://e", None), (7, "http://f", ""), (8, "http://g", "é" * 50), (9, "http://h", "é" * 50), (10, "http://i", "WARC/1.1\r\n\r\n" * 30),
    ]
    out = {r["page_id"]: r for r in Z.round_trip(page(spark, *rows).repartition(3)).collect()}
    assert sorted(out) == sorted(r[0] for r in rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        assert out[i]["payload_bytes"] == len(payload) and out[i]["payload_digest"] == hashlib.sha256(payload).hexdigest()
        first = min(j for j, _, h in rows if h == html) if len(payload) >= 100 else i
        assert (out[i]["record_type"], out[i]["refers_to"]) == (("response", None) if i == first else ("revisit", first))
        assert out[i]["payload"] == (payload if i == first else None)
    assert "Injected" in out[4]["url"] and "\n" not in out[4]["url"]


def test_nulls_repeats_and_empty_table(spark):
    rows = [(1, "u", BIG), (1, "u", BIG), (None, "v", BIG), (2, "w", BIG)]
    out = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in Z.round_trip(page(spark, *rows)).collect())
    assert out == [("1", "response", None), ("1", "response", None), ("2", "revisit", 1), ("None", "revisit", 1)]
    assert Z.round_trip(page(spark)).count() == 0
    alone = Z.round_trip(page(spark, (None, None, BIG), (None, None, BIG))).collect()
    assert [r["record_type"] for r in alone] == ["response", "response"]


def test_archives_are_zstandard_with_a_leading_dictionary(spark, tmp_path, request):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    Z.write(page(spark, *((i, f"http://a/{i}", f"<html><body>text {i} {'common words ' * 20}</body></html>") for i in range(200))), str(tmp_path / "w"), archive_bytes=1 << 14)
    files = [p for p in (tmp_path / "w").iterdir() if p.name.startswith("part-") and p.stat().st_size]
    assert len(files) > 1
    total = 0
    for p in files:
        raw = p.read_bytes()
        magic, size = struct.unpack_from("<II", raw)
        assert magic == Z.DICTIONARY_MAGIC
        total += len(list(Z.records(raw)))
        # a decoder that knows nothing of archives reads the same bytes, given the dictionary
        decoder = zstandard.ZstdDecompressor(dict_data=Z.load(raw[8 : 8 + size]))
        with decoder.stream_reader(raw, read_across_frames=True) as stream:
            assert stream.read().count(b"WARC/1.1\r\n") == len(list(Z.records(raw)))
    assert total == 200


def archive(*parts):
    return b"".join(parts)


def frame(raw):
    return zstandard.ZstdCompressor(write_checksum=True).compress(raw)


def test_frame_lengths():
    import os

    for size in (0, 1, 255, 256, 70_000, 300_000):
        for body in (b"a" * size, os.urandom(size)):
            for checksum in (True, False):
                for known in (True, False):
                    raw = zstandard.ZstdCompressor(write_checksum=checksum, write_content_size=known).compress(body)
                    assert Z.frame_end(memoryview(raw + b"tail"), 0) == len(raw)


@pytest.mark.parametrize(
    "change",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARC/9.9"),
        lambda r: r.replace(b"WARC-Date", b"WARC-Dote"),
        lambda r: r.replace(b"Content-Length: 5", b"Content-Length: 4"),
        lambda r: r.replace(b"hello", b"jello"),
        lambda r: r[:-1],
        lambda r: r.replace(b"WARC-Type: ", b"WARC-Type="),
    ],
)
def test_wrong_records_are_errors(change):
    good = Z.record(1, "http://a", b"hello")
    assert Z.parse(good)[1] == b"hello"
    with pytest.raises(ValueError):
        Z.parse(change(good))


def test_wrong_archives_are_errors():
    good = frame(Z.record(1, "http://a", b"hello"))
    assert len(list(Z.records(archive(good, Z.SEPARATOR.encode(), good)))) == 2
    for bad in (good[:-2], good + b"\x00" * 9, good + Z.dictionary_frame(b"x" * 20), good + b"123"):
        with pytest.raises((ValueError, zstandard.ZstdError, IndexError)):
            list(Z.records(bad))


def test_short_samples_still_give_a_dictionary():
    assert Z.train([]) and Z.train([b"ab"])


def test_columns_of_any_name_and_long_pages(spark):
    rows = [(1, "http://a.org/", "x" * 3_000_000), (2, "http://b.org/", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "page_id as payload", "page_id as RECORD", "page_id as `a.b`")
    out = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in Z.round_trip(pages).collect()}
    assert out == {1: (3_000_000, "response", None), 2: (3_000_000, "revisit", 1)}
