import glob
import hashlib
import struct
import zlib

from pyspark.sql import functions as F

from meshlark.llm import common, warc

BIG, OTHER = "<p>" + "b" * 200, "<p>é" + "c" * 300
ROWS = [(5, "u5", BIG), (2, "u2", BIG), (9, None, BIG), (1, "u1", "small"), (3, "u3", "small"), (7, "u7", None), (8, "u\r\n8", OTHER), (None, "n", OTHER), (4, "u4", ""), (6, "u6", "x" * 99 + "\r\n\r\nContent-Length: 5\r\n\r\n"), (10, "u", "z" * 300_000), (11, "u", "z" * 300_000)]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def brute(rows):
    out = []
    for i, _, html in rows:
        p = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == p and j is not None]
        head = min(same) if len(p) >= 100 and same else i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if head == i else "revisit", None if head == i else head))
    return sorted(out, key=str)


def test_results_against_brute_force(spark):
    for parts in (1, 4):
        got = sorted(map(tuple, warc.archived(table(spark).repartition(parts)).collect()), key=str)
        assert got == brute(ROWS)
    assert warc.archived(table(spark).limit(0)).count() == 0


def test_repeated_rows_have_one_response(spark):
    got = warc.archived(table(spark, [(1, "u", BIG)] * 5).repartition(3)).collect()
    assert sorted(r["record_type"] for r in got) == ["response"] + ["revisit"] * 4
    assert {r["refers_to"] for r in got if r["record_type"] == "revisit"} == {1}


def test_every_record_is_a_member_of_its_own(spark):
    folder = common.shared_folder(spark)
    records = warc.write_streams(table(spark).coalesce(1), folder)
    assert records.select("file").distinct().count() == 1
    files = records.select("file").distinct().selectExpr("file", "cast(null as array<struct<number:long,refers_to:long,head_file:string,head_number:long>>) as revisits")
    index = sorted(map(tuple, warc.normalise(files, folder).collect()))
    path = folder.removeprefix("file://")
    whole = zlib.decompress(open(glob.glob(path + "/whole-*")[0], "rb").read(), 31)
    members = open(f"{path}/{index[0][0]}", "rb").read()
    assert b"".join(zlib.decompress(members[o : o + n], 31) for _, o, n in index) == whole
    sidecar = open(f"{path}/{index[0][0]}.idx", "rb").read()
    assert list(struct.iter_unpack("<QQ", sidecar)) == [(o, n) for _, o, n in index]
    assert len(index) == len(ROWS)


def test_records_of_very_compressible_streams(monkeypatch):
    import io

    wholes = [warc.record(k, None, b"z" * n, "d", warc.record_id("f", k)) for k, n in enumerate((0, 5, 3_000_000, 1, 20_000_000))]
    packed = zlib.compress(b"".join(wholes), 9, 31)
    assert len(packed) < warc.READ  # one read holds it all
    for inflated in (1000, 4096, 4 << 20):
        monkeypatch.setattr(warc, "INFLATED", inflated)
        if inflated > 1000:
            assert list(warc._records(io.BytesIO(packed))) == wholes
        short = zlib.compress(b"".join(wholes[:2]), 9, 31)
        assert list(warc._records(io.BytesIO(short))) == wholes[:2]


def test_streams_of_empty_pages_are_closed_too(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    rows = [(k, None, None) for k in range(30)]
    records = warc.write_streams(table(spark, rows).coalesce(1), common.shared_folder(spark))
    assert records.select("file").distinct().count() > 5
    got = sorted(map(tuple, warc.archived(table(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_record_ids_and_headers(spark):
    folder = common.shared_folder(spark)
    rows = [(1, "u", BIG), (1, "u", BIG), (2, "v", BIG), (2, "v", "x")]
    records = warc.write_streams(table(spark, rows).coalesce(1), folder)
    again = warc.revisits(records, folder).groupBy("file").agg(F.collect_list(F.struct("number", "refers_to", "head_file", "head_number")).alias("revisits"))
    index = sorted(map(tuple, warc.normalise(again, folder).collect()))
    path = folder.removeprefix("file://")
    heads = []
    for name, o, n in index:
        with open(f"{path}/{name}", "rb") as f:
            f.seek(o)
            heads.append(warc.parse(zlib.decompress(f.read(n), 31))[0])
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == 4 and all(h["Content-Type"] == "application/http; msgtype=response" for h in heads)
    responses = {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    assert [h["WARC-Type"] for h in heads].count("revisit") == 2
    assert all(h["WARC-Refers-To"] in responses and h["X-Refers-To-Page-ID"] == "1" for h in heads if h["WARC-Type"] == "revisit")
