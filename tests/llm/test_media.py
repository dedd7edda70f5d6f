import glob
import hashlib
import math
import tarfile
import zlib

import numpy as np

from meshlark.llm import common, media

ROWS = [(1, "short", 0), (2, None, 0), (3, "", 0), (4, "é" * 1000, 0), (4, "é" * 1000, 1), (None, "x" * 192, 0), (5, "y" * 100_000, 0)]


def table(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, digest int")


def test_png_round_trip():
    for text in ("", "a", "é" * 97, "b" * 192, "c" * 193):
        p = media.payload(text)
        assert len(p) % 192 == 0 and len(p) > 0 and p.rstrip(b" ") == text.encode().rstrip(b" ")
        assert media.from_png(media.to_png(p)) == p


def test_results_against_brute_force(spark):
    got = {(r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.media_columns(table(spark)).collect()}
    want = set()
    for i, t, _ in ROWS:
        p = media.payload(t or "")
        want.add((i, len((t or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == want


def decoded(spark, folder, images):
    """(width, height, samples) of each PNG as Spark's image source, with Java's decoder, reads it."""
    for k, data in enumerate(images):
        (folder / f"{k}.png").write_bytes(data)
    got = {}
    for r in spark.read.format("image").load(str(folder)).select("image.*").collect():
        samples = np.frombuffer(bytes(r["data"]), np.uint8).reshape(r["height"], r["width"], 3)[:, :, ::-1]  # blue comes first there
        got[int(r["origin"].rsplit("/", 1)[1][:-4])] = (r["width"], r["height"], samples.tobytes())
    return [got[k] for k in range(len(images))]


def test_another_decoder_reads_the_same_samples(spark, tmp_path):
    payloads = [media.payload(t) for t in ("", "é" * 97, "The quick brown fox. " * 300, "".join(map(chr, range(1, 600))))]
    pngs = [media.to_png(p) for p in payloads]
    assert decoded(spark, tmp_path, pngs) == [(64, len(p) // 192, p) for p in payloads]


def test_stored_shards_by_another_decoder(spark, tmp_path):
    folder = common.shared_folder(spark)
    by_id = {(r["doc_id"], r["n_bytes"]): r for r in media.write_shards(table(spark), folder).collect()}
    pngs = []
    for i, t, _ in ROWS:
        r = by_id[i, len((t or "").encode())]
        with open(f"{folder.removeprefix('file://')}/{r['shard']}", "rb") as f:
            f.seek(r["offset"])
            pngs.append(f.read(r["length"]))
    assert [x for _, _, x in decoded(spark, tmp_path, pngs)] == [media.payload(t or "") for _, t, _ in ROWS]


def test_features_by_hand(spark):
    got = {(r["doc_id"], r["n_bytes"]): r["feature"] for r in media.media_columns(table(spark)).collect()}
    for i, t, _ in ROWS:
        p = media.payload(t or "")
        mean = sum(p) / len(p)
        spread = math.sqrt(sum((x - mean) ** 2 for x in p) / len(p))
        sizes = [len(p) // 16 + (k < len(p) % 16) for k in range(16)]
        cells, at = [], 0
        for n in sizes:
            cells.append(sum(p[at : at + n]) // n)
            at += n
        bits = sum((c > sorted(cells)[8]) << k for k, c in enumerate(cells))
        assert got[i, len((t or "").encode())] == f"64x{len(p) // 192}:{mean:.3f}:{spread:.3f}:{bits:04x}"


def test_each_content_has_one_address(spark):
    folder = common.shared_folder(spark)
    df = spark.createDataFrame([(k, f"text {k % 3}") for k in range(60)] + [(60, "text 0 ")], "doc_id long, text string").repartition(5)
    manifest = media.write_shards(df, folder)
    assert manifest.select("shard", "offset").distinct().count() > 3  # tasks store copies of their own
    one = media.contents(manifest)
    assert one.count() == 3 == one.select("shard", "offset").distinct().count()
    got = media.metadata(one, folder).collect()
    assert all((r["width"], r["height"], r["bits"], r["samples"]) == (64, 1, 8, 3) for r in got)


def test_rows_and_equal_values_of_equal_texts(spark):
    rows = media.media_columns(table(spark).repartition(4)).collect()
    assert len(rows) == len(ROWS)
    same = [tuple(r)[1:] for r in rows if r["doc_id"] == 4]
    assert len(same) == 2 and same[0] == same[1]
    assert media.media_columns(table(spark).limit(0)).count() == 0


def test_shards_are_tars_addressed_by_content_and_headers_suffice(spark):
    folder = common.shared_folder(spark)
    manifest = media.write_shards(table(spark), folder)
    names = set()
    for path in glob.glob(folder.removeprefix("file://") + "/shard-*.tar"):
        with tarfile.open(path) as t:
            for m in t.getmembers():
                data = t.extractfile(m).read()
                assert hashlib.sha256(data).hexdigest() in m.name
                names.add(m.name)
    assert len(names) == 5  # texts that differ
    heads = media.metadata(manifest, folder).collect()
    assert all(r["width"] == 64 and r["bits"] == 8 and r["samples"] == 3 for r in heads)
    assert {r["height"] for r in heads if r["doc_id"] == 5} == {-(-100_000 // 192)}
