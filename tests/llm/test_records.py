import glob
import os
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshlark.llm import common, records

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain_crc32c(data):
    c = 0xFFFFFFFF
    for v in data:
        c ^= v
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def test_checksums():
    assert records.crc32c(b"123456789") == 0xE3069283
    r = random.Random(1)
    for n in (0, 1, 3, 4, 5, 8, 1023, 1024, 1025, 5000):
        d = bytes(r.randrange(256) for _ in range(n))
        assert records.crc32c(d) == plain_crc32c(d)


def test_frames_and_damage():
    f = records.frame(b"abcdef")
    assert records.unframe(f) == b"abcdef" and len(f) == 22
    for k in range(len(f)):
        with pytest.raises(ValueError):
            records.unframe(f[:k] + bytes([f[k] ^ 1]) + f[k + 1 :])


def test_table_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["a", "the", "Ünïcode", "x" * 3000]) for _ in range(r.randint(0, 30)))) for i in r.sample(range(1000), 120)] + [(1001, None), (1002, "")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, start int")
    got = {x["doc_id"]: tuple(x)[1:] for x in records.token_records(df.repartition(5), PATH, 2).collect()}
    t, at = Tokenizer.from_file(PATH), 0
    for i, x in sorted(rows):
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert records.token_records(df.limit(0), PATH, 2).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "n"), (1, "b"), (1, "b"), (1, "a"), (0, "c")], "doc_id long, text string")
    got = sorted(records.token_records(df, PATH, 2).collect(), key=lambda x: x["start"])
    assert [x["doc_id"] for x in got] == [None, 0, 1, 1, 1]
    assert [x["start"] for x in got] == list(np.cumsum([0] + [x["n_tokens"] for x in got])[:-1])


def test_index_fetches_any_record(spark):
    folder = common.shared_folder(spark)
    df = spark.createDataFrame([(i, f"text {i}") for i in range(30)], "doc_id long, text string")
    files = records.write_records(df, folder, PATH, 2, 2)
    assert sum(f["records"] for f in files) == 30
    path = folder.removeprefix("file://")
    assert len(glob.glob(path + "/*.rec")) == len(files)
    f = files[0]
    data, index = open(f"{path}/{f['file']}.rec", "rb").read(), open(f"{path}/{f['file']}.idx", "rb").read()
    entries = list(struct.iter_unpack(records.INDEX, index))
    offset, length, _ = entries[-1]
    ids = np.frombuffer(records.unframe(data[offset - 12 : offset + length + 4]), "<u2")
    assert ids[-1] == 2 and offset + length + 4 == len(data)


@pytest.mark.parametrize("size", [1, 400, 5000])
def test_files_are_bounded(spark, monkeypatch, size):
    monkeypatch.setattr(records, "FILE_BYTES", size)
    monkeypatch.setattr(common, "ROWS", 7)
    rows = [(i, f"text {i} " * (i % 9)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = common.shared_folder(spark)
    files = records.write_records(df, folder, PATH, 2, 2)
    path = folder.removeprefix("file://")
    assert len(files) > 2 if size < 5000 else len(files) == 2
    assert all(os.path.getsize(f"{path}/{f['file']}.rec") <= size + 400 for f in files)
    got, t, at = sorted(map(tuple, records.read_records(spark, files, folder).collect())), Tokenizer.from_file(PATH), 0
    for (i, x), g in zip(rows, got, strict=True):
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        assert g == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_rows_that_repeat_id_and_text_spread(spark):
    df = spark.range(0, 4000, 1, 8).selectExpr("cast(null as long) as doc_id", "'the same text' as text")
    folder = common.shared_folder(spark)
    files = records.write_records(df, folder, PATH, 2, 4)
    assert sum(f["records"] for f in files) == 4000 and max(f["records"] for f in files) < 2500
