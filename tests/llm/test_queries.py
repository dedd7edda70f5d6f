"""Each registered query over a whole small table against brute force, or SQL where there is some."""

import hashlib
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

from meshlark.llm import queries

sys.path.insert(0, str(Path(__file__).parent))
import test_pii  # noqa: E402
import test_secrets  # noqa: E402
import test_simhash  # noqa: E402
from meshlark.llm import media, pii, secrets  # noqa: E402
from oracle import connect, same  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())


def rows(spark, name, *columns):
    return sorted(map(tuple, queries.QUERIES[name](spark, SF).select(*columns).collect()))


def test_names_and_sql():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)] + ["pipeline"]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], connect(SF))


def test_op1(spark, docs):
    t = Tokenizer.from_file(queries.WORD_BPE)
    want = []
    for i, x in docs:
        ids = t.encode(x, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows(spark, "op1_bpe_round_trip", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_op2(spark, docs):
    want = []
    for i, x in docs:
        p = media.payload(x)
        png = media.to_png(p)
        want.append((i, len(x.encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(png), hashlib.sha256(png).hexdigest()))
    assert rows(spark, "op2_media_columns", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256") == want


def test_op3(spark, docs):
    t, want = Tokenizer.from_file(queries.WORD_BPE), []
    for i, x in docs:
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        want += [(i, p, lo, len(ids[lo : lo + 4096]), zlib.crc32(np.array(ids[lo : lo + 4096], "<u4").tobytes())) for p, lo in enumerate(range(0, len(ids), 4096))]
    got = rows(spark, "op3_best_fit_packing", "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    assert [g[:5] for g in got] == want
    spans = {}
    for g in got:
        spans.setdefault(g[5], []).append((g[6], g[3]))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert len(spans) <= -(-sum(w[3] for w in want) // 4096) + 1


@pytest.mark.parametrize("name, brute, kinds, counted", [("op4_personal_data", test_pii.brute, pii.KINDS, 4), ("op9_secret_scan", test_secrets.brute, secrets.KINDS, 3)])
def test_op4_and_op9(spark, docs, name, brute, kinds, counted):
    got = queries.QUERIES[name](spark, SF).collect()
    found = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs)
    for i, x in docs:
        b = brute(x)
        joined = [f"{kinds[k]}:{s}:{e}" for s, k, e in b]
        assert [found[i][f"n_{kinds[k]}"] for k in range(counted)] == [sum(c == k for _, c, _ in b) for k in range(counted)]
        assert found[i]["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert set(joined) <= set(found[i]["spans"].split(","))


def test_op6(spark, docs):
    fps = [(i, test_simhash.brute_fingerprint(x)) for i, x in docs]
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(fps, test_simhash.brute_components(fps))]
    assert rows(spark, "op6_simhash_components", "doc_id", "fingerprint", "component_id") == want


def test_op7(spark, docs):
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_quality_scores"](spark, SF).collect()}
    assert sorted(got) == [i for i, _ in docs]
    for i, r in got.items():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)


def test_op10(spark, docs):
    t, at, want = Tokenizer.from_file(queries.BYTE_BPE), 0, []
    for i, x in docs:
        ids = [*t.encode(x, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows(spark, "op10_token_records", "doc_id", "start", "n_tokens", "ids_crc32") == want
