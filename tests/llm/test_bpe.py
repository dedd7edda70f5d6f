import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meshlark.llm import bpe

FILES = [public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")]
ODD = ["", "a" * 5000, "ab" * 3001, "é" * 2000, "Σας ΣΑΣ ΟΔΟΣ", "İstanbul", "日本語テキスト" * 500, "é x̧", "x<|endoftext|>y", "<|startoftext|>", "a\x1cb\x1fc", "a  b\x85c", "don't we'll 'S ''s!!'s", "  lead  \n\n tail  ", "😀" * 1400, " " * 3000, "1234567890" * 300, "½²³ª º", "ǅ Ǆ", "\x00\x01", "ß ẞ ſ K"]


def library(path):
    return Tokenizer.from_file(path)


@pytest.mark.parametrize("path", FILES)
def test_odd_texts(path):
    c, t = bpe.coder(path), library(path)
    r = random.Random(1)
    long = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz"[: r.choice([2, 5, 26])]) for _ in range(r.randint(1000, 6000))) for _ in range(25)]
    for x in ODD + long:
        want = t.encode(x, add_special_tokens=False).ids
        got = c.encode(x)
        assert got.tolist() == want, x[:40]
        assert c.decode(got) == t.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("path", FILES)
def test_core_is_used_and_equals_the_library_model(path):
    c = bpe.coder(path)
    assert c.core is not None
    r = random.Random(2)
    for _ in range(2000):
        w = "".join(r.choice("abcdetnséüñ'") for _ in range(r.randint(1, 14)))
        assert np.frombuffer(c.packed(w.encode()), "<u4").tolist() == c.unit_ids("".join(map(c.letters.__getitem__, w.encode())))


@pytest.mark.parametrize("path", FILES)
def test_every_plain_character_in_company(path):
    c, t = bpe.coder(path), library(path)
    for k in range(0x260):
        x = f"a{chr(k)}b {chr(k)}{chr(k)}1 '{chr(k)}s  {chr(k)} "
        assert c.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids, hex(k)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x250), max_size=40))
def test_any_plain_text(text):
    for path in FILES:
        assert bpe.coder(path).encode(text).tolist() == library_ids(path, text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    for path in FILES:
        assert bpe.coder(path).encode(text).tolist() == library_ids(path, text)


_open: dict = {}


def library_ids(path, text):
    if path not in _open:
        _open[path] = library(path)
    return _open[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", FILES)
def test_tree_equals_direct_encoding_for_every_leaf_size(path):
    c, r = bpe.coder(path), random.Random(3)
    for n in (17, 100, 700):
        unit = "".join(r.choice("aabcdethinosr") for _ in range(n))
        direct = [x.id for x in c.last.model.tokenize(unit)]
        for leaf in (1, 2, 7, 64):
            assert c.tree(unit, leaf) == direct


@pytest.mark.parametrize("path", FILES)
def test_text_tree_for_every_cut(path):
    c, t, r = bpe.coder(path), library(path), random.Random(4)
    for _ in range(400):
        x = "".join(r.choice(["a", "b", "'s", "'r", "e", "'", " ", "  ", "\n", "1", "2", "é", "!", "?!", " 've", "ll"]) for _ in range(r.randint(1, 60)))
        want = t.encode(x, add_special_tokens=False).ids
        for leaf in (1, 2, 3, 5, 9, 30):
            assert np.frombuffer(b"".join(c.text_tree(x.lower() if c.lower else x, leaf)), "<u4").tolist() == want


@pytest.mark.parametrize("path", FILES)
def test_long_words_inside_long_texts(path):
    c, t, r = bpe.coder(path), library(path), random.Random(5)
    for n in (1000, 1024, 1025, 5000, 40000):
        x = "some words, " * 200 + "".join(r.choice("abcdeé") for _ in range(n)) + " " * n + "!" * n + " and more's" * 300
        assert c.encode(x).tolist() == t.encode(x, add_special_tokens=False).ids
    assert max(map(len, c.words)) <= bpe.LONG_UNIT // 4  # long words take no place in the table


@pytest.mark.parametrize("path", FILES)
def test_the_table_s_texts_go_through_joins(path):
    """Every text above a leaf's length is joined from its leaves: one join less than leaves."""
    import pyarrow.parquet as pq

    texts = [x or "" for x in pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()]
    c = bpe.Coder(path)
    tokens = sum(len(c.encode(x)) for x in texts)
    in_tree = sum(len(c.encode(x)) for x in texts if len(x) > bpe.LEAF)
    plain = [x for x in texts if not c.odd.search(x)]
    assert c.joins == sum(max(0, -(-len(x) // bpe.LEAF) - 1) for x in plain) + sum(-(-len(x) // bpe.LEAF) - 1 for x in plain if len(x) > bpe.LEAF)
    assert c.windows >= c.joins > len(texts) and in_tree > 0.8 * tokens


def test_round_trip_table(spark):
    path = FILES[0]
    rows = [(1, "Hello there", 5), (None, None, 6), (2, "", 7), (1, "Hello there", 8), (3, "word " * 3000 + "x" * 4000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    got = sorted(map(tuple, bpe.round_trip(df, path).collect()), key=str)
    t = library(path)
    want = []
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.round_trip(df.limit(0), path).count() == 0
    back = bpe.decode(bpe.encode(df, path), path).where("doc_id = 1").first()["text"]
    assert back == t.decode(t.encode("Hello there").ids)
