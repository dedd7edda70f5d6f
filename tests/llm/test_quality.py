import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from meshlark.llm import quality, queries

SF = "/root/testdata/sf0.01"


def entries(x):
    """(row, column, value) of the entries of a dense matrix that are not zero."""
    row, column = np.nonzero(x)
    return row, column, x[row, column]


def brute_bucket(word):
    total = sum((v + 1) * pow(0x9E3779B97F4A7C15, k % 64, 1 << 64) for k, v in enumerate(word))
    return (total * 0xD6E8FEB86659FD93 % (1 << 64)) >> 52


def test_buckets_of_words(monkeypatch):
    r = np.random.default_rng(3)
    texts = ["", " ", "a", " a  b\n", "é\u00a0x y", "w" * 200 + " v", *("".join(r.choice(list("ab \n\té"), 300)) for _ in range(20))]
    want = [[brute_bucket(w) for w in re.split(rb"[\t-\r ]+", t.encode()) if w] for t in texts]
    assert [quality.buckets(t).tolist() for t in texts] == want
    monkeypatch.setattr(quality, "PIECE", 64)
    for t, w in zip(texts, want):
        long = [k for k, x in enumerate(x for x in re.split(rb"[\t-\r ]+", t.encode()) if x) if len(x) >= 64]
        got = quality.buckets(t).tolist()
        assert len(got) == len(w) and all(a == b for k, (a, b) in enumerate(zip(got, w)) if k not in long)


def brute_inputs(text):
    """Inputs of a text by their description, one at a time."""
    words, lines = text.split(), text.split("\n")
    n, x = len(words), {}
    x[quality.WORDS], x[quality.WORDS + 1] = 1.0, math.log1p(len(text)) / 10
    if not n:
        return x | {quality.WORDS + 2: 1.0}
    buckets = [brute_bucket(w) for w in re.split(rb"[\t-\r ]+", text.encode()) if w]
    counts = Counter(buckets)
    norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values()))
    x |= {k: math.log1p(c) / norm for k, c in counts.items()}
    more = [min(text.count(c) / n, 2) for c in ".,!|#$%&*"]
    more += [sum(w.isupper() for w in words) / n, min(sum(c in "0123456789" for c in text) / len(text) * 5, 2), len(set(words)) / n]
    more += [sum(a == b for a, b in zip(buckets, buckets[1:])) / (len(buckets) - 1) if len(buckets) > 1 else 0, len(text) / n / 10, math.log1p(len(lines)) / 5, min(n / len(lines) / 50, 2)]
    more += [math.log1p(max(counts.values())) / math.log1p(n), sum(w.istitle() for w in words) / n, sum(a == b for a, b in zip(buckets, buckets[2:])) / (len(buckets) - 2) if len(buckets) > 2 else 0]
    more += [min(max(map(len, words)) / 50, 3), len(set(lines)) / len(lines)]
    return x | {quality.WORDS + 3 + k: v for k, v in enumerate(more)}


def brute_score(m, text):
    """The score by all pairs of inputs, one at a time."""
    x = {k: v for k, v in brute_inputs(text).items() if v}
    raw = m.bias + sum(float(m.linear[k]) * v for k, v in x.items())
    for (i, a), (j, b) in combinations(x.items(), 2):
        raw += float(m.factors[i].astype(float) @ m.factors[j]) * a * b
    return 1 / (1 + math.exp(-max(-30, min(30, raw))))


def test_sum_of_squares_identity():
    r = np.random.default_rng(1)
    m = quality.Machine(0.3, r.normal(size=quality.SIZE).astype(np.float32), r.normal(size=(quality.SIZE, quality.RANK)).astype(np.float32))
    x = np.zeros((1, quality.SIZE), np.float32)
    on = r.choice(quality.SIZE, 12, replace=False)
    x[0, on] = r.normal(size=12)
    pairs = sum(float(m.factors[i] @ m.factors[j]) * x[0, i] * x[0, j] for i, j in combinations(on, 2))
    assert abs(m.raw(*entries(x))[0] - (m.bias + float(x[0] @ m.linear) + pairs)) < 1e-3


def test_inputs_of_odd_texts():
    texts = ["", " ", "a", "\n\n", "é", "x" * 100_000, "a b " * 50_000, "\ud83d", "A a A a A", "One Two! 3,4.5 | #\n\nOne Two"]
    row, column, value = quality.inputs(texts)
    assert np.isfinite(value).all() and sorted(set(row.tolist())) == list(range(len(texts))) and len(quality.inputs([])[0]) == 0
    for k, t in enumerate(texts):
        if t == "\ud83d":
            continue
        got = dict(zip(column[row == k].tolist(), value[row == k].tolist()))
        want = {i: v for i, v in brute_inputs(t).items() if v}
        assert got.keys() == want.keys() and all(abs(got[i] - v) < 1e-5 for i, v in want.items()), t[:20]


def test_query_s_scores_against_all_pairs_of_inputs(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op7_quality_scores"](spark, sf).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows[::4]:
        assert abs(got[r["doc_id"]] - brute_score(m, r["text"] or "")) < 1e-3


def test_a_much_repeated_id_reaches_the_driver_once(spark):
    docs = spark.range(20_000).selectExpr("5L as doc_id", "concat('some text ', id % 7) as text")
    labels = spark.createDataFrame([(5, 1)], "doc_id long, quality int")
    seen = []
    whole = quality.fit
    try:
        quality.fit = lambda rows, labels: seen.append(len(rows)) or whole(rows, labels)
        quality.train(docs, labels)
    finally:
        quality.fit = whole
    assert seen == [1]


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.scored(docs, m).collect()}
    want = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in want if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == want[i] for i in held) / len(held) > 0.9
    good = [i for i in held if want[i] == 1]
    assert sum(got[i]["predicted"] == 1 for i in good) / len(good) > 0.97


def test_labels_of_the_held_out_fold_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end as quality")
    a, b = quality.train(docs, labels), quality.train(docs, flipped)
    assert a.bias == b.bias and np.array_equal(a.linear, b.linear)


def test_bound_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "good words here", 1.0), (None, None, 2.0), (2, "", 3.0), (1, "good words here", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, 1), (2, None)], "doc_id long, quality int")
    m = quality.train(docs, labels, bound=1)
    got = quality.scored(docs, m).collect()
    assert len(got) == 4 and all(0 <= r["score"] <= 1 for r in got)
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    none = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.accepted(docs, none).count() == 4 and quality.accepted(docs, none).columns == docs.columns
    assert quality.scored(docs.limit(0), m).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_machine_learns_an_interaction(seed):
    """Labels that depend on a product of two inputs alone."""
    r = np.random.default_rng(seed)
    rows, labels = [], []
    for _ in range(600):
        a, b = r.choice([-1.0, 1.0], 2)
        rows.append((np.array([5, 9], np.int32), np.array([a, b], np.float32)))
        labels.append(float(a * b > 0))
    m = quality.fit(rows, np.array(labels), epochs=40)
    x = np.zeros((4, quality.SIZE), np.float32)
    x[:, 5], x[:, 9] = [1, 1, -1, -1], [1, -1, 1, -1]
    assert ((m.raw(*entries(x)) > 0) == [True, False, False, True]).all()
