import hashlib
import random

import pytest

from meshlark.llm import exact


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    low = lambda i: (i is not None, i or 0)
    return sorted(((i, max(groups[t or ""], key=low), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("parts", ["1", "4", "13"])
def test_against_brute_force(spark, parts):
    r = random.Random(int(parts))
    rows = [(k, "hot") for k in range(400)] + [(1000 + k, r.choice(["a", "b", "a ", "A", "é", "same start of a long text " * 9 + str(r.randrange(9))])) for k in range(300)] + [(5000, None), (5001, ""), (None, "hot"), (None, "only null"), (5002, "x" * 200_000), (5003, "x" * 200_000), (5004, "x" * 199_999 + "y")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, edge int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = exact.duplicates(df).collect()
        assert sorted(((x["doc_id"], x["keep_id"], x["group_size"], x["text_sha256"]) for x in got), key=str) == brute(rows)
        kept = [x["doc_id"] for x in got if x["kept"]]
        assert len(kept) == len({t or "" for _, t in rows}) and all(x["kept"] == (x["doc_id"] == x["keep_id"]) for x in got)
        left = exact.deduplicated(df)
        assert left.columns == df.columns and sorted((x["doc_id"] for x in left.collect()), key=str) == sorted(kept, key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "t")] * 7 + [(2, "u")], "doc_id long, text string")
    got = exact.duplicates(df.repartition(3)).collect()
    assert sum(x["kept"] for x in got) == 2 and {x["group_size"] for x in got if x["doc_id"] == 1} == {7}
    assert exact.deduplicated(df).count() == 2
    assert exact.duplicates(df.limit(0)).count() == 0 and exact.deduplicated(df.limit(0)).count() == 0
