import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshlark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def histogram(sizes, capacity):
    h = np.zeros(capacity + 1, np.int64)
    for s in sizes:
        h[s] += 1
    return h


def optimum(sizes, capacity):
    """The fewest bins, by trying every distinct placement, largest first."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= sizes[k]:
                rest = list(rooms)
                rest[rest.index(r)] -= sizes[k]
                go(k + 1, rest)
        go(k + 1, [*rooms, capacity - sizes[k]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    r = random.Random(4)
    for _ in range(250):
        capacity = r.randint(6, 20)
        sizes = [r.randint(1, capacity) for _ in range(r.randint(1, 8))]
        fixed, left = packing.reduce(histogram(sizes, capacity), capacity)
        rest = [s for s in range(1, capacity + 1) for _ in range(int(left[s]))]
        assert all(sum(s * q for s, q in need.items()) <= capacity for need, _ in fixed)
        assert sum(n for _, n in fixed) + optimum(rest, capacity) == optimum(sizes, capacity), sizes


def test_best_fit_equals_one_piece_at_a_time():
    r = random.Random(5)
    for _ in range(200):
        capacity = r.randint(5, 60)
        sizes = [r.randint(1, capacity) for _ in range(r.randint(0, 80))]
        rooms = []
        for s in sorted(sizes, reverse=True):
            fit = [x for x in rooms if x >= s]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - s)
            else:
                rooms.append(capacity - s)
        got = packing.best_fit(histogram(sizes, capacity), capacity)
        assert sorted(capacity - sum(s * q for s, q in need.items()) for need, n in got for _ in range(n)) == sorted(rooms)


def test_plan_places_every_piece_once():
    r = random.Random(6)
    sizes = [r.choice([3, 5, 50, 64, 64, 99, 100]) for _ in range(5000)]
    h = histogram(sizes, 100)
    keys, firsts, sequences, copies, offsets = packing.plan(h, 100)
    used = {}
    for s in range(1, 101):
        for rank in range(int(h[s])):
            at = np.searchsorted(keys, (s << 48) + rank, "right") - 1
            nth = rank - firsts[at]
            used.setdefault(int(sequences[at] + nth // copies[at]), []).append((int(offsets[at] + nth % copies[at] * s), s))
    for spans in used.values():
        at = 0
        for o, s in sorted(spans):
            assert o == at
            at += s
        assert at <= 100
    assert len(used) <= -(-sum(sizes) // 100) + max(3, h[99])


@pytest.mark.parametrize("partitions", [1, 5])
def test_packed_table(spark, partitions, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 7)
    r = random.Random(7)
    rows = [(i, "word " * r.choice([0, 1, 5, 60, 61, 400, 5000]), i) for i in range(80)] + [(None, None, 0), (3, "word", 0), (3, "word", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(partitions)
    placed = packing.packed(df, PATH, with_ids=True)
    got = placed.collect()
    t = Tokenizer.from_file(PATH)
    want = []
    for i, x, _ in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 1]
        want += [(i, p, lo, len(ids[lo : lo + 4096]), zlib.crc32(np.array(ids[lo : lo + 4096], "<u4").tobytes())) for p, lo in enumerate(range(0, len(ids), 4096))]
    assert sorted((tuple(x)[:5] for x in got), key=str) == sorted(want, key=str)
    spans = {}
    for x in got:
        spans.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 4096
    assert len(spans) <= -(-sum(w[3] for w in want) // 4096) + 1
    for x in packing.sequences(placed).collect():
        assert len(x["ids"]) == sum(n for _, n in spans[x["sequence_id"]])
    assert packing.packed(df.limit(0), PATH).count() == 0


def test_pairs_of_pieces_are_enumerated_only_where_two_fit():
    """The dominance rules against enumeration of all companion sets."""
    r = random.Random(8)
    for _ in range(300):
        capacity = r.randint(6, 25)
        sizes = [r.randint(1, capacity) for _ in range(r.randint(1, 7))]
        j = max(sizes)
        rest = list(sizes)
        rest.remove(j)
        got = packing._dominating(histogram(rest, capacity), j, capacity)
        if got is None:
            continue
        assert j + sum(got) <= capacity
        for n in range(1, len(rest) + 1):
            for s in itertools.combinations(rest, n):
                if j + sum(s) <= capacity:
                    assert covered(sorted(s, reverse=True), list(got)), (sizes, got, s)


def covered(items, rooms):
    """Whether the items can be dealt to the rooms without overfilling one."""
    if not items:
        return True
    for k, room in enumerate(rooms):
        if room >= items[0] and covered(items[1:], [*rooms[:k], room - items[0], *rooms[k + 1 :]]):
            return True
    return False
