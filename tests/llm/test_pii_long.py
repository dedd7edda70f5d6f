"""The decoding of whole chains, and entities of several words in long chains of digit words."""

import time

import numpy as np

from meshlark.llm import pii


def brute(words):
    """States of the words by Viterbi over the whole chain, a word at a time: no bound, no stretches, no batches."""
    f, edge = pii.field(), pii.Field.EDGE
    runs = pii.number_runs(words, np.array([pii.numeric(w) for w in words], bool))
    best, back = np.array([0.0] + [-1e4] * (len(pii.STATES) - 1)), []
    for t in range(edge, len(words) - edge):
        e = f.runs[runs[t]].copy()
        for p, place in enumerate(f.PLACES):
            e += f.weights[p, [f.index[x] for x in pii.features(words[t + place]) if x in f.index]].sum(0)
        if words[t] == pii.SENTINEL:
            e[1:] = -1e4
        through = best[:, None] + f.moves
        back.append(through.argmax(0))
        best = through.max(0) + e
    state = int((best + f.moves[:, 0]).argmax())
    path = []
    for b in reversed(back):
        path.append(state)
        state = int(b[state])
    return path[::-1]


def decoded(words):
    out = np.zeros(len(words), int)
    at, states = pii.field().decode(words)
    out[at] = states
    return out[pii.Field.EDGE : -pii.Field.EDGE].tolist()


def test_equals_viterbi_over_the_whole_chain():
    r = np.random.default_rng(4)
    kinds = "(555) 123-4567 12 4111 2024-01-02 +44 555 9.5 a1@b.com 10.0.0.1 the at dot com, word Other. (at) 4111111111111111 phone: 0171 x=1 10[.]0[.]0[.]1".split()
    edge = [pii.SENTINEL] * pii.Field.EDGE
    for n in (1, 2, 3, 10, 255, 700, 3000):
        words = [kinds[k] for k in r.integers(0, len(kinds), n)]
        words = edge + words[: n // 2] + (edge if n > 2 else []) + words[n // 2 :] + edge
        assert decoded(words) == brute(words)


def test_blocks_change_nothing(monkeypatch):
    words = [pii.SENTINEL] * 3 + "call (555) 123-4567 now or 12 and a(at)b.com then".split() * 40 + [pii.SENTINEL] * 3
    want = decoded(words)
    for size in (1, 7, 64):
        monkeypatch.setattr(pii, "BLOCK", size)
        assert decoded(words) == want == brute(words)


def test_a_phone_number_at_every_place_of_a_chain():
    for lead in (*range(250, 260), 511, 512, 767):
        text = "12 " * lead + "x (555) 123-4567," + " 12" * 300
        assert (3 * lead + 2, 3, 3 * lead + 16) in pii.all_spans([text])[0][1], lead


def test_a_long_word_is_one_token():
    text = "x" * 5000 + "(at)" + "y" * 5000 + ".com"
    assert pii.all_spans([text])[0][1] == [(0, 0, len(text))]


def test_linear_on_a_long_chain():
    began = time.time()
    pii.all_spans(["12 " * 200_000])
    assert time.time() - began < 60
